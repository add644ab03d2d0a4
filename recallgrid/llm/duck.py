"""DuckDB inside Arrow partitions: SQL over each batch of a DataFrame, on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Most bytes of a batch that one statement works on; larger batches are cut by rows.
SLICE_BYTES = 8 << 20

_CONNECTION = None


def connection():
    """One in-process database per Python worker, with one thread: Spark gives it one core."""
    global _CONNECTION
    if _CONNECTION is None:
        import duckdb

        _CONNECTION = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB"})
    return _CONNECTION


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = max(1, min(batch.num_rows, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, 1))))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def over_partitions(df: DataFrame, sql: str, schema: str) -> DataFrame:
    """The rows of sql, in which the table part is a slice of df; schema is that of the result."""
    return df.mapInArrow(_runner(sql), schema)


def _runner(sql: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connection()
        for batch in batches:
            for part in slices(batch):
                con.register("part", pa.Table.from_batches([part]))
                out = con.sql(sql).to_arrow_table()
                con.unregister("part")
                yield from out.to_batches()

    return run
