"""Reviews as a stream. The batch operators define the results; these keep them up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recallgrid.model import DAY
from recallgrid.operators import merge


def review_stream(spark: SparkSession, path: str, schema: str, *, files_per_trigger: int = 100) -> DataFrame:
    """Files of reviews as they arrive, with their time as ts."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.timestamp_millis("id"))


def daily_counts(reviews: DataFrame, *, rollover_hours: int = 4, lateness: str = "30 days") -> DataFrame:
    """Reviews and time per day and kind. A day begins at the rollover; a review sent again is dropped within the watermark."""
    kind = F.when(F.col("type") == 0, "learn").when(F.col("type") == 2, "relearn").when(F.col("type") == 3, "filtered").when(F.col("last_ivl") < 21, "young").otherwise("mature")
    rows = reviews.where(~F.col("type").isin(4, 5)).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["id"])
    day = F.window("ts", "1 day", startTime=f"{rollover_hours} hours")
    out = rows.groupBy(day, kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("time", F.lit(0))).alias("ms"))
    return out.select(F.col("window.start").alias("day"), "kind", "n", "ms")


def sessions(reviews: DataFrame, *, gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    """Sessions of each card by event time. Here a gap is counted between the ends of reviews; the batch operator counts it
    to the start of the later one."""
    rows = reviews.where(F.col("cid").isNotNull() & ~F.col("type").isin(4, 5)).withWatermark("ts", lateness)
    out = rows.groupBy(F.session_window("ts", gap), "cid").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("end_ms"))
    return out.select("cid", F.col("session_window.start").alias("start"), "end_ms", "n")


STATE = "last_id bigint, last_ivl int, reset_id bigint"
OUT = "cid bigint, reviewed_at bigint, previous_interval int"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last_id, last_ivl, reset_id = state.get if state.exists else (None, None, None)
    for b in batches:
        counts = b[(b["ease"] > 0) & ~((b["type"] == 3) & (b["factor"] == 0))]
        if len(counts):
            top = counts.loc[counts["id"].idxmax()]
            if last_id is None or top["id"] > last_id:
                last_id, last_ivl = int(top["id"]), int(top["last_ivl"]) if top["last_ivl"] >= 0 and top["ease"] > 1 else None
        resets = b[(b["type"] == 4) & (b["factor"] == 0)]["id"]
        if len(resets):
            reset_id = max(int(resets.max()), reset_id or 0)
    state.update((last_id, last_ivl, reset_id))
    valid = last_id is not None and (reset_id is None or last_id > reset_id)
    out = pd.DataFrame({"cid": [key[0]], "reviewed_at": [last_id // 1000 if valid else None], "previous_interval": [last_ivl if valid else None]})
    yield out.astype({"reviewed_at": "Int64", "previous_interval": "Int32"})


def last_reviews(reviews: DataFrame) -> DataFrame:
    """(cid, reviewed_at, previous_interval), anew for each card with new reviews: the last one that counts since a reset.

    The state of a card is three numbers, so late and repeated reviews need no buffer.
    """
    rows = reviews.where(F.col("cid").isNotNull()).select("cid", "id", "ease", "type", "factor", "last_ivl")
    return rows.groupBy("cid").applyInPandasWithState(_advance, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def upsert_stream(changes: DataFrame, table_path: str, checkpoint: str, *, key: str = "id"):  # noqa: ANN201
    """Applies a stream of whole rows to a table by the rule of a sync, in versions v0, v1, ...; a batch that is applied
    again writes the same version."""
    spark = changes.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        order = F.struct(*[F.col(x) for x in batch.columns])
        one = batch.groupBy(key).agg(F.max_by(order, F.struct("mod", "usn")).alias("row_")).select("row_.*")
        old = one.limit(0) if number == 0 else spark.read.parquet(f"{table_path}/v{number - 1}")
        merge.sync_rows(old, one, key).write.mode("overwrite").parquet(f"{table_path}/v{number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def day_of(ms: int, next_day_at: int) -> int:
    """Days from today of a review, as the batch statistics count them."""
    return int((ms // 1000 - next_day_at) / DAY)
