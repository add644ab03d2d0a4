"""Plans of the readers: only what a query needs is scanned, and only one version of a row leaves a task."""

import re

import pytest

from recallgrid.plans import base
from recallgrid.session import LOCAL_CHECKPOINTS, checkpoint_dir
from recallgrid.tables import latest

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(df, table):
    """Columns read from a table."""
    line = next(x for x in plan(df).splitlines() if f"/{table}.parquet" in x)
    return {c.split(":")[0] for c in re.search(r"ReadSchema: struct<(.*)>", line)[1].split(",")}


RANK = {"id", "usn", "mod", "_tmp_metadata_row_index"}


@pytest.mark.parametrize(("name", "table", "more"), [("g7_intervals", "cards", {"type", "ivl"}), ("s_p25_added", "cards", set()), ("j2_notes_with_cards", "notes", set())])
def test_readers_are_pruned(spark, name, table, more):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SMALL)
    assert scanned(df, table) == RANK | more
    assert "Partial" in plan(df) and "WindowGroupLimit" in plan(df)


def test_conditions_reach_the_scan(spark):
    from recallgrid.search.compile import find_cards

    df = find_cards(base.collection(spark, SMALL), "added:30")
    assert "GreaterThan(id" in plan(df)


def test_latest_version(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, None, "c"), (None, 9, "d"), (2, None, "e")], "k int, v int, x string")
    from pyspark.sql import functions as F

    assert sorted(r["x"] for r in latest(rows, "k", F.col("v")).collect()) == ["b", "e"]
    assert latest(rows.limit(0), "k", F.col("v")).count() == 0


def test_checkpoints_of_local_sessions_have_one_folder(spark):
    assert checkpoint_dir(spark).startswith(f"file:{LOCAL_CHECKPOINTS}")


def test_histories_read_the_reviews_once(spark):
    """One scan, whose rows are kept; what follows reads only these."""
    from recallgrid.plans.history import histories

    df = histories(base.revlog(spark, SMALL), training=True)
    assert "revlog.parquet" not in plan(df) and "ExistingRDD" in plan(df)


def test_hash_as_sql():
    import duckdb

    from recallgrid.functions import text as tx

    for a, b in ((0, 0), (1_752_394_711_927, 5_000), (1 << 40, 1_759_370_000)):
        assert duckdb.connect().execute(f"SELECT {tx.fnv_sql(str(a), str(b))}").fetchone()[0] == tx.fnv1a(a, b)


@pytest.mark.parametrize("name", ["p6_found", "p6_state"])
def test_state_of_the_feed_reads_only_the_feed(spark, name):
    """Without a commit log nothing is held back, so nothing is read, counted or kept to find out what to hold."""
    import __spark_entry__ as entry

    text = plan(entry.queries()[name](spark, SMALL))
    assert set(re.findall(r"/(\w+)\.parquet", text)) == {"cards", "graves"}
    assert "Subquery" not in text and "ExistingRDD" not in text
