"""Orphan references against brute force, with and without heavy keys."""

import random

from pyspark.sql import functions as F

from recallgrid.operators.references import existing, find_orphans, references

MONTH = 2_678_400_000


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, k bigint, n string")


def run(spark, rows, targets, **kw):
    refs = references(frame(spark, rows), "t", "k", "x")
    tgt = spark.createDataFrame([("x", k) for k in targets] + [("other", 1)], "tgt string, key bigint")
    return find_orphans(refs, tgt, **kw)


def test_matches_brute_force_with_heavy_keys(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 1, 2, 2, 3, *range(4, 30), None]), "a") for i in range(500)]
    rows += rows[:100]
    targets = [2, 3, 3, *range(10, 20)]
    want = sorted({(i, k) for i, k, _ in rows if k is not None and k not in targets})
    for heavy in (1, 50, 10**9):
        got = run(spark, rows, targets, min_heavy=heavy)
        assert sorted((r["src_id"], r["key"]) for r in got.rows.collect()) == want
        count = got.counts.collect()
        assert [(r["period"], r["refs"], r["orphans"], r["orphan_keys"]) for r in count] == [("1970-01", sum(k is not None for _, k, _ in rows[:500]), len(want), len({k for _, k in want}))]


def test_months_nulls_and_empty(spark):
    got = run(spark, [(0, 1, ""), (MONTH, 1, ""), (MONTH + 1, 2, ""), (None, 1, "")], [2])
    assert sorted((r["period"] or "", r["refs"], r["orphans"]) for r in got.counts.collect()) == [("", 1, 1), ("1970-01", 1, 1), ("1970-02", 2, 1)]
    assert run(spark, [], [1]).rows.count() == 0
    assert run(spark, [(1, 5, "")], []).rows.count() == 1


def test_other_columns_with_clashing_names(spark):
    refs = references(frame(spark, [(1, 5, "")]).withColumn("key", F.lit(3)).withColumn("src_id", F.lit(4)), "t", "k", "x")
    tgt = spark.createDataFrame([("x", 3, 9)], "tgt string, key bigint, period int")
    assert [tuple(r) for r in find_orphans(refs, tgt).rows.collect()] == [("t", "k", 1, 5)]


def test_existing_rows(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 5, "a"), (3, -1, "a"), (4, 9, "a"), (None, 1, "a")], "id bigint, usn int, v string")
    gone = spark.createDataFrame([(1, 6), (2, 5), (3, 99), (4, -1), (8, 1)], "oid bigint, usn int")
    assert sorted((r["id"], r["v"]) for r in existing(rows, gone).collect()) == [(1, "b"), (2, "a"), (3, "a")]
