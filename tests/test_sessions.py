"""Sessions against brute force, and the defined cases."""

import random

from pyspark.sql import functions as F

from recallgrid.operators.sessions import sessions

SCHEMA = "cid bigint, id bigint, time int, k_ string"
GAP = 1_800_000


def brute(rows, gap=GAP):
    by_id = {}
    for cid, id_, time, _ in rows:
        if cid is not None and id_ is not None:
            by_id[id_] = max(by_id.get(id_, (-1, -1)), (time or 0, cid))
    cards = {}
    for id_, (time, cid) in by_id.items():
        cards.setdefault(cid, []).append((id_, time))
    out = []
    for cid, own in cards.items():
        own.sort()
        runs = [[own[0]]]
        for a, b in zip(own, own[1:], strict=False):
            if b[0] - b[1] - a[0] > gap:
                runs.append([])
            runs[-1].append(b)
        out += [(cid, k + 1, min(i - t for i, t in r), r[-1][0], len(r)) for k, r in enumerate(runs)]
    return sorted(out)


def run(spark, rows, **kw):
    df = sessions(spark.createDataFrame(rows, SCHEMA), "cid", "id", "time", **kw)
    return sorted((r["cid"], r["session_no"], r["start_ms"], r["end_ms"], r["n"]) for r in df.collect())


def test_matches_brute_force_with_any_slice(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.randrange(0, 90_000_000), rng.choice([0, 5_000, 2_000_000, 9_000_000, None]), "x") for _ in range(600)]
    rows += rng.sample(rows, 50)
    for slice_ms in (21_600_000, 500_000, 7):
        assert run(spark, rows, slice_ms=slice_ms) == brute(rows)


def test_gap_of_exactly_the_limit_does_not_part(spark):
    rows = [(1, 0, 0, ""), (1, GAP, 0, ""), (1, 2 * GAP + 1, 0, "")]
    assert run(spark, rows) == [(1, 1, 0, GAP, 2), (1, 2, 2 * GAP + 1, 2 * GAP + 1, 1)]


def test_long_event_bridges_a_gap_and_start_is_the_earliest(spark):
    rows = [(1, 100, 0, ""), (1, 10 * GAP, 10 * GAP - 50, "")]
    assert run(spark, rows) == [(1, 1, 50, 10 * GAP, 2)]


def test_nulls_empty_and_other_columns(spark):
    assert run(spark, [(None, 1, 1, ""), (1, None, 1, "")]) == []
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, 10, None, "x")], SCHEMA).withColumn("n", F.lit("clash")).withColumn("session_", F.lit(1))
    assert [tuple(r) for r in sessions(df, "cid", "id", "time").collect()] == [(1, 1, 10, 10, 0, 1)]


def test_one_key_is_split_over_tasks(spark):
    df = sessions(spark.range(50_000).select(F.lit(7).alias("cid"), (F.col("id") * 3_600_000).alias("id"), F.lit(0).alias("time")), "cid", "id", "time")
    assert df.count() == 50_000
