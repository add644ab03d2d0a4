"""Helpers for skew and slices, trees, limits, merges, review histories; each against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from recallgrid.model import CLOCK, DAY
from recallgrid.operators import hierarchy as hi
from recallgrid.operators import merge, skew
from recallgrid.operators.sliced import numbered, with_previous
from recallgrid.plans.history import histories
from recallgrid.plans.queues import interspersed


def test_sliced_previous(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, i * 7 % 11) for i in rng.sample(range(100_000), 500)] + [(3, None, 1)]
    want = []
    for key in (1, 2):
        own = sorted((o, v) for k, o, v in rows if k == key and o is not None)
        want += [(key, o, n + 1, own[n - 1][1] if n else None) for n, (o, _) in enumerate(own)]
    for width in (10, 5_000, 10**9):
        got = with_previous(spark.createDataFrame(rows, "k int, o bigint, v int"), "k", "o", ["v"], width=width)
        assert sorted((r["k"], r["o"], r["idx_"], r["prev_"]["v"] if r["prev_"] else None) for r in got.collect()) == sorted(want)


def test_numbers_over_many_partitions(spark):
    ids = random.Random(3).sample(range(10**6), 3000)
    got = {r["id"]: r["n_"] for r in numbered(spark.createDataFrame([(i,) for i in ids] + [(None,)], "id int").repartition(7), "id").collect()}
    assert got == {i: n + 1 for n, i in enumerate(sorted(ids))}
    assert numbered(spark.createDataFrame([], "id int"), "id").count() == 0


def test_join_with_heavy_keys(spark):
    rows = spark.createDataFrame([(i % 3 if i < 60 else i, i) for i in range(100)], "k int, v int")
    one = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    want = sorted((r["k"], r["v"], r["top"]) for r in rows.join(one, "k").collect())
    for least in (1, 15, 10**9):
        assert sorted((r["k"], r["v"], r["top"]) for r in skew.join_one_to_many(rows, one, ["k"], "n", min_rows=least).collect()) == want
        assert skew.join_one_to_many(rows, one.where("k = 1"), ["k"], "n", "left_semi", min_rows=least).count() == 20


def test_trees(spark):
    names = spark.createDataFrame([("a",), ("a\x1fb",), ("c\x1fd\x1fe",)], "name string")
    assert sorted((r["name"], r["level"], r["parent"]) for r in hi.with_path(names).collect()) == [("a", 1, None), ("a\x1fb", 2, "a"), ("c\x1fd\x1fe", 3, "c\x1fd")]
    assert sorted(r[0] for r in hi.missing_parents(names).collect()) == ["c", "c\x1fd"]
    rolled = hi.rolled_up(names.withColumn("v", F.lit(1)), "name", ["v"])
    assert {r["name"]: r["v"] for r in rolled.collect()} == {"a": 2, "a\x1fb": 1, "c": 1, "c\x1fd": 1, "c\x1fd\x1fe": 1}


def test_capped_tree():
    own = {"a": hi.Counts(new=5, review=5, intraday=2, interday=1, total=20), "a\x1fb": hi.Counts(new=10, review=10, interday=3, total=30), "lost\x1fx": hi.Counts(new=1)}
    got = hi.capped_tree(own, {"a": hi.Limit(review=8, new=7), "a\x1fb": hi.Limit(review=6, new=100)})
    assert got["a\x1fb"] == {"new": 7, "review": 3, "learn": 3, "total": 30}
    assert got["a"] == {"new": 7, "review": 4, "learn": 6, "total": 50}
    assert "lost\x1fx" not in got
    assert hi.capped_tree({"a": hi.Counts(new=5, review=5)}, {"a": hi.Limit(6, 10, True)})["a"]["new"] == 1


def test_limits_are_greedy(spark):
    rng = random.Random(6)
    decks = ["a", "a\x1fb", "a\x1fb\x1fc", "a\x1fd", "e"]
    limits = {"a": 12, "a\x1fb": 7, "a\x1fb\x1fc": 4, "e": 3}
    rows = [(i, rng.choice(decks)) for i in range(80)]
    room, want = dict(limits), []
    for i, deck in rows:
        above = ["\x1f".join(deck.split("\x1f")[: k + 1]) for k in range(deck.count("\x1f") + 1)]
        if all(room.get(n, 1) > 0 for n in above):
            want.append(i)
            for n in above:
                if n in room:
                    room[n] -= 1
    df = spark.createDataFrame(rows, "id int, name string").withColumn("path", F.split("name", "\x1f"))
    assert sorted(r["id"] for r in hi.within_limits(df, "path", [F.col("id")], limits, 4).collect()) == want


def test_interspersing(spark):
    a = spark.createDataFrame([(i, i) for i in range(6)], "id int, pos int")
    b = spark.createDataFrame([(10 + i, i) for i in range(2)], "id int, pos int")
    got = [r["source"] for r in interspersed(a, b, 6, 2).collect()]
    assert got == [1, 1, 2, 1, 1, 2, 1, 1]
    assert [r["id"] for r in interspersed(a, b.limit(0), 6, 0).collect()] == list(range(6))


def test_merges(spark):
    schema = "id int, usn int, mod int, v string"
    local = spark.createDataFrame([(1, 5, 10, "l"), (2, -1, 10, "l"), (3, -1, 10, "l"), (4, 1, 1, "l")], schema)
    remote = spark.createDataFrame([(1, 9, 5, "r"), (2, 9, 11, "r"), (3, 9, 10, "r"), (5, 9, 1, "r")], schema)
    assert {r["id"]: r["v"] for r in merge.sync_rows(local, remote).collect()} == {1: "r", 2: "r", 3: "l", 4: "l", 5: "r"}
    assert {r["id"]: r["v"] for r in merge.insert_or_ignore(local, remote, ["id"]).collect()} == {1: "l", 2: "l", 3: "l", 4: "l", 5: "r"}
    assert {r["id"]: r["v"] for r in merge.upsert(local, remote, ["id"]).collect()} == {1: "r", 2: "r", 3: "r", 4: "l", 5: "r"}
    kept, stones = merge.bury_with_tombstones(local, remote.select("id"), "id", 0)
    assert [r["id"] for r in kept.collect()] == [4] and sorted(r["oid"] for r in stones.collect()) == [1, 2, 3]
    new = merge.allocate_ids(remote, local, "id", F.col("id") > 0)
    assert sorted((r["old_id"], r["id"]) for r in new.collect()) == [(1, 6), (2, 7), (3, 8), (5, 5)]
    assert [merge.sync_action(*x) for x in (((1, 1, 1), (1, 2, 1)), ((1, 1, 1), (2, 2, 1)), ((1, 1, 1), (2, 1, 5)))] == ["none", "full", "normal"]


@pytest.mark.parametrize(
    ("make", "tags", "want"),
    [
        (lambda t: merge.add_tags(t, ["B", "c"]), ["b", "A"], ["A", "B", "c"]),
        (lambda t: merge.remove_tags(t, ["X"]), ["x", "x::y", "xy"], ["xy"]),
        (lambda t: merge.rename_tag(t, "a", "z"), ["A", "a::b", "ab"], ["ab", "z", "z::b"]),
        (lambda t: merge.reparent_tag(t, "a::b", "c"), ["a::b", "a::b::d", "a"], ["a", "c::b", "c::b::d"]),
        (lambda t: merge.reparent_tag(t, "a", "a::b"), ["a"], ["a"]),
        (lambda t: merge.reparent_tag(t, "a::b", None), ["a::b"], ["b"]),
        (merge.canonical_tags, [], []),
    ],
)
def test_tags(spark, make, tags, want):
    df = spark.createDataFrame([(tags,)], "t array<string>")
    assert df.select(make(F.col("t"))).collect()[0][0] == want


def test_fields_and_tag_completion(spark):
    notes = spark.createDataFrame([(1, "the cat\x1fThe dog"), (2, "x\x1fy")], "id int, flds string")
    got = {r["id"]: (r["new_flds"], r["changed"]) for r in merge.find_and_replace(notes, r"the (\w+)", "a $1").collect()}
    assert got == {1: ("a cat\x1fa dog", True), 2: ("x\x1fy", False)}
    got = merge.find_and_replace(notes, "the", "a", field=1, ignore_case=False).where("id = 1").collect()[0]
    assert not got["changed"]
    tags = spark.createDataFrame([("me::x",), ("home",), ("Met",), ("a::me",)], "tag string")
    assert [r["tag"] for r in merge.complete_tags(tags, "me", 10).collect()] == ["me::x", "Met", "home"]
    assert [r["tag"] for r in merge.complete_tags(tags, "a::m", 10).collect()] == ["a::me"]
    assert notes.select(merge.remap_fields(F.col("flds"), [1, None, 7])).collect()[0][0] == "The dog\x1f\x1f"


def test_media_actions(spark):
    rows = [("a", "a", False, "none"), ("a", "a", True, "remove_pending"), (None, None, True, "none"), ("a", None, False, "delete"), ("a", None, True, "none"), ("a", "b", False, "download"), (None, "b", True, "download")]
    df = spark.createDataFrame(rows, "l string, r string, w boolean, want string")
    assert all(r[0] == r[1] for r in df.select(merge.media_action(F.col("l"), F.col("r"), F.col("w")), "want").collect())


LEARN, REVIEW, RELEARN, FILTERED, MANUAL = range(5)


def brute_history(entries, training, before):
    """The backward scan over one card's reviews (id, type, ease, ivl, factor)."""
    first_learn = first_grade = None
    complete = False
    for i in range(len(entries) - 1, -1, -1):
        id_, kind, ease, ivl, factor = entries[i]
        if kind == FILTERED and factor == 0:
            continue
        if ease > 0 and id_ > before and (ivl >= 1 or ivl <= -DAY):
            first_grade = i
        if ease > 0 and kind == LEARN:
            first_learn, complete = i, True
        elif kind == MANUAL and factor == 0:
            if first_learn is not None:
                complete = True
                break
            if first_grade is not None:
                break
            return []
        elif first_learn is not None:
            break
    if first_learn is not None and entries[first_learn][0] < before:
        if training:
            return []
        if first_learn < len(entries) - 1:
            complete, first_learn = False, None
    if first_learn is None and (training or first_grade is None):
        return []
    start = first_learn if first_learn is not None else first_grade
    kept = [e for e in entries[start:] if e[2] > 0 and not (e[1] == FILTERED and e[4] == 0)]
    day = lambda x: max((CLOCK.next_day_at - x // 1000) // DAY, 0)
    return [(e[0], n + 1, e[2], day(kept[n - 1][0]) - day(e[0]) if n else 0, complete) for n, e in enumerate(kept)]


def test_histories_as_the_backward_scan(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for cid in range(120):
        ids = sorted(rng.sample(range(CLOCK.next_day_at - 90 * DAY, CLOCK.next_day_at), rng.randint(1, 9)))
        own = []
        for i in ids:
            kind = rng.choice([0, 0, 1, 1, 1, 2, 3, 4, 4])
            own.append((i * 1000, kind, 0 if kind == 4 else rng.randint(1, 4), rng.choice([-600, 0, 1, 5, -90_000]), rng.choice([0, 2500])))
        rows += [(cid, *e) for e in own]
        want[cid] = own
    df = spark.createDataFrame(rows, "cid int, id bigint, type int, ease int, ivl int, factor int")
    for training, width in ((True, 21_600_000), (True, 30 * DAY * 1000), (False, 15 * DAY * 1000), (False, 21_600_000)):
        for before in (0, (CLOCK.next_day_at - 40 * DAY) * 1000):
            got = {}
            for r in histories(df, training=training, ignore_before_ms=before, width=width).collect():
                got.setdefault(r["cid"], []).append((r["id"], r["idx"], r["rating"], r["delta_t"], r["complete"]))
            for cid, own in want.items():
                assert sorted(got.get(cid, [])) == brute_history(own, training, before), (cid, training, before, own)
    assert histories(df.limit(0), training=True).count() == 0
