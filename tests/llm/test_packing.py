"""Packing: every token in exactly one place, no container overfull, no needless cut, little waste."""

import random
from collections import defaultdict

import pytest

from recallgrid.llm import packing, tokens


def counts(spark, sizes):
    return spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, tokens bigint")


def check(placements, sizes, caps):
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in placements:
        by_doc[r["capacity_id"], r["doc_id"]].append(r)
        by_bin[r["container_id"]].append(r)
    for cid, cap in caps:
        for d, n in enumerate(sizes):
            own = sorted(by_doc[cid, d], key=lambda r: r["piece"])
            assert sum(r["tokens"] for r in own) == n
            assert len(own) == -(-n // cap)
            assert [r["token_start"] for r in own] == [cap * k for k in range(len(own))]
    for rows in by_bin.values():
        cap = dict(caps)[rows[0]["capacity_id"]]
        assert len({r["capacity_id"] for r in rows}) == 1
        assert sum(r["tokens"] for r in rows) == rows[0]["fill_tokens"] <= cap
        assert sorted(r["place"] for r in rows) == list(range(1, len(rows) + 1))
    return len(by_bin)


@pytest.mark.parametrize("task_items", [7, 50_000])
def test_whole_and_within_capacity(spark, task_items):
    rng = random.Random(4)
    sizes = [min(3000, int(rng.paretovariate(0.8) * 8)) for _ in range(700)] + [0, 256, 512, 257, 1]
    caps = [(1, 256), (2, 1024)]
    df = packing.pack(counts(spark, sizes).repartition(5), caps, task_items=task_items)
    check(packing.placements(df).collect(), sizes, caps)
    for r in packing.summary(df).collect():
        assert r["n_containers"] <= r["least_containers"] * (1.02 if task_items > 7 else 1.2) + 2
        assert r["tokens"] == sum(sizes)
    assert {r["unused_tokens"] >= 0 for r in packing.fills(df).collect()} == {True}


def test_items_that_never_fit_together_stay_whole(spark):
    df = packing.pack(counts(spark, [60] * 500), [(1, 100)], task_items=50)
    assert check(packing.placements(df).collect(), [60] * 500, [(1, 100)]) == 500


def test_best_fit_is_as_brute_force():
    rng = random.Random(1)
    sizes = [rng.randint(1, 100) for _ in range(400)]
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(100 - s)
    got = packing.best_fit(sizes, 100)
    assert sorted(100 - sum(sizes[i] for i in b) for b in got) == sorted(rooms)
    assert sorted(i for b in got for i in b) == list(range(400))


def test_empty_and_odd_capacities(spark):
    caps = spark.createDataFrame([(1, "a", 5), (1, "b", 7), (2, "c", 0), (3, "d", None), (None, "e", 4)], "capacity_id int, label string, capacity_tokens int")
    assert packing.capacities_of(caps) == [(1, 7)]
    assert packing.pack(counts(spark, []), [(1, 10)]).count() == 0
    assert packing.pack(counts(spark, [3]), []).count() == 0


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "hello world", "s"), (1, "hello world", "s"), (2, "", None), (3, None, "s"), (None, "x", "s"), (4, "<|endoftext|> " * 20_000, "t")], "doc_id bigint, text string, source string")
    got = {r["doc_id"]: (r["source"], r["tokens"]) for r in tokens.token_counts(docs).collect()}
    assert got[1] == ("s", 2) and got[2] == (None, 0) and set(got) == {1, 2, 4} and got[4][1] > 60_000


def test_sizes_are_dealt_by_rows(spark):
    df = packing.dealt(counts(spark, [1] * 1000), 4, 500)
    assert df.rdd.getNumPartitions() == 8 and df.count() == 1000
    assert packing.dealt(counts(spark, []), 4, 500).count() == 0
