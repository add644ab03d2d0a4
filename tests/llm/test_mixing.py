"""Mixing: caps are kept, shares are met, expectations are those of the plan."""

import random

from recallgrid.llm import mixing

TARGETS = "mix_name string, source string, target_share double, max_repeats int, extra string"


def setup(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choices(["a", "b", "c", None], [6, 3, 1, 1])[0], int(rng.paretovariate(1.2) * 20)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint").repartition(3), rows


def test_shares_and_caps(spark):
    counts, rows = setup(spark)
    targets = spark.createDataFrame([("m", "a", 0.5, 1, ""), ("m", "b", 0.3, 2, ""), ("m", "c", 0.22, 3, ""), ("m", "none", 0.1, 1, ""), ("m", "zero", 0.0, 1, ""), ("m", "a", 0.5, 1, "x"), ("n", "c", 1.0, None, "")], TARGETS)
    plan = mixing.plan(targets, counts)
    uses = mixing.mix(counts, plan)
    got = uses.collect()
    caps = {("m", "a"): 1, ("m", "b"): 2, ("m", "c"): 3}
    assert all(0 <= r["uses"] <= caps.get((r["mix_name"], r["source"]), 10**9) for r in got)
    assert len({(r["mix_name"], r["doc_id"]) for r in got}) == len(got)
    assert len(got) == sum(s in "abc" for _, s, _ in rows if s) + sum(s == "c" for _, s, _ in rows)
    shares = {(r["mix_name"], r["source"]): r for r in mixing.shares(uses, plan).collect()}
    for (m, s), want in {("m", "a"): 0.5 / 1.02, ("m", "b"): 0.3 / 1.02, ("m", "c"): 0.22 / 1.02}.items():
        assert abs(shares[m, s]["actual_share"] - want) < 0.01
    assert shares["m", "none"]["actual_share"] == shares["m", "zero"]["actual_share"] == 0
    assert shares["n", "c"]["actual_share"] == 1.0 and shares["n", "c"]["most_uses"] == 1


def test_rounds_in_small_groups_decide_everything(spark):
    counts, _ = setup(spark)
    plan = mixing.plan(spark.createDataFrame([("m", "a", 0.7, 1, ""), ("m", "b", 0.3, 1, "")], TARGETS), counts, total_tokens=20_000)
    rows = mixing.mix(counts.repartition(40), plan, task_units=300).collect()
    assert {r["uses"] for r in rows} <= {0, 1}
    assert abs(sum(r["tokens"] * r["uses"] for r in rows) - 20_000) < 400


def test_flight_keeps_totals_and_expectations():
    rng = random.Random(9)
    units = [(i, rng.randint(1, 50), 0.3) for i in range(40)]
    hits = [0] * 40
    for k in range(3000):
        pi, left = mixing.flight(units, random.Random(k))
        assert len(left) <= 2
        assert abs(sum(pi.values()) - 12) < 1e-6
        assert abs(sum(pi[i] * t for i, t, _ in units) - sum(t * p for _, t, p in units)) < 1e-6
        for i, p in pi.items():
            hits[i] += p
    assert all(abs(h / 3000 - 0.3) < 0.05 for h in hits)


def test_landing_is_the_best_rounding():
    assert mixing.landing([(0, 10, 0.4), (1, 4, 0.5)]) == {0: 0.0, 1: 1.0}
    assert mixing.landing([]) == {}


def test_same_answer_again_and_empty(spark):
    counts, _ = setup(spark, 500)
    targets = spark.createDataFrame([("m", "a", 0.5, 1, ""), ("m", "b", 0.5, 1, ""), (None, "a", 1.0, 1, ""), ("m", None, 1.0, 1, "")], TARGETS)
    plan = mixing.plan(targets, counts)
    one, two = ({(r["doc_id"], r["uses"]) for r in mixing.mix(counts, plan).collect()} for _ in range(2))
    assert one == two
    empty = counts.limit(0)
    plan = mixing.plan(targets, empty)
    assert mixing.mix(empty, plan).count() == 0
    assert {r["actual_share"] for r in mixing.shares(mixing.mix(empty, plan), plan).collect()} == {0.0}
    assert mixing.mix(counts, mixing.plan(targets.limit(0), counts)).count() == 0


def test_large_documents_keep_their_chance(spark):
    """A document of half its source's target is drawn as often as a small one; only one beyond the target is left out."""
    sizes = [10] * 400 + [500] * 20 + [5000]
    counts = spark.createDataFrame([(i, "a", t) for i, t in enumerate(sizes)], "doc_id bigint, source string, tokens bigint")
    plan = mixing.plan(spark.createDataFrame([("m", "a", 1.0, 1, "")], TARGETS), counts, total_tokens=1000)
    assert (plan[0].usable, plan[0].limit) == (14_000, 1000) and abs(plan[0].uses - 1 / 14) < 1e-9
    used = mixing.mix(counts, plan).where("uses > 0").collect()
    assert abs(sum(r["tokens"] for r in used) - 1000) <= 500 and all(r["tokens"] < 5000 for r in used)
