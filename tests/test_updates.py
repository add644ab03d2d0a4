"""Updates of cards: each case by hand, and registered ones against their SQL."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from recallgrid.model import Queue
from recallgrid.operators import updates as up

CARDS = "id bigint, nid bigint, did bigint, type tinyint, queue tinyint, due int, ivl int, factor int, reps int, lapses int, odue int, odid bigint, flags int, data string"
SMALL = "/root/testdata/sf0.001"
NEW = (1, 1, 5, 0, 0, 30, 0, 0, 0, 0, 0, 0, 0, "{}")
REVIEW = (2, 1, 5, 2, 2, 100, 10, 2300, 8, 1, 0, 0, 9, '{"pos": 4, "s": 3.5, "d": 2}')
LEARN = (3, 2, 5, 1, -1, 1_700_000_000, 0, 0, 1, 0, 0, 0, 0, None)
AWAY = (4, 3, 9, 2, 2, -50, 7, 2500, 3, 0, 90, 5, 0, "broken")


def run(spark, update, *rows):
    return {r["id"]: r for r in up.apply(spark.createDataFrame(rows, CARDS), update).collect()}


def test_hold_and_release(spark):
    got = run(spark, up.hold(Queue.USER_BURIED), NEW, REVIEW, LEARN)
    assert {k: r["queue"] for k, r in got.items()} == {1: -3, 2: -3}
    assert {k: r["queue"] for k, r in run(spark, up.release(), NEW, LEARN).items()} == {3: 1}


def test_reset(spark):
    got = run(spark, up.reset(7, counts=True, restore=True), NEW, REVIEW, AWAY)
    assert [(got[k]["due"], got[k]["type"], got[k]["queue"], got[k]["reps"], got[k]["did"], got[k]["odid"]) for k in (1, 2, 4)] == [(30, 0, 0, 0, 5, 0), (4, 0, 0, 0, 5, 0), (7, 0, 0, 0, 5, 0)]
    assert got[2]["data"] == "{}" and got[4]["data"] == "{}"


def test_due_in(spark):
    got = run(spark, up.due_in(F.lit(3), 110, 1_000_000, 2500), NEW, REVIEW, AWAY)
    assert [(got[k]["due"], got[k]["ivl"], got[k]["factor"], got[k]["queue"]) for k in (1, 2, 4)] == [(113, 0, 2500, 2), (113, 23, 2300, 2), (113, 30, 2500, 2)]


def test_flag_and_move(spark):
    assert run(spark, up.flag(1), REVIEW) == {} and run(spark, up.flag(3), REVIEW)[2]["flags"] == 11
    got = run(spark, up.move(77), AWAY, NEW)
    assert (got[4]["did"], got[4]["odid"], got[4]["due"], got[4]["odue"]) == (77, 0, 90, 0) and got[1]["due"] == 30


def test_filtered_decks(spark):
    got = run(spark, up.enter_filtered(9, F.lit(-100_000), reschedule=False), REVIEW, AWAY)
    assert set(got) == {2} and (got[2]["did"], got[2]["odid"], got[2]["due"], got[2]["odue"]) == (9, 5, -100_000, 100)
    got = run(spark, up.return_home(), REVIEW, AWAY)
    assert set(got) == {4} and (got[4]["did"], got[4]["odid"], got[4]["due"], got[4]["odue"]) == (5, 0, 90, 0)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are absent")
@pytest.mark.parametrize("name", ["m18_released", "m19_due_in", "m20_returned", "h6_limit_tree", "q2_limited_reviews", "q3_limited_random_notes", "q4_buried_siblings", "o20_relative_overdueness", "o24_due", "o_notes_deck", "p6_held", "snk5_functions"])
def test_oracle(spark, name):
    from test_queries import test_oracle as agrees

    agrees(spark, name)
