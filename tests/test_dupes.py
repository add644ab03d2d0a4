"""Duplicate notes: each note of a group is named, also those between the first and the last."""

from pathlib import Path

import pytest

SMALL = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are absent")
def test_every_note_of_a_group_is_named(spark):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = sorted((r["value"], r["n"], r["id"]) for r in entry.queries()["g27_find_dupes_notes"](spark, SMALL).collect())
    assert got and got == sorted(con.execute(entry.oracle_sql()["g27_find_dupes_notes"]).fetchall())
    groups = {r["value"]: r["n"] for r in entry.queries()["g27_find_dupes"](spark, SMALL).collect()}
    assert {v: n for v, n, _ in got} == groups and len(got) == sum(groups.values())


def test_wide_blanks_at_the_ends_do_not_matter(spark):
    from recallgrid.plans import stats

    df = spark.createDataFrame([(1, "a　\x1fx"), (2, "<b>a</b>&nbsp;\x1fy"), (3, " a\x1fz"), (4, "b\x1fz")], "id bigint, flds string")
    assert sorted(map(tuple, stats.duplicate_values(df, stats.first_field()).collect())) == [("a", 3, 1), ("a", 3, 2), ("a", 3, 3)]
