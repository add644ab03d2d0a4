"""Registered queries run on the smallest tables and agree with their SQL: a selection, or with RECALLGRID_ALL=1 all that have
SQL, as verify.py does on larger tables. Queries can be listed without a session."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SMALL = "/root/testdata/sf0.001"


def every() -> list[str]:
    import __spark_entry__ as entry

    return [n for n in entry.queries() if n in entry.oracle_sql()]


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are absent")
def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "cid"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are absent")
@pytest.mark.parametrize("name", every() if os.environ.get("RECALLGRID_ALL") else ["p2_found", "p3_found", "p3_counts", "p6_found", "p6_state", "g2_reviews", "g3_true_retention", "g14_card_stats", "s_b2_and_or", "o_cards_cardDue"])
def test_oracle(spark, name):
    import duckdb

    import __spark_entry__ as entry
    from verify import norm

    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, SMALL)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(norm, r)) for r in cur.fetchall()), key=repr)
