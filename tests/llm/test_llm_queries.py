"""Registered llm queries run on the smallest tables and agree with their SQL."""

from pathlib import Path

import pytest

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are absent")


@pytest.mark.parametrize("name", ["p1_found", "p1_classes", "p1_forms", "p4_found", "p4_notes"])
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


def test_packing_and_mixing(spark):
    import __spark_entry__ as entry

    q = entry.queries()
    placed = q["p7_placements"](spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("text is not null")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    summary = q["p7_summary"](spark, SMALL).collect()
    assert all(len({r["doc_id"] for r in placed if r["capacity_id"] == s["capacity_id"]}) + s["empty_documents"] == len(ids) for s in summary)
    shares = q["p8_shares"](spark, SMALL).collect()
    assert shares and all(s["max_repeats"] is None or s["most_uses"] <= s["max_repeats"] for s in shares)
