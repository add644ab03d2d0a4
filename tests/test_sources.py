"""Round trips through files, and reviews as a stream."""

import pytest
from pyspark.sql import functions as F

from recallgrid.model import CLOCK, Catalog, Deck
from recallgrid.search.compile import Collection
from recallgrid.sources import collections as packages
from recallgrid.sources import delimited
from recallgrid.streaming import reviews as live


def test_metadata_and_delimiters():
    meta, used = delimited.read_metadata(["﻿#separator:Semicolon", "#html:true", "#tags:a b", "#tags column:3", "#deck:X::Y", "#columns:f;g;t", "#unknown:1", "x;y;z"])
    assert used == 7 and meta.delimiter == ";" and meta.is_html and meta.global_tags == ["a", "b"] and meta.tags_column == 3 and meta.deck == "X::Y" and meta.columns == ["f", "g", "t"]
    meta, used = delimited.read_metadata(["tags:foo", "a\tb"])
    assert (meta.global_tags, used) == (["foo"], 1)
    assert [delimited.detect_delimiter(t) for t in ("a,b\tc", "a|b,c", "a;b:c", "a:b c", "a,b", "ab")] == ["\t", "|", ";", ":", ",", " "]


def test_reading(spark, tmp_path):
    f = tmp_path / "in.txt"
    f.write_text('#separator:comma\n#html:false\n#tags column:3\n#guid column:4\n"a, <b>",c,x y,g1\nd\n# note\n"e ""q""",f,,\n')
    rows = [(r["fields"], r["tags"], r["guid"]) for r in delimited.read_notes(spark, str(f)).collect()]
    assert rows == [(["a, &lt;b&gt;", "c"], ["x", "y"], "g1"), (["d", ""], [], None), (["e &quot;q&quot;", "f"], [], None)]
    empty = tmp_path / "empty.txt"
    empty.write_text("")
    assert delimited.read_notes(spark, str(empty)).count() == 0


def test_round_trip_of_notes(spark, tmp_path):
    notes = [(1, 'a "q"\x1fb\tc', " x y "), (2, "#d\x1f", ""), (3, "é\x1f<b>z</b>", None), (4, "one", "t")]
    df = spark.createDataFrame(notes, "id int, flds string, tags string").repartition(2)
    path = str(tmp_path / "out")
    delimited.write_notes(df, path, extra={"guid": F.concat(F.lit("g"), "id")})
    got = sorted((r["guid"], r["fields"], r["tags"]) for r in delimited.read_notes(spark, path, n_columns=4).collect())
    assert got == [("g1", ['a "q"', "b\tc"], ["x", "y"]), ("g2", ["#d", ""], []), ("g3", ["é", "<b>z</b>"], []), ("g4", ["one", ""], ["t"])]


def test_cards_as_text(spark, tmp_path):
    rows = [(2, "<b>q2</b>", "q2<hr id=answer>a2"), (1, "q1", 'x<hr id=answer> say "a1"'), (3, None, "only")]
    delimited.write_cards(spark.createDataFrame(rows, "id int, question string, answer string"), str(tmp_path / "c"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "c")).collect()] == ['q1\t"say ""a1"""', "q2\ta2", "\tonly"]


def test_json_notes(spark, tmp_path):
    f = tmp_path / "in.json"
    f.write_text('{"default_deck": "D", "notes": [{"fields": ["a", "b"], "tags": ["t"]}, {"guid": "g", "deck": "E"}]}')
    rows = [tuple(r) for r in packages.read_json_notes(spark, str(f)).collect()]
    assert rows == [(["a", "b"], ["t"], "D", None, None), ([], [], "E", None, "g")]


@pytest.fixture
def col(spark):
    cards = spark.createDataFrame([(1, 10, 100, 0, 2, 2, 5), (2, 11, 101, 0, 0, 0, 0)], "id bigint, nid bigint, did bigint, odid bigint, type int, queue int, ivl int")
    notes = spark.createDataFrame([(10, " a Marked "), (11, "")], "id bigint, tags string")
    reviews = spark.createDataFrame([(1, 1, 3, 0), (2, 2, 0, 0), (3, 2, 0, 5)], "id bigint, cid bigint, ease int, factor int")
    return Collection(cards, notes, reviews, Catalog([Deck(100, "P\x1fQ", 1, False), Deck(101, "R", 1, False)], []), CLOCK)


def test_packages(spark, tmp_path, col):
    decks = spark.createDataFrame([(99, "P"), (100, "P\x1fQ"), (101, "R")], "id bigint, name string")
    packages.write_package(packages.gather(col, "deck:P", decks), str(tmp_path))
    back = packages.read_package(spark, str(tmp_path))
    assert [r["id"] for r in back["cards"].collect()] == [1] and [r["id"] for r in back["notes"].collect()] == [10] and [r["id"] for r in back["revlog"].collect()] == [1]
    assert sorted(r["name"] for r in back["decks"].collect()) == ["P", "P\x1fQ"]
    plain = packages.gather(col, "deck:P", decks, with_scheduling=False)
    assert "revlog" not in plain and plain["notes"].collect()[0]["tags"] == " a " and plain["cards"].collect()[0]["ivl"] == 0


def test_dataset_and_pages(spark, tmp_path, col):
    decks = spark.createDataFrame([(100, "P")], "id bigint, name string")
    assert packages.write_dataset(col, decks, str(tmp_path)) == 2
    with pytest.raises(ValueError):
        packages.write_dataset(col, decks, str(tmp_path), min_entries=3)
    sizes = [t.num_rows for t in packages.pages(spark.range(100), 80)]
    assert sum(sizes) == 100 and max(sizes) == 10


SCHEMA = "id bigint, cid bigint, usn int, ease int, ivl int, last_ivl int, factor int, time int, type int"


def reviews(spark, rows, path, mode="append"):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


H = 3_600_000


def test_daily_stream(spark, tmp_path):
    path = str(tmp_path / "r")
    reviews(spark, [(10 * H, 1, 1, 3, 1, 0, 0, 5, 0), (11 * H, 1, 1, 3, 1, 30, 0, 7, 1), (11 * H, 1, 9, 3, 1, 30, 0, 7, 1), (3 * H, 1, 1, 3, 1, 5, 0, None, 1), (12 * H, 1, 1, 0, 1, 5, 0, 1, 4)], path)
    got = run(live.daily_counts(live.review_stream(spark, path, SCHEMA)), "daily", "complete", tmp_path)
    assert sorted((r["kind"], r["n"], r["ms"]) for r in got) == [("learn", 1, 5), ("mature", 1, 7), ("young", 1, 0)]
    assert len({r["day"] for r in got}) == 2


def test_last_reviews_stream(spark, tmp_path):
    path = str(tmp_path / "r")
    reviews(spark, [(5000, 1, 1, 3, 9, 4, 2500, 5, 1), (9000, 2, 1, 3, 9, 4, 2500, 5, 1), (None, None, 1, 1, 1, 1, 1, 1, 1)], path)
    reviews(spark, [(4000, 1, 1, 1, 9, 7, 2500, 5, 1), (9500, 2, 1, 0, 0, 0, 0, 0, 4)], path)
    got = run(live.last_reviews(live.review_stream(spark, path, SCHEMA, files_per_trigger=1)), "lasts", "update", tmp_path)
    final = {}
    for r in got:
        final.setdefault(r["cid"], []).append((r["reviewed_at"], r["previous_interval"]))
    assert final[1][-1] == (5, 4)
    assert (None, None) in final[2]


def test_upsert_stream(spark, tmp_path):
    schema = "id bigint, usn int, mod int, v string"
    src, table = str(tmp_path / "s"), str(tmp_path / "t")
    spark.createDataFrame([(1, 1, 1, "a"), (2, 1, 1, "b")], schema).coalesce(1).write.parquet(src)
    q = live.upsert_stream(spark.readStream.schema(schema).parquet(src), table, str(tmp_path / "c"))
    q.awaitTermination(120)
    spark.createDataFrame([(1, 2, 5, "c"), (3, 2, 1, "d")], schema).coalesce(1).write.mode("append").parquet(src)
    q = live.upsert_stream(spark.readStream.schema(schema).parquet(src), table, str(tmp_path / "c"))
    q.awaitTermination(120)
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(f"{table}/v1").collect()) == [(1, "c"), (2, "b"), (3, "d")]
