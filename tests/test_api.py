"""The calls of an application, over the smallest tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from recallgrid.api import Workspace

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def w(spark):
    return Workspace(spark, SMALL)


def test_search(w):
    all_cards, new = w.find_cards().count(), w.find_cards("is:new").count()
    assert 0 < new < all_cards and w.find_cards("-is:new").count() == all_cards - new
    ordered = [r["id"] for r in w.find_cards("is:review", order="cardIvl").collect()]
    assert sorted(ordered) == sorted(r["id"] for r in w.find_cards("is:review").collect())
    assert w.normalize_search("a AND b") == "a b" and w.replace_search_term("deck:a", "deck:b") == "deck:b"
    assert w.browser_rows("is:review").count() == w.find_cards("is:review").join(w.collection().cards, "id").select("nid").distinct().count()


def test_graphs_of_a_search(w):
    whole, part = w.graphs(), w.graphs("is:review", 30)
    count = lambda g: g["card_counts"].where("variant = 'including'").collect()[0]
    assert count(part)["new"] == 0 < count(whole)["new"]
    total = lambda g: sum(r["n"] for r in g["buttons"].where("range = 'all_time'").collect())
    assert 0 <= total(part) < total(whole)
    assert set(whole) == set(part) and all(df.columns for df in part.values())


def test_notes_and_tags(w):
    changed = w.add_tags("is:review", ["zz"]).where("changed")
    assert changed.count() == w.find_notes("is:review").join(w.collection().notes, "id", "left_semi").count()
    assert w.rename_tag("marked", "seen").where("changed").count() == w.collection().notes.where(F.lower("tags").rlike("(^|[ \u3000])marked(::|[ \u3000]|$)")).count()
    assert w.remove_tags("", ["marked"]).where(F.lower("new_tags").contains(" marked ")).count() == 0
    assert w.find_and_replace("", "the", "a").where("changed").count() > 0
    assert w.find_duplicates().where("n < 2").count() == 0
    assert w.complete_tag("m", 3).count() <= 3 and w.tags().count() > 0 and w.deck_tree().count() > 0


def test_files_and_sql(w, tmp_path):
    w.export_package(str(tmp_path / "p"), "is:review")
    assert w.spark.read.parquet(str(tmp_path / "p/cards.parquet")).count() == w.find_cards("is:review").count()
    w.export_notes(str(tmp_path / "n"), "tag:marked")
    assert w.import_text(str(tmp_path / "n")).count() >= w.find_notes("tag:marked").count()
    assert w.export_dataset(str(tmp_path / "d")) > 0
    assert w.sql("SELECT count(*) AS n FROM cards WHERE type = :t", t=2).collect()[0]["n"] == w.find_cards().join(w.collection().cards, "id").where("type = 2").count()
    assert sum(t.num_rows for t in w.pages(w.find_cards())) == w.find_cards().count()
