"""One object with the calls of an application: search, statistics, decks, tags, notes, import and export, SQL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.functions import text as tx
from recallgrid.operators import merge
from recallgrid.plans import base, history, queues, searches, stats, texts
from recallgrid.search import writer
from recallgrid.search.ast import Node
from recallgrid.search.compile import find_cards, find_notes
from recallgrid.sources import collections as packages
from recallgrid.sources import delimited


@dataclass
class Workspace:
    """A collection in a folder of Parquet tables. All calls return lazy frames unless they say otherwise."""

    spark: SparkSession
    path: str

    def collection(self) -> base.Collection:
        return base.collection(self.spark, self.path)

    # Search.

    def find_cards(self, search: str | Node = "", order: str | None = None, reverse: bool = False) -> DataFrame:
        """Ids of cards; order is a browser column."""
        if order is None:
            return find_cards(self.collection(), search)
        return searches.sorted_cards(self.spark, self.path, order, search, reverse).select("id")

    def find_notes(self, search: str | Node = "") -> DataFrame:
        return find_notes(self.collection(), search)

    @staticmethod
    def normalize_search(search: str) -> str:
        return writer.normalize(search)

    @staticmethod
    def replace_search_term(search: str, term: str) -> str:
        return writer.replace_term(search, term)

    def browser_rows(self, search: str = "") -> DataFrame:
        """Browser columns of the notes found."""
        return queues.note_rows(self.spark, self.path).join(self.find_notes(search).select(F.col("id").alias("nid")), "nid", "left_semi")

    # Statistics.

    def graphs(self, search: str = "", days: int = 0) -> dict[str, DataFrame]:
        """All statistics of the cards of a search, with reviews of the last days; 0: all."""
        parts = {
            "added": stats.added, "reviews": stats.reviews, "true_retention": stats.g3, "buttons": stats.buttons, "hours": stats.hours, "today": stats.today, "intervals": stats.intervals, "stability": stats.stability, "eases": stats.eases,
            "difficulty": stats.difficulty, "medians": stats.medians, "retrievability": stats.retrievability, "future_due": stats.future_due, "load": stats.load, "card_counts": stats.card_counts,
        }
        with base.scope(self.spark, self.path, search, days):
            return {name: make(self.spark, self.path) for name, make in parts.items()}

    def card_stats(self, card_id: int) -> DataFrame:
        return stats.card_stats(self.spark, self.path).where(F.col("id") == card_id)

    def card_history(self, card_id: int) -> DataFrame:
        """Reviews of a card, the newest first."""
        return base.revlog(self.spark, self.path).where(F.col("cid") == card_id).orderBy(F.col("id").desc())

    def memory_reviews(self, *, training: bool, ignore_before_ms: int = 0) -> DataFrame:
        return history.histories(base.revlog(self.spark, self.path), training=training, ignore_before_ms=ignore_before_ms)

    # Decks and queue.

    def deck_tree(self) -> DataFrame:
        return queues.capped_tree(self.spark, self.path)

    def due_counts(self) -> DataFrame:
        return stats.due_counts(self.spark, self.path)

    def filtered(self, search: str, order: str, limit: int) -> DataFrame:
        return searches.filtered_cards(self.spark, self.path, search, order, limit)

    def rename_deck(self, old: str, new: str) -> DataFrame:
        return base.decks(self.spark, self.path).withColumn("name", merge.rename_subtree(F.col("name"), old.replace("::", "\x1f"), new.replace("::", "\x1f")))

    # Tags and notes.

    def tags(self) -> DataFrame:
        return queues.all_tags(self.spark, self.path)

    def tag_tree(self) -> DataFrame:
        return queues.tag_tree(self.spark, self.path)

    def complete_tag(self, typed: str, limit: int = 20) -> DataFrame:
        tags = base.notes(self.spark, self.path).select(F.explode(tx.tag_list(F.col("tags"))).alias("tag"))
        return merge.complete_tags(tags, typed, limit)

    def _tagged(self, search: str, change) -> DataFrame:  # noqa: ANN001
        notes = base.notes(self.spark, self.path).join(self.find_notes(search), "id", "left_semi")
        old = tx.tag_list(F.col("tags"))
        return notes.withColumn("changed", change(old) != old).withColumn("new_tags", F.when(F.col("changed"), tx.joined_tags(change(old))).otherwise(F.col("tags")))

    def add_tags(self, search: str, tags: list[str]) -> DataFrame:
        return self._tagged(search, lambda t: merge.add_tags(t, tags))

    def remove_tags(self, search: str, tags: list[str]) -> DataFrame:
        return self._tagged(search, lambda t: merge.remove_tags(t, tags))

    def rename_tag(self, old: str, new: str) -> DataFrame:
        return self._tagged("", lambda t: merge.rename_tag(t, old, new))

    def find_and_replace(self, search: str, pattern: str, replacement: str, *, field: int | None = None, ignore_case: bool = True) -> DataFrame:
        notes = base.notes(self.spark, self.path).join(self.find_notes(search), "id", "left_semi")
        return merge.find_and_replace(notes, pattern, replacement, field=field, ignore_case=ignore_case)

    def find_duplicates(self, field: int = 0, search: str = "") -> DataFrame:
        """Texts of a field that several of the notes found have."""
        notes = base.notes(self.spark, self.path).join(self.find_notes(search), "id", "left_semi")
        return stats.duplicate_values(notes, tx.strip_html_keep_media(tx.field_at(F.col("flds"), field)))

    def rendered_cards(self) -> DataFrame:
        return texts.generated(self.spark, self.path)

    # Import, export, SQL.

    def import_text(self, path: str, meta: delimited.Metadata | None = None) -> DataFrame:
        return delimited.read_notes(self.spark, path, meta)

    def import_json(self, path: str) -> DataFrame:
        return packages.read_json_notes(self.spark, path)

    def export_notes(self, path: str, search: str = "", **options: bool) -> None:
        notes = base.notes(self.spark, self.path).join(self.find_notes(search), "id", "left_semi")
        delimited.write_notes(notes, path, **options)

    def export_package(self, path: str, search: str = "", *, with_scheduling: bool = True) -> None:
        packages.write_package(packages.gather(self.collection(), search, base.decks(self.spark, self.path), with_scheduling=with_scheduling), path)

    def export_dataset(self, path: str, min_entries: int = 0) -> int:
        return packages.write_dataset(self.collection(), base.decks(self.spark, self.path), path, min_entries=min_entries)

    def sql(self, text: str, **args) -> DataFrame:  # noqa: ANN003
        """SQL over the views cards, notes, revlog, decks and notetypes; args are named parameters."""
        texts.register(self.spark, self.path)
        return self.spark.sql(text, args=args or None)

    def pages(self, df: DataFrame, max_bytes: int = 1 << 20) -> Iterator[pa.Table]:
        return packages.pages(df, max_bytes)
