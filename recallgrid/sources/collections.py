"""Whole collections: JSON documents, Parquet packages of a search, data sets of the memory model, pages of rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.functions import text as tx
from recallgrid.operators import hierarchy as hi
from recallgrid.operators import merge
from recallgrid.search.compile import Collection, find_cards

FOREIGN = "default_deck string, default_notetype string, notes array<struct<guid: string, fields: array<string>, tags: array<string>, notetype: string, deck: string>>"


def read_json_notes(spark: SparkSession, path: str) -> DataFrame:
    """(fields, tags, deck, notetype, guid) of documents with a list of notes; defaults come from the document."""
    docs = spark.read.schema(FOREIGN).json(path, multiLine=True)
    rows = docs.select("default_deck", "default_notetype", F.explode("notes").alias("n"))
    none = F.array().cast("array<string>")
    return rows.select(F.coalesce("n.fields", none).alias("fields"), F.coalesce("n.tags", none).alias("tags"), F.coalesce("n.deck", "default_deck").alias("deck"), F.coalesce("n.notetype", "default_notetype").alias("notetype"), F.col("n.guid").alias("guid"))


def gather(col: Collection, search: str, decks: DataFrame, *, with_scheduling: bool = True) -> dict[str, DataFrame]:
    """Cards of a search with their notes, reviews and decks, and all decks above these.

    Without scheduling, reviews stay behind, cards become new, and tags that are about studying go.
    """
    cards = col.cards.join(find_cards(col, search), "id", "left_semi")
    notes = col.notes.join(cards.select(F.col("nid").alias("id")).distinct(), "id", "left_semi")
    used = decks.join(cards.select(F.explode(F.array("did", "odid")).alias("id")).distinct(), "id", "left_semi")
    names = used.select(F.explode(hi.prefixes(hi.path_of(F.col("name"), "\x1f"))).alias("name")).distinct()
    out = {"cards": cards, "notes": notes, "decks": decks.join(names, "name", "left_semi")}
    if with_scheduling:
        return out | {"revlog": col.revlog.join(cards.select(F.col("id").alias("cid")), "cid", "left_semi")}
    zero = {"type": "tinyint", "queue": "tinyint", "ivl": "int", "factor": "int", "reps": "int", "lapses": "int", "left_steps": "int", "odue": "int", "odid": "bigint"}
    out["cards"] = cards.withColumns({k: F.lit(0).cast(t) for k, t in zero.items() if k in cards.columns})
    out["notes"] = notes.withColumn("tags", tx.joined_tags(merge.remove_tags(tx.tag_list(F.col("tags")), ["marked", "leech"])))
    return out


def write_package(frames: dict[str, DataFrame], path: str) -> None:
    """One Parquet folder per table."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def read_package(spark: SparkSession, path: str, names: tuple[str, ...] = ("cards", "notes", "decks", "revlog")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names}


def write_dataset(col: Collection, decks: DataFrame, path: str, *, min_entries: int = 0) -> int:
    """Reviews, cards and decks for work on the memory model, with the clock; an error below min_entries reviews."""
    reviews = col.revlog.where(F.col("ease").between(1, 4) | ((F.col("ease") == 0) & (F.col("factor") == 0)))
    n = reviews.count()
    if n < min_entries:
        raise ValueError(f"{n} reviews, {min_entries} are needed")
    clock = reviews.sparkSession.createDataFrame([(col.clock.next_day_at,)], "next_day_at bigint")
    write_package({"revlog": reviews.repartitionByRange("cid", "id").sortWithinPartitions("cid", "id"), "cards": col.cards.select("id", "nid", "did"), "decks": decks.select("id", "name"), "clock": clock}, path)
    return n


def pages(df: DataFrame, max_bytes: int) -> Iterator[pa.Table]:
    """The rows as Arrow tables of about max_bytes; one partition at a time comes to the driver."""
    names, rows, size = df.columns, [], 0
    for r in df.toLocalIterator(prefetchPartitions=True):
        rows.append(r)
        size += sum(len(x) if isinstance(x, str | bytes) else 8 for x in r)
        if size >= max_bytes:
            yield pa.table({n: [x[i] for x in rows] for i, n in enumerate(names)})
            rows, size = [], 0
    if rows:
        yield pa.table({n: [x[i] for x in rows] for i, n in enumerate(names)})
