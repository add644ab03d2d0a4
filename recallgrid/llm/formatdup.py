"""Problem 4: records that are the same apart from white space, case, punctuation and field order."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.duck import over_partitions
from recallgrid.llm.lookalike import SMALL_BY_CAPITAL, pairs, steps_sql, translate_sql
from recallgrid.operators.skew import join_one_to_many
from recallgrid.session import cut

#: What case folding does beyond small letters.
FOLDS = {"ß": "ss", "ς": "σ", "ſ": "s", "i̇": "i"}
GROUP = ["hash", "check_", "chars"]


@cache
def content_sql(source: str, keep: str) -> str:
    """A query over source (text) that adds content: the sorted, reduced, non-empty fields.

    The consistent form of problem 1 makes look-alikes equal, then case goes. A capital that is drawn like a Latin one
    makes its small letter equal to the Latin small letter, as the two texts are the same by way of the capitals.
    """
    fold = "lower(form)"
    for a, b in FOLDS.items():
        fold = f"replace({fold}, '{a}', '{b}')"
    reduced = f"list_transform(string_split(nfc_normalize({translate_sql('folded', pairs(SMALL_BY_CAPITAL))}), chr(31)), lambda x: regexp_replace(x, '[\\pP\\pZ\\pC\\s]+', '', 'g'))"
    folded = f"SELECT * EXCLUDE (form), {fold} AS folded FROM ({steps_sql(source, 'text', keep)})"
    return f"SELECT * EXCLUDE (folded), array_to_string(list_sort(list_filter({reduced}, lambda x: x <> '')), chr(31)) AS content FROM ({folded})"


def content_hashes(records: DataFrame) -> DataFrame:
    """(id, hash, check_, chars) of records (id, text): 128 bits of the content, 63 bits of another hash, and its length."""
    rows = records.select(F.col("id").cast("bigint").alias("id"), "text").where(F.col("id").isNotNull() & F.col("text").isNotNull())
    sql = f"SELECT id, unhex(md5(content)) AS hash, (hash(content) >> 1)::BIGINT AS check_, length(content)::INTEGER AS chars FROM ({content_sql('part', '*')})"
    # Kept, so that the texts are worked on once and not for each use of their hashes.
    return cut(over_partitions(rows, sql, "id bigint, hash binary, check_ bigint, chars int").distinct())


def groups(hashes: DataFrame) -> DataFrame:
    """One row per content: (hash, check_, chars, first_id, n_copies), counted with map-side combining.

    Two contents with the same 128 bits but another check or length stay apart: that is the collision check.
    """
    return hashes.groupBy(*GROUP).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))


def collapse(records: DataFrame) -> DataFrame:
    """(first_id, n_copies, collided): one row per content; collided marks contents that share their 128 bits with another.

    Defined cases: null ids and null texts are left out; a repeated row is one record; records without any letter, digit
    or symbol have the same, empty, content.
    """
    g = groups(content_hashes(records))
    shared = g.groupBy("hash").agg(F.count(F.lit(1)).alias("contents_")).where(F.col("contents_") > 1)
    return g.join(shared, "hash", "left").select("first_id", "n_copies", F.col("contents_").isNotNull().alias("collided"))


def copies(records: DataFrame) -> DataFrame:
    """(first_id, copy_id): one row for each further copy of a content; first_id is the smallest id.

    Contents with very many copies meet their rows by broadcast of at most 1024 contents, the others by a shuffle.
    """
    hashes = content_hashes(records)
    several = groups(hashes).where(F.col("n_copies") > 1)
    rows = join_one_to_many(hashes, several, GROUP, "n_copies")
    return rows.where(F.col("id") != F.col("first_id")).select("first_id", F.col("id").alias("copy_id"))
