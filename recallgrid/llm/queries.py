"""Queries of the llm problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm import abuse, formatdup, lookalike, mixing, packing, tokens
from recallgrid.registry import Registry
from recallgrid.session import cut
from recallgrid.tables import table

LLM = Registry()


def names_and_fields(spark: SparkSession, d: str) -> DataFrame:
    media = table(spark, d, "media", "fname").select(F.lit("media").alias("tbl"), F.col("fname").alias("key"), F.col("fname").alias("text"))
    notes = table(spark, d, "notes", "id", "flds").select(F.lit("notes").alias("tbl"), F.col("id").cast("string").alias("key"), F.col("flds").alias("text"))
    return media.unionByName(notes)


FORMS_SQL = f"""
WITH texts AS (
  SELECT DISTINCT 'media' AS tbl, fname AS key, fname AS text FROM media WHERE fname IS NOT NULL
  UNION ALL SELECT DISTINCT 'notes', CAST(id AS VARCHAR), flds FROM notes WHERE flds IS NOT NULL),
forms AS ({lookalike.steps_sql('texts')})
"""


@LLM.query("p1_found", FORMS_SQL + "SELECT a.tbl, a.key AS key_a, b.key AS key_b FROM forms a JOIN forms b ON a.tbl = b.tbl AND a.form = b.form AND a.key < b.key AND a.text <> b.text")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_pairs(names_and_fields(spark, d))


@LLM.query("p1_classes", FORMS_SQL + """
SELECT tbl, key, class_id, n_members, n_members - same AS n_links
FROM (SELECT tbl, key, md5(form) AS class_id, count(*) OVER (PARTITION BY tbl, form) AS n_members, count(*) OVER (PARTITION BY tbl, form, text) AS same FROM forms) WHERE n_members > same""")
def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per name or note that looks like another one, with its class and number of links."""
    return lookalike.look_alike_classes(names_and_fields(spark, d))


@LLM.query("p1_forms", FORMS_SQL + "SELECT tbl, key, form FROM forms")
def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every file name and note in the consistent form."""
    return lookalike.consistent_form(names_and_fields(spark, d).where(F.col("text").isNotNull()).distinct())


def contents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes", "id", "flds").select("id", F.col("flds").alias("text"))


CONTENT_SQL = f"""
WITH rows AS (SELECT DISTINCT id, flds AS text FROM notes WHERE id IS NOT NULL AND flds IS NOT NULL),
contents AS (SELECT DISTINCT id, content FROM ({formatdup.content_sql('rows', '*')})),
firsts AS (SELECT content, min(id) AS first_id, count(*) AS n_copies FROM contents GROUP BY content)
"""


@LLM.query("p4_found", CONTENT_SQL + "SELECT first_id, id AS copy_id FROM contents JOIN firsts USING (content) WHERE id <> first_id")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.copies(contents(spark, d))


@LLM.query("p4_notes", CONTENT_SQL + "SELECT first_id, n_copies, false AS collided FROM firsts")
def p4_notes(spark: SparkSession, d: str) -> DataFrame:
    """One row per content with its number of copies."""
    return formatdup.collapse(contents(spark, d))


def token_table(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of all documents, worked out once: planning, packing and reporting read them again."""
    return cut(tokens.token_counts(table(spark, d, "documents", "doc_id", "source", "text")))


def containers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The containers, and the sizes that went into them."""
    counts = token_table(spark, d)
    return packing.pack(counts, packing.capacities_of(table(spark, d, "pack_capacities"))), counts


@LLM.query("p7_placements")
def p7_placements(spark: SparkSession, d: str) -> DataFrame:
    """Container and place of each text or piece, with the fill of the container."""
    return packing.placements(containers(spark, d)[0])


@LLM.query("p7_fills")
def p7_fills(spark: SparkSession, d: str) -> DataFrame:
    return packing.fills(containers(spark, d)[0])


@LLM.query("p7_summary")
def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    """Containers of each capacity, and the documents without tokens, which are in none."""
    found, counts = containers(spark, d)
    empty = counts.where(F.col("tokens") == 0).agg(F.count(F.lit(1)))
    return packing.summary(found).withColumn("empty_documents", empty.scalar())


def mixes(spark: SparkSession, d: str) -> tuple[DataFrame, list[mixing.Target]]:
    counts = token_table(spark, d)
    targets = mixing.plan(table(spark, d, "mix_targets"), counts)
    return mixing.mix(counts, targets), targets


@LLM.query("p8_uses")
def p8_uses(spark: SparkSession, d: str) -> DataFrame:
    """Number of uses of each document in each mix."""
    return mixes(spark, d)[0]


@LLM.query("p8_shares")
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source in each mix."""
    return mixing.shares(*mixes(spark, d))


def scored(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents", "doc_id", "source", "text")
    model = abuse.fit(abuse.labelled_rows(table(spark, d, "review_examples")), abuse.common_frames(documents))
    return abuse.scores(documents, model)


@LLM.query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


@LLM.query("p9_scores")
def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """A score and the kind of its worst sentence for every document."""
    return scored(spark, d)


@LLM.query("p9_rates")
def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(scored(spark, d))
