"""Scans, joins and orders that other plans are made of, as named queries of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid.functions import text as tx
from recallgrid.model import CLOCK as T
from recallgrid.plans import base
from recallgrid.plans.base import query
from recallgrid.plans.queues import interspersed
from recallgrid.plans.searches import FILTERED_ORDERS, HASH_KEY, deck_sql, filtered_cards, in_order, keyed_sql, rank_sql
from recallgrid.plans.stats import HOME, LEARN_CUTOFF, count
from recallgrid.search.compile import search_cards
from recallgrid.tables import table

c = F.col


@query("src1_open", "SELECT 'cards' AS name, count(*) AS n FROM c UNION ALL SELECT 'notes', count(*) FROM n UNION ALL SELECT 'revlog', count(*) FROM r UNION ALL SELECT 'decks', count(*) FROM d")
def opened(spark: SparkSession, d: str) -> DataFrame:
    """The tables of a collection and their sizes."""
    out = None
    for name, df in {"cards": base.cards(spark, d), "notes": base.notes(spark, d), "revlog": base.revlog(spark, d), "decks": base.decks(spark, d)}.items():
        one = df.agg(F.lit(name).alias("name"), count())
        out = one if out is None else out.unionByName(one)
    return out


@query("src3_cards_of_search", f"SELECT c.id, c.nid, c.did, c.due FROM c WHERE {deck_sql('medicine')} AND c.type IN (2, 3)")
def cards_of_search(spark: SparkSession, d: str) -> DataFrame:
    return search_cards(base.collection(spark, d), "deck:medicine is:review").select("c.id", "c.nid", "c.did", "c.due")


@query("src6_due_range", f"SELECT due, count(*) AS n FROM c WHERE queue = 2 AND due >= {T.days_elapsed} AND due < {T.days_elapsed + 1000} GROUP BY due")
def due_range(spark: SparkSession, d: str) -> DataFrame:
    """Cards due in a range of days, by day."""
    return base.cards(spark, d).where((c("queue") == 2) & (c("due") >= T.days_elapsed) & (c("due") < T.days_elapsed + 1000)).groupBy("due").agg(count())


@query("src7_card_entries", f"SELECT id, nid, {HOME} AS did FROM c")
def card_entries(spark: SparkSession, d: str) -> DataFrame:
    """Cards with their home deck."""
    return base.cards(spark, d).select("id", "nid", F.when(c("odid") == 0, c("did")).otherwise(c("odid")).alias("did"))


@query("j1_cards_with_notes", "SELECT c.id, n.mid, n.sfld FROM c JOIN n ON c.nid = n.id")
def cards_with_notes(spark: SparkSession, d: str) -> DataFrame:
    return base.cards(spark, d).select("id", "nid").join(base.notes(spark, d).select(c("id").alias("nid"), "mid", "sfld"), "nid").select("id", "mid", "sfld")


@query("j2_notes_with_cards", "SELECT DISTINCT n.id FROM c JOIN n ON c.nid = n.id")
def notes_with_cards(spark: SparkSession, d: str) -> DataFrame:
    return base.notes(spark, d).select("id").join(base.cards(spark, d).select(c("nid").alias("id")), "id", "left_semi")


@query("j5_deck_ranks", "SELECT c.id, CAST(k.pos AS INTEGER) AS pos FROM c JOIN (SELECT id, row_number() OVER (ORDER BY name, id) AS pos FROM d) k ON k.id = c.did")
def deck_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Cards with the rank of their deck's name; the window runs over decks, a dimension."""
    ranks = base.decks(spark, d).select(c("id").alias("did"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("name", "id")).alias("pos"))
    return base.cards(spark, d).join(ranks, "did").select("id", "pos")


@query("j8_review_bounds", "SELECT c.id, (SELECT min(id) FROM r WHERE r.cid = c.id) AS first, (SELECT max(id) FROM r WHERE r.cid = c.id) AS last FROM c")
def review_bounds(spark: SparkSession, d: str) -> DataFrame:
    """First and last review of each card, aggregated before the join."""
    per = base.revlog(spark, d).where(c("cid").isNotNull()).groupBy("cid").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    return base.cards(spark, d).select("id").join(per, c("id") == c("cid"), "left").select("id", "first", "last")


@query("j10_deck_prefix", "SELECT id, name FROM d WHERE name >= 'Law' || chr(31) AND name < 'Law ' OR name = 'Law'")
def deck_prefix(spark: SparkSession, d: str) -> DataFrame:
    """A deck and those below it, by the prefix of the name, which reaches the scan."""
    return base.decks(spark, d).where((c("name") == "Law") | F.startswith("name", F.lit("Law\x1f"))).select("id", "name")


@query("o2_template_order", rank_sql("SELECT c.id, CASE WHEN t.name LIKE '%cloze%' OR t.config LIKE '%\"cloze\"%' THEN 'Cloze' WHEN c.ord = 1 AND t.name LIKE '%reversed%' THEN 'Card 2' ELSE 'Card 1' END AS template, c.ord FROM c JOIN n ON c.nid = n.id JOIN (SELECT id, min(name) AS name, min(config) AS config FROM notetypes GROUP BY id) t ON t.id = n.mid", "template, ord"))
def template_order(spark: SparkSession, d: str) -> DataFrame:
    """Cards in the order of their templates' names; those of clozes, and those without a template, take the first."""
    col = base.collection(spark, d)
    rows = [(nt.id, i, name) for nt in col.catalog.notetypes for i, name in enumerate(nt.templates)]
    names = spark.createDataFrame(rows, "mid bigint, t_ord int, template string")
    first = names.where(c("t_ord") == 0).select("mid", c("template").alias("first_"))
    both = col.cards.select("id", "nid", "ord").join(col.notes.select(c("id").alias("nid"), "mid"), "nid").join(first, "mid").join(names.withColumnRenamed("t_ord", "ord"), ["mid", "ord"], "left")
    return in_order(both.select("id", F.coalesce("template", "first_").alias("template"), "ord"), [c("template").asc(), c("ord").asc()])


@query("o14_custom_order", rank_sql("SELECT id, reps, lapses FROM c WHERE reps > 0", "lapses / reps DESC"))
def custom_order(spark: SparkSession, d: str, order: tuple[str, ...] = ("lapses / reps desc",)) -> DataFrame:
    """An order given as SQL text."""
    rows = search_cards(base.collection(spark, d), "prop:reps>0").select("c.id", "c.reps", "c.lapses")
    return in_order(rows, [F.expr(o.rsplit(" ", 1)[0]).desc() if o.lower().endswith(" desc") else F.expr(o.removesuffix(" asc")).asc() for o in order])


@query("q5_interspersed", f"""
, a AS (SELECT id, row_number() OVER (ORDER BY due, id) - 1 AS pos FROM (SELECT * FROM c WHERE queue = 2 AND due <= {T.days_elapsed} ORDER BY due, id LIMIT 200)), b AS (SELECT id, row_number() OVER (ORDER BY due, id) - 1 AS pos FROM (SELECT * FROM c WHERE queue = 0 ORDER BY due, id LIMIT 20))
SELECT id, 1 AS source, (pos + 1)::DOUBLE AS place FROM a UNION ALL SELECT id, 2, round((pos + 1) * ((SELECT count(*) FROM a) + 1) / ((SELECT count(*) FROM b) + 1.0), 9) FROM b""")
def mixed_queue(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 reviews and 20 new cards of a day mixed evenly: the limits of a day are the feature."""
    cards = base.cards(spark, d)
    numbered = Window.partitionBy(F.lit(0)).orderBy("due", "id")
    a = cards.where((c("queue") == 2) & (c("due") <= T.days_elapsed)).orderBy("due", "id").limit(200).select("id", (F.row_number().over(numbered) - 1).alias("pos"))
    b = cards.where(c("queue") == 0).orderBy("due", "id").limit(20).select("id", (F.row_number().over(numbered) - 1).alias("pos"))
    n1, n2 = a.count(), b.count()
    return interspersed(a, b, n1, n2).select("id", "source", F.round("place", 9).alias("place"))


def filtered_sql(condition: str, order: str, limit: int = 100) -> str:
    """The first cards of a filtered deck's search in one of its orders."""
    keys = [*FILTERED_ORDERS[order], HASH_KEY]
    rows = keyed_sql(f"(SELECT c.*, NULL AS last_review FROM c WHERE queue NOT IN (-1, -2, -3) AND odid = 0 AND ({condition}))", keys)
    return f"SELECT id FROM ({rows}) WHERE rank <= {limit}"


DUE_NOW = f"(queue IN (2, 3) AND due <= {T.days_elapsed}) OR (queue IN (1, 4) AND due <= {LEARN_CUTOFF})"


@query("q7_filtered_deck", f"""
, a AS (SELECT id, 0 AS term FROM ({filtered_sql(DUE_NOW, 'relative_overdueness')}) UNION ALL SELECT id, 1 FROM ({filtered_sql('lapses >= 1', 'lapses')})), k AS (SELECT id, min(term) AS term FROM a GROUP BY id)
SELECT k.id, term, row_number() OVER (ORDER BY term, c.due, k.id) - 100001 AS position FROM k JOIN c ON c.id = k.id""")
def filtered_deck(spark: SparkSession, d: str, limit: int = 100) -> DataFrame:
    """The cards of a filtered deck of two searches with their positions from -100000; the limit is the feature."""
    first = filtered_cards(spark, d, "is:due", "relative_overdueness", limit).select("id", "due", F.lit(0).alias("term"))
    second = filtered_cards(spark, d, "prop:lapses>=1", "lapses", limit).select("id", "due", F.lit(1).alias("term"))
    rows = first.unionByName(second).groupBy("id").agg(F.min("term").alias("term"), F.first("due").alias("due"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term", "due", "id"))
    return rows.select("id", "term", (place - 100_001).alias("position"))


@query("m30_trimmed_fields", r"SELECT id, array_to_string(list_transform(string_split(flds, chr(31)), lambda f: trim(f, ' ')), chr(31)) AS flds FROM n WHERE array_to_string(list_transform(string_split(flds, chr(31)), lambda f: trim(f, ' ')), chr(31)) <> flds")
def trimmed_fields(spark: SparkSession, d: str) -> DataFrame:
    """A map over all fields of all notes, with the notes that change."""
    new = F.array_join(F.transform(tx.fields_of(c("flds")), lambda f: F.trim(f)), tx.FIELD_SEPARATOR)
    return base.notes(spark, d).select("id", "flds", new.alias("new")).where(c("new") != c("flds")).select("id", c("new").alias("flds"))


@query("m32_config_prefix", "SELECT DISTINCT id, name FROM notetypes WHERE name >= 'Basic' AND name < 'Basid'")
def config_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose key begins with a text: a range that reaches the scan."""
    return table(spark, d, "notetypes", "id", "name").where(F.startswith("name", F.lit("Basic"))).distinct()


@query("g30_period_limits", f"""
, a AS (SELECT CAST(coalesce(ceil(({T.next_day_at} - min(id) / 1000) / 86400), 1) AS BIGINT) AS days FROM c), k AS (SELECT days, CASE WHEN days <= 31 THEN 1 WHEN days <= 365 THEN 7 ELSE 30 END AS chunk FROM a)
SELECT 'month' AS period, 31 AS bars, 1 AS days UNION ALL SELECT 'year', 52, 7 UNION ALL SELECT 'life', CAST(ceil(days / chunk) AS INTEGER), chunk FROM k""")
def period_limits(spark: SparkSession, d: str) -> DataFrame:
    """Number and length in days of the bars of a month, a year and the whole time."""
    days = base.cards(spark, d).agg(F.ceil((T.next_day_at - F.min("id") / 1000) / 86_400)).collect()[0][0] or 1
    chunk = 1 if days <= 31 else 7 if days <= 365 else 30
    return spark.createDataFrame([("month", 31, 1), ("year", 52, 7), ("life", -(-int(days) // chunk), chunk)], "period string, bars int, days int")


@query("i1_grades_by_month", "SELECT strftime(make_timestamp(id // 1000 * 1000000), '%Y-%m') AS month, CAST(ease AS INTEGER) AS ease, count(*) AS n FROM r WHERE type NOT IN (4, 5) GROUP BY 1, 2")
def grades_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Answers by month and button."""
    from recallgrid.tables import month_of_ms

    return base.revlog(spark, d).where(~c("type").isin(4, 5)).groupBy(month_of_ms(c("id")).alias("month"), c("ease").cast("int").alias("ease")).agg(count())
