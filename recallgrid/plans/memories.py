"""Memory-model functions F1-F7 and F12-F23 over cards as named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.functions import memory as mem
from recallgrid.functions import spans
from recallgrid.model import CLOCK as T
from recallgrid.plans import base
from recallgrid.plans.base import query
from recallgrid.plans.searches import REL_SQL
from recallgrid.plans.stats import DECAY, ELAPSED, JSON, LRT, NUM, R_SQL, STATE, count, true_due

c = F.col


@query("f1_variables", f"SELECT id, {NUM.format('s')} AS s, {NUM.format('d')} AS d, {NUM.format('dr')} AS dr, TRY_CAST(json_extract_string({JSON}, '$.pos') AS INTEGER) AS pos FROM c")
def variables(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the extras of each card; null where they are absent or broken."""
    return base.cards(spark, d).select("id", *[mem.number(c("data"), k).alias(k) for k in ("s", "d", "dr")], mem.original_position(c("data")).alias("pos"))


@query("f2_retrievability", f"SELECT id, round({R_SQL}, 9) AS r FROM c WHERE {STATE}")
def retrievability(spark: SparkSession, d: str) -> DataFrame:
    r = mem.retrievability(c("data"), true_due(), c("ivl"), T)
    return base.cards(spark, d).where(mem.has_state(c("data"))).select("id", F.round(r, 9).alias("r"))


@query("f3_relative_retrievability", f"SELECT id, round({REL_SQL}, 6) AS r FROM c")
def relative(spark: SparkSession, d: str) -> DataFrame:
    r = mem.relative_retrievability(c("data"), true_due(), c("ivl"), T)
    return base.cards(spark, d).select("id", F.round(r, 6).alias("r"))


@query("f6_seconds_since_review", f"SELECT id, CAST({ELAPSED} AS BIGINT) AS secs, {LRT} IS NOT NULL AS known FROM c WHERE type = 2")
def seconds_since(spark: SparkSession, d: str) -> DataFrame:
    known = F.get_json_object("data", "$.lrt").try_cast("bigint").isNotNull()
    return base.cards(spark, d).where(c("type") == 2).select("id", mem.elapsed_seconds(c("data"), true_due(), c("ivl"), T).cast("bigint").alias("secs"), known.alias("known"))


@query("f7_difficulty", f"SELECT id, round(({NUM.format('d')} - 1) / 9, 9) AS difficulty FROM c WHERE {NUM.format('d')} IS NOT NULL")
def difficulty(spark: SparkSession, d: str) -> DataFrame:
    x = mem.number(c("data"), "d")
    return base.cards(spark, d).where(x.isNotNull()).select("id", F.round(mem.normalized_difficulty(x), 9).alias("difficulty"))


_S = "(CASE WHEN x < 2.5 THEN 0 ELSE 1 + 0.15 * greatest(least(x, 7.0) - 2.5, 0) + 0.1 * greatest(least(x, 20.0) - 7.0, 0) + 0.05 * greatest(x - 20.0, 0) END)"


@query("f17_interval_bounds", f"""
, a AS (SELECT id, least(greatest(ivl::DOUBLE, 1), 36500) AS x FROM c WHERE type = 2), b AS (SELECT id, x, least(greatest(round(x - {_S})::INTEGER, 1), 36500) AS lo, least(greatest(round(x + {_S})::INTEGER, 1), 36500) AS hi FROM a)
SELECT id, lo, CASE WHEN lo = hi AND hi > 2 AND hi < 36500 THEN lo + 1 ELSE hi END AS hi FROM b""")
def interval_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The range in which each interval may be varied."""
    lo, hi = spans.bounds(c("ivl"), 1, 36_500)
    return base.cards(spark, d).where(c("type") == 2).select("id", lo.alias("lo"), hi.alias("hi"))


@query("f23_spans", """
SELECT unit, count(*) AS n, round(sum(amount), 3) AS total FROM (SELECT CASE WHEN s >= 31536000 THEN 'years' WHEN s >= 2628000 THEN 'months' WHEN s >= 86400 THEN 'days' WHEN s >= 3600 THEN 'hours' WHEN s >= 60 THEN 'minutes' ELSE 'seconds' END AS unit,
  s / (CASE WHEN s >= 31536000 THEN 31536000 WHEN s >= 2628000 THEN 2628000 WHEN s >= 86400 THEN 86400 WHEN s >= 3600 THEN 3600 WHEN s >= 60 THEN 60 ELSE 1 END)::DOUBLE AS amount FROM (SELECT abs(CASE WHEN ivl < 0 THEN -ivl ELSE ivl * 86400 END)::DOUBLE AS s FROM r)) GROUP BY unit""")
def interval_spans(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of reviews by the unit in which they are shown; below 0 they are seconds."""
    secs = F.abs(F.when(c("ivl") < 0, -c("ivl")).otherwise(c("ivl") * 86_400)).cast("double")
    rows = base.revlog(spark, d).select(spans.span(secs).alias("s"))
    return rows.groupBy(c("s.unit").alias("unit")).agg(count(), F.round(F.sum("s.amount"), 3).alias("total"))


@query("g34_workload", f"""
, s AS (SELECT {NUM.format('s')} AS s, {DECAY} AS decay FROM c WHERE {STATE} AND type = 2), w AS (SELECT unnest(range(70, 100)) AS retention)
SELECT CAST(retention AS INTEGER) AS retention, round(sum(1.0 / greatest(s / (pow(0.9, -1.0 / decay) - 1) * (pow(retention / 100.0, -1.0 / decay) - 1), 1)), 4) AS reviews_per_day FROM s, w GROUP BY 1""")
def workload(spark: SparkSession, d: str) -> DataFrame:
    """Expected reviews per day of the review cards, if each came when its chance to be remembered falls to a retention.

    All thirty sums are worked out in one pass over the cards; rows are not multiplied.
    """
    s, decay = mem.number(c("data"), "s"), F.coalesce(mem.number(c("data"), "decay"), F.lit(mem.DECAY_5))
    rows = base.cards(spark, d).where(mem.has_state(c("data")) & (c("type") == 2)).select(s.alias("s"), decay.alias("k"))

    def per_day(r: int) -> F.Column:
        days = c("s") / (F.pow(F.lit(0.9), F.lit(-1.0) / c("k")) - 1) * (F.pow(F.lit(r / 100), F.lit(-1.0) / c("k")) - 1)
        return F.round(F.sum(F.lit(1.0) / F.greatest(days, F.lit(1.0))), 4)

    one = rows.agg(*[per_day(r).alias(f"r{r}") for r in range(70, 100)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(r).alias("retention"), c(f"r{r}").alias("reviews_per_day")) for r in range(70, 100)]))).where(c("reviews_per_day").isNotNull())
