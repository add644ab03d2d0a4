"""Statistics over cards and reviews: each is one aggregate over a base frame, never a collected list of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid.functions import memory as mem
from recallgrid.functions import text as tx
from recallgrid.model import CLOCK as T
from recallgrid.model import DAY
from recallgrid.operators.skew import join_one_to_many
from recallgrid.plans import base
from recallgrid.plans.base import query
from recallgrid.tables import table

MATURE_IVL = 21
NDA = T.next_day_at
TODAY_MS = T.today_ms
c = F.col


def count(name: str = "n") -> Column:
    return F.count(F.lit(1)).cast("bigint").alias(name)


def n_if(condition: Column, name: str) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).cast("bigint").alias(name)


def truncated(x: Column) -> Column:
    """Towards zero."""
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("bigint")


def secs(id_: str = "id") -> Column:
    return F.floor(c(id_) / 1000).cast("bigint")


def answered() -> Column:
    """A review counts unless it was entered by hand or by rescheduling."""
    return ~c("type").isin(4, 5)


def scheduled() -> Column:
    """Rated, and not a cram review of a filtered deck."""
    return (c("ease") > 0) & ~((c("type") == 3) & (c("factor") == 0))



@query("g1_added", f"SELECT CAST(ceil((id // 1000 - {NDA}) / 86400.0) AS BIGINT) AS day, count(*) AS n FROM c GROUP BY 1")
def added(spark: SparkSession, d: str) -> DataFrame:
    """Cards added per day, 0 being today."""
    day = F.ceil((secs() - NDA) / float(DAY)).cast("bigint").alias("day")
    return base.cards(spark, d).groupBy(day).agg(count())


def _reviews_sql() -> str:
    kinds = {"learn": "type = 0", "relearn": "type = 2", "young": "type = 1 AND last_ivl < 21", "mature": "type = 1 AND last_ivl >= 21", "filtered": "type = 3"}
    cols = ", ".join(f"count(*) FILTER ({w}) AS {k}_n, CAST(coalesce(sum(time) FILTER ({w}), 0) AS BIGINT) AS {k}_ms" for k, w in kinds.items())
    return f"SELECT CAST(trunc((id // 1000 - {NDA}) / 86400.0) AS BIGINT) AS day, {cols} FROM r WHERE type NOT IN (4, 5) GROUP BY 1"


@query("g2_reviews", _reviews_sql())
def reviews(spark: SparkSession, d: str) -> DataFrame:
    """Reviews and time per day by kind; young and mature by the interval before the review."""
    kinds = {"learn": c("type") == 0, "relearn": c("type") == 2, "young": (c("type") == 1) & (c("last_ivl") < MATURE_IVL), "mature": (c("type") == 1) & (c("last_ivl") >= MATURE_IVL), "filtered": c("type") == 3}
    aggs = [a for k, w in kinds.items() for a in (n_if(w, f"{k}_n"), F.coalesce(F.sum(F.when(w, c("time"))), F.lit(0)).cast("bigint").alias(f"{k}_ms"))]
    day = truncated((secs() - NDA) / float(DAY)).alias("day")
    return base.revlog(spark, d).where(answered()).groupBy(day).agg(*aggs)


PERIODS = {"today": (NDA - DAY, NDA), "yesterday": (NDA - 2 * DAY, NDA - DAY), "week": (NDA - 7 * DAY, NDA), "month": (NDA - 30 * DAY, NDA), "year": (NDA - 365 * DAY, NDA), "all_time": (0, NDA)}


def _retention_sql(source: str = "r") -> str:
    rows = ", ".join(f"('{p}', {a}, {b})" for p, (a, b) in PERIODS.items())
    return f"""
SELECT period, count(*) FILTER (last_ivl < 21 AND ease > 1) AS young_passed, count(*) FILTER (last_ivl < 21 AND ease = 1) AS young_failed,
       count(*) FILTER (last_ivl >= 21 AND ease > 1) AS mature_passed, count(*) FILTER (last_ivl >= 21 AND ease = 1) AS mature_failed
FROM (VALUES {rows}) p(period, a, b) LEFT JOIN (
  SELECT id // 1000 AS s, last_ivl, ease FROM {source} WHERE ease > 0 AND NOT (type = 3 AND factor = 0) AND (type = 1 OR last_ivl <= -86400 OR last_ivl >= 1)) x
  ON x.s >= p.a AND x.s < p.b GROUP BY period"""


def true_retention(reviews_: DataFrame) -> DataFrame:
    """Reviews passed and failed by young and mature cards in six periods; all periods in one pass over the reviews."""
    counted = reviews_.where(scheduled() & ((c("type") == 1) | (c("last_ivl") <= -DAY) | (c("last_ivl") >= 1)))
    young, passed = c("last_ivl") < MATURE_IVL, c("ease") > 1
    kinds = {"young_passed": young & passed, "young_failed": young & ~passed, "mature_passed": ~young & passed, "mature_failed": ~young & ~passed}
    aggs = [n_if(w & (secs() >= a) & (secs() < b), f"{p}|{k}") for p, (a, b) in PERIODS.items() for k, w in kinds.items()]
    one = counted.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(p).alias("period"), *[c(f"{p}|{k}").alias(k) for k in kinds]) for p in PERIODS])
    return one.select(F.inline(rows))


@query("g3_true_retention", _retention_sql())
def g3(spark: SparkSession, d: str) -> DataFrame:
    return true_retention(base.revlog(spark, d))


RANGES = {"one_month": 30, "three_months": 90, "one_year": 365, "all_time": None}


def _in_range(name: str) -> Column:
    days = RANGES[name]
    return F.lit(True) if days is None else secs() >= NDA - DAY * days


def _range_rows(df: DataFrame, keys: list, condition: Column | None = None) -> DataFrame:
    """df with a row for each nested range that a review is in."""
    names = F.filter(F.array(*[F.when(_in_range(r), F.lit(r)) for r in RANGES]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(names).alias("range"))


RANGES_SQL = f"(VALUES ('one_month', {NDA - DAY * 30}), ('three_months', {NDA - DAY * 90}), ('one_year', {NDA - DAY * 365}), ('all_time', -9000000000000)) p(range, a)"


@query("g4_buttons", f"""
SELECT range, CASE WHEN type <> 1 THEN 'learning' WHEN last_ivl < 21 THEN 'young' ELSE 'mature' END AS bucket, CAST(ease AS INTEGER) AS button, count(*) AS n
FROM r JOIN {RANGES_SQL} ON r.id // 1000 >= p.a WHERE type NOT IN (4, 5) AND ease BETWEEN 1 AND 4 GROUP BY ALL""")
def buttons(spark: SparkSession, d: str) -> DataFrame:
    """Answer buttons by learning, young and mature in four nested ranges."""
    bucket = F.when(c("type") != 1, "learning").when(c("last_ivl") < MATURE_IVL, "young").otherwise("mature").alias("bucket")
    rows = base.revlog(spark, d).where(answered() & c("ease").between(1, 4))
    # Combined before the ranges multiply the rows: one row per bucket, button and narrowest range.
    narrow = F.coalesce(*[F.when(_in_range(r), F.lit(i)) for i, r in enumerate(RANGES)]).alias("at")
    few = rows.groupBy(bucket, c("ease").cast("int").alias("button"), narrow).agg(count("k"))
    names = F.array(*[F.lit(r) for r in RANGES])
    wide = few.select("bucket", "button", "k", F.explode(F.slice(names, c("at") + 1, len(RANGES) - c("at"))).alias("range"))
    return wide.groupBy("range", "bucket", "button").agg(F.sum("k").cast("bigint").alias("n"))


@query("g5_hours", f"""
SELECT range, CAST((id // 1000 // 3600) % 24 AS INTEGER) AS hour, count(*) AS total, count(*) FILTER (ease > 1) AS correct
FROM r JOIN {RANGES_SQL} ON r.id // 1000 >= p.a WHERE type NOT IN (3, 4, 5) GROUP BY ALL""")
def hours(spark: SparkSession, d: str, offset_secs: int = 0) -> DataFrame:
    """Reviews and correct ones by local hour in four nested ranges."""
    hour = (F.floor((secs() + offset_secs) / 3600) % 24).cast("int").alias("hour")
    narrow = F.coalesce(*[F.when(_in_range(r), F.lit(i)) for i, r in enumerate(RANGES)]).alias("at")
    few = base.revlog(spark, d).where(~c("type").isin(3, 4, 5)).groupBy(hour, narrow).agg(count("t"), n_if(c("ease") > 1, "k"))
    names = F.array(*[F.lit(r) for r in RANGES])
    wide = few.select("hour", "t", "k", F.explode(F.slice(names, c("at") + 1, len(RANGES) - c("at"))).alias("range"))
    return wide.groupBy("range", "hour").agg(F.sum("t").cast("bigint").alias("total"), F.sum("k").cast("bigint").alias("correct"))


@query("g6_today", f"""
SELECT count(*) AS answers, CAST(coalesce(sum(time), 0) AS BIGINT) AS millis, count(*) FILTER (ease > 1) AS correct, count(*) FILTER (last_ivl >= 21) AS mature,
       count(*) FILTER (last_ivl >= 21 AND ease > 1) AS mature_correct, count(*) FILTER (type = 0) AS learn, count(*) FILTER (type = 1) AS review,
       count(*) FILTER (type = 2) AS relearn, count(*) FILTER (type = 3) AS early
FROM r WHERE id >= {TODAY_MS} AND type NOT IN (4, 5)""")
def today(spark: SparkSession, d: str) -> DataFrame:
    rows = base.revlog(spark, d).where((c("id") >= TODAY_MS) & answered())
    mature = c("last_ivl") >= MATURE_IVL
    kinds = [n_if(c("type") == i, k) for i, k in enumerate(("learn", "review", "relearn", "early"))]
    return rows.agg(count("answers"), F.coalesce(F.sum("time"), F.lit(0)).cast("bigint").alias("millis"), n_if(c("ease") > 1, "correct"), n_if(mature, "mature"), n_if(mature & (c("ease") > 1), "mature_correct"), *kinds)


@query("g7_intervals", "SELECT ivl, count(*) AS n FROM c WHERE type IN (2, 3) GROUP BY ivl")
def intervals(spark: SparkSession, d: str) -> DataFrame:
    return base.cards(spark, d).where(c("type").isin(2, 3)).groupBy("ivl").agg(count())


# DuckDB's -> on broken JSON raises; try_cast makes such documents null.
JSON = "CASE WHEN json_valid(data) THEN data END"
NUM = "TRY_CAST(json_extract_string(" + JSON + ", '$.{0}') AS DOUBLE)"
STATE = f"{NUM.format('s')} IS NOT NULL AND {NUM.format('d')} IS NOT NULL"


@query("g8_stability", f"SELECT CAST(round({NUM.format('s')}) AS BIGINT) AS stability, count(*) AS n FROM c WHERE {STATE} GROUP BY 1")
def stability(spark: SparkSession, d: str) -> DataFrame:
    return base.cards(spark, d).where(mem.has_state(c("data"))).groupBy(F.round(mem.number(c("data"), "s")).cast("bigint").alias("stability")).agg(count())


NORM_D = f"(({NUM.format('d')} - 1) / 9)"


@query("g9_eases", f"SELECT CAST(factor // 10 AS BIGINT) AS ease, count(*) AS n FROM c WHERE NOT ({STATE}) AND type IN (2, 3) GROUP BY 1")
def eases(spark: SparkSession, d: str) -> DataFrame:
    """Ease of review cards without a memory state, in tenths."""
    rows = base.cards(spark, d).where(~mem.has_state(c("data")) & c("type").isin(2, 3))
    return rows.groupBy(F.floor(c("factor") / 10).cast("bigint").alias("ease")).agg(count())


@query("g9_difficulty", f"SELECT CAST(CASE WHEN {NORM_D} * 100 >= 100 THEN 99 ELSE floor({NORM_D} * 100) END AS INTEGER) AS bin, count(*) AS n FROM c WHERE {STATE} GROUP BY 1")
def difficulty(spark: SparkSession, d: str) -> DataFrame:
    x = mem.normalized_difficulty(mem.number(c("data"), "d")) * 100
    return base.cards(spark, d).where(mem.has_state(c("data"))).groupBy(mem.percent_bin(x, 1).alias("bin")).agg(count())


@query("g9_medians", f"""
SELECT round(coalesce(median(factor) FILTER (NOT ({STATE}) AND type IN (2, 3)), 0) / 10.0, 6) AS ease, round(coalesce(median({NORM_D}) FILTER ({STATE}), 0) * 100, 6) AS difficulty FROM c""")
def medians(spark: SparkSession, d: str) -> DataFrame:
    """Exact medians, 0 where there is nothing."""
    has = mem.has_state(c("data"))
    ease = F.median(F.when(~has & c("type").isin(2, 3), c("factor")))
    diff = F.median(F.when(has, mem.normalized_difficulty(mem.number(c("data"), "d"))))
    return base.cards(spark, d).agg(F.round(F.coalesce(ease, F.lit(0)) / 10, 6).alias("ease"), F.round(F.coalesce(diff, F.lit(0)) * 100, 6).alias("difficulty"))


DUE = "(CASE WHEN odue <> 0 THEN odue ELSE due END)"
DECAY = f"coalesce({NUM.format('decay')}, 0.5)"
LRT = f"TRY_CAST(json_extract_string({JSON}, '$.lrt') AS BIGINT)"
ELAPSED = f"(CASE WHEN {LRT} IS NOT NULL THEN greatest({T.now} - {LRT}, 0) WHEN {DUE} > 365000 THEN greatest({T.now} - ({DUE} - ivl), 0) ELSE greatest({T.days_elapsed} - ({DUE} - ivl), 0) * 86400 END)"
R_SQL = f"pow(1.0 + (pow(0.9, -1.0 / {DECAY}) - 1) * ({ELAPSED} / 86400.0) / {NUM.format('s')}, -{DECAY})"


def true_due() -> Column:
    return F.when(c("odue") != 0, c("odue")).otherwise(c("due"))


def with_retrievability(cards: DataFrame) -> DataFrame:
    return cards.withColumn("r", mem.retrievability(c("data"), true_due(), c("ivl"), T))


@query("g11_retrievability", f"""
SELECT CAST(CASE WHEN x >= 100 THEN 99 ELSE floor(x) END AS INTEGER) AS bin, count(*) AS n FROM (SELECT round({R_SQL} * 100, 6) AS x FROM c WHERE {STATE}) GROUP BY 1""")
def retrievability(spark: SparkSession, d: str) -> DataFrame:
    rows = with_retrievability(base.cards(spark, d)).where(c("r").isNotNull())
    return rows.groupBy(mem.percent_bin(F.round(c("r") * 100, 6), 1).alias("bin")).agg(count())


@query("g11_retrievability_totals", f"""
, x AS (SELECT nid, CASE WHEN {STATE} THEN {R_SQL} END AS r FROM c)
SELECT round((SELECT avg(r) FROM x) * 100, 6) AS average, round((SELECT sum(r) FROM x), 4) AS sum_by_card,
       round((SELECT sum(v) FROM (SELECT coalesce(sum(r), 0) / count(*) AS v FROM x GROUP BY nid)), 4) AS sum_by_note""")
def retrievability_totals(spark: SparkSession, d: str) -> DataFrame:
    """Average over cards with a state, sum by card, and sum by note; a card without a state counts as 0 in its note."""
    by_note = with_retrievability(base.cards(spark, d)).groupBy("nid").agg(F.sum("r").alias("s"), F.count("r").alias("k"), count("n"))
    total, k = F.sum("s"), F.sum("k")
    by = F.sum(F.coalesce("s", F.lit(0.0)) / c("n"))
    return by_note.agg(F.round(total / k * 100, 6).alias("average"), F.round(total, 4).alias("sum_by_card"), F.round(by, 4).alias("sum_by_note"))


DUE_DAY_SQL = f"CAST(CASE WHEN {DUE} > 1000000000 THEN trunc(({DUE} - {NDA}) / 86400.0) ELSE {DUE} - {T.days_elapsed} END AS BIGINT)"


def due_day() -> Column:
    return F.when(true_due() > mem.DUE_IS_TIME, truncated((true_due() - NDA) / float(DAY))).otherwise((true_due() - T.days_elapsed).cast("bigint"))


@query("g12_future_due", f"SELECT {DUE_DAY_SQL} AS day, count(*) AS n FROM c WHERE type <> 0 AND queue <> -1 AND NOT ({DUE_DAY_SQL} <= 0 AND queue IN (-2, -3)) GROUP BY 1")
def future_due(spark: SparkSession, d: str) -> DataFrame:
    """Cards due per day; buried ones only in the future."""
    rows = base.cards(spark, d).where((c("type") != 0) & (c("queue") != -1)).withColumn("day", due_day())
    return rows.where(~((c("day") <= 0) & c("queue").isin(-2, -3))).groupBy("day").agg(count())


@query("g12_load", f"""
SELECT CAST(floor(coalesce(sum(1.0 / greatest(ivl, 1)), 0) + 1e-9) AS BIGINT) AS daily_load, coalesce(bool_or({DUE_DAY_SQL} < 0 AND queue NOT IN (-2, -3)), false) AS have_backlog
FROM c WHERE type <> 0 AND queue <> -1""")
def load(spark: SparkSession, d: str) -> DataFrame:
    """Expected reviews per day, truncated, and whether anything is overdue; buried cards count for the load."""
    rows = base.cards(spark, d).where((c("type") != 0) & (c("queue") != -1))
    daily = F.floor(F.coalesce(F.sum(1.0 / F.greatest(c("ivl"), F.lit(1))), F.lit(0.0)) + F.lit(1e-9)).cast("bigint")
    return rows.agg(daily.alias("daily_load"), F.coalesce(F.bool_or((due_day() < 0) & ~c("queue").isin(-2, -3)), F.lit(False)).alias("have_backlog"))


_COUNTS = {"new": "type = 0", "learn": "type = 1", "young": "type = 2 AND ivl < 21", "mature": "type = 2 AND ivl >= 21", "relearn": "type = 3"}


@query("g13_card_counts", "SELECT 'including' AS variant, " + ", ".join(f"count(*) FILTER ({w}) AS {k}" for k, w in _COUNTS.items()) + ", CAST(0 AS BIGINT) AS suspended, CAST(0 AS BIGINT) AS buried FROM c UNION ALL SELECT 'excluding', "
       + ", ".join(f"count(*) FILTER ({w} AND queue >= 0)" for w in _COUNTS.values()) + ", count(*) FILTER (queue = -1), count(*) FILTER (queue IN (-2, -3)) FROM c")
def card_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cards by state, with and without inactive ones."""
    kind = c("type")
    states = {"new": kind == 0, "learn": kind == 1, "young": (kind == 2) & (c("ivl") < MATURE_IVL), "mature": (kind == 2) & (c("ivl") >= MATURE_IVL), "relearn": kind == 3}
    one = base.cards(spark, d).agg(*[n_if(w, f"i_{k}") for k, w in states.items()], *[n_if(w & (c("queue") >= 0), f"e_{k}") for k, w in states.items()], n_if(c("queue") == -1, "suspended"), n_if(c("queue").isin(-2, -3), "buried"))
    zero = F.lit(0).cast("bigint")
    rows = F.array(
        F.struct(F.lit("including").alias("variant"), *[c(f"i_{k}").alias(k) for k in states], zero.alias("suspended"), zero.alias("buried")),
        F.struct(F.lit("excluding").alias("variant"), *[c(f"e_{k}").alias(k) for k in states], c("suspended"), c("buried")),
    )
    return one.select(F.inline(rows))


@query("g14_card_stats", """
SELECT c.id, CAST(min(r.id) // 1000 AS BIGINT) AS first_review, CAST(max(r.id) FILTER (r.ease > 0) // 1000 AS BIGINT) AS latest_review, count(r.id) FILTER (r.ease > 0) AS rated,
       CAST(coalesce(sum(r.time) FILTER (r.ease > 0), 0) AS BIGINT) AS millis, round(coalesce(sum(r.time) FILTER (r.ease > 0) / 1000.0 / count(r.id) FILTER (r.ease > 0), 0), 6) AS average_secs
FROM c LEFT JOIN r ON r.cid = c.id GROUP BY c.id""")
def card_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per card: first and latest review, number and average time of rated answers. Reviews are aggregated before the join,
    so a card with very many reviews is one row there."""
    rated = c("ease") > 0
    per = base.revlog(spark, d).where(c("cid").isNotNull()).groupBy("cid").agg(F.floor(F.min("id") / 1000).alias("first_review"), F.floor(F.max(F.when(rated, c("id"))) / 1000).alias("latest_review"), n_if(rated, "rated"), F.sum(F.when(rated, c("time"))).alias("ms"))
    out = base.cards(spark, d).select("id").join(per, c("id") == c("cid"), "left")
    zero = F.lit(0)
    avg = F.when(c("rated") > 0, c("ms") / 1000.0 / c("rated")).otherwise(F.lit(0.0))
    return out.select("id", "first_review", "latest_review", F.coalesce("rated", zero).alias("rated"), F.coalesce("ms", zero).cast("bigint").alias("millis"), F.round(F.coalesce(avg, F.lit(0.0)), 6).alias("average_secs"))


@query("g15_studied_today", f"SELECT count(*) AS cards, round(coalesce(sum(time) / 1000.0, 0), 6) AS seconds FROM r WHERE id > {TODAY_MS} AND type NOT IN (4, 5)")
def studied_today(spark: SparkSession, d: str) -> DataFrame:
    return base.revlog(spark, d).where((c("id") > TODAY_MS) & answered()).agg(count("cards"), F.round(F.coalesce(F.sum("time") / 1000.0, F.lit(0.0)), 6).alias("seconds"))


HOME = "CASE WHEN c.odid = 0 THEN c.did ELSE c.odid END"
SINCE_MS = TODAY_MS - 6 * DAY * 1000


@query("g16_studied_by_deck", f"SELECT {HOME} AS did, count(DISTINCT r.cid) AS n FROM r JOIN c ON r.cid = c.id WHERE r.id > {SINCE_MS} AND r.ease > 0 AND (r.type < 3 OR r.factor <> 0) GROUP BY 1")
def studied_by_deck(spark: SparkSession, d: str) -> DataFrame:
    """Cards answered in the last week by home deck. Distinct cards come first, so the join is by unique keys."""
    seen = base.revlog(spark, d).where((c("id") > SINCE_MS) & (c("ease") > 0) & ((c("type") < 3) | (c("factor") != 0))).select("cid").distinct()
    return seen.join(base.cards(spark, d), c("cid") == c("id")).groupBy(F.when(c("odid") == 0, c("did")).otherwise(c("odid")).alias("did")).agg(count())


@query("g17_last_review", "SELECT cid, CAST(max(id) // 1000 AS BIGINT) AS secs FROM r WHERE cid IS NOT NULL AND ease BETWEEN 1 AND 4 AND (type <> 3 OR factor <> 0) GROUP BY cid")
def last_review(spark: SparkSession, d: str) -> DataFrame:
    rows = base.revlog(spark, d).where(c("cid").isNotNull() & c("ease").between(1, 4) & ((c("type") != 3) | (c("factor") != 0)))
    return rows.groupBy("cid").agg(F.floor(F.max("id") / 1000).cast("bigint").alias("secs"))


LEARN_CUTOFF = T.now + 1_200


@query("g18_due_counts", f"""
SELECT did, count(*) FILTER (queue = 0) AS new, count(*) FILTER (queue = 2 AND due <= {T.days_elapsed}) AS review, count(*) FILTER (queue = 3 AND due <= {T.days_elapsed}) AS interday,
       count(*) FILTER ((queue = 1 AND due < {LEARN_CUTOFF}) OR (queue = 4 AND due <= {LEARN_CUTOFF})) AS intraday, count(*) AS total FROM c GROUP BY did""")
def due_counts(spark: SparkSession, d: str) -> DataFrame:
    """Due cards by deck; learning counts before the cutoff, previews up to it."""
    q, due = c("queue"), c("due")
    intraday = ((q == 1) & (due < LEARN_CUTOFF)) | ((q == 4) & (due <= LEARN_CUTOFF))
    return base.cards(spark, d).groupBy("did").agg(n_if(q == 0, "new"), n_if((q == 2) & (due <= T.days_elapsed), "review"), n_if((q == 3) & (due <= T.days_elapsed), "interday"), n_if(intraday, "intraday"), count("total"))


@query("g19_deck_due_counts", f"SELECT {HOME} AS did, CASE WHEN odid = 0 THEN due ELSE odue END AS due, count(*) AS n FROM c WHERE type = 2 AND queue <> -1 GROUP BY 1, 2")
def deck_due_counts(spark: SparkSession, d: str) -> DataFrame:
    home, due = F.when(c("odid") == 0, c("did")).otherwise(c("odid")), F.when(c("odid") == 0, c("due")).otherwise(c("odue"))
    return base.cards(spark, d).where((c("type") == 2) & (c("queue") != -1)).groupBy(home.alias("did"), due.alias("due")).agg(count())


@query("g20_congrats", f"""
SELECT count(*) FILTER (queue IN (2, 3) AND due <= {T.days_elapsed}) AS review, count(*) FILTER (queue = 0) AS new, count(*) FILTER (queue = -2) AS sched_buried,
       count(*) FILTER (queue = -3) AS user_buried, count(*) FILTER (queue = 1) AS learn, greatest(0, coalesce(min(due) FILTER (queue = 1), 0)) AS first_learn_due
FROM c WHERE did IN (SELECT id FROM d)""")
def congrats(spark: SparkSession, d: str) -> DataFrame:
    """What is left to study in the existing decks."""
    q, due = c("queue"), c("due")
    active = base.decks(spark, d).select(c("id").alias("did"))
    rows = base.cards(spark, d).join(active, "did", "left_semi")
    first = F.greatest(F.lit(0), F.coalesce(F.min(F.when(q == 1, due)), F.lit(0))).alias("first_learn_due")
    return rows.agg(n_if(q.isin(2, 3) & (due <= T.days_elapsed), "review"), n_if(q == 0, "new"), n_if(q == -2, "sched_buried"), n_if(q == -3, "user_buried"), n_if(q == 1, "learn"), first)


@query("g21_learned_since", f"SELECT count(DISTINCT cid) AS n FROM r WHERE id > {SINCE_MS} AND type = 0 AND cid IN (SELECT id FROM c)")
def learned_since(spark: SparkSession, d: str) -> DataFrame:
    seen = base.revlog(spark, d).where((c("id") > SINCE_MS) & (c("type") == 0)).select("cid").distinct()
    return seen.join(base.cards(spark, d).select(c("id").alias("cid")), "cid", "left_semi").agg(count())


@query("g22_use_counts", "SELECT t.id, t.name, count(n.id) AS n FROM notetypes t LEFT JOIN n ON n.mid = t.id GROUP BY t.id, t.name")
def use_counts(spark: SparkSession, d: str) -> DataFrame:
    """Notes of each note type, 0 included."""
    used = base.notes(spark, d).where(c("mid").isNotNull()).groupBy("mid").agg(count("k"))
    types = table(spark, d, "notetypes", "id", "name").distinct()
    return types.join(used, c("id") == c("mid"), "left").select("id", "name", F.coalesce("k", F.lit(0)).cast("bigint").alias("n"))


@query("g23_highest_ord", "SELECT n.mid, CAST(coalesce(max(c.ord), 0) AS INTEGER) AS ord FROM n LEFT JOIN c ON c.nid = n.id WHERE n.mid IS NOT NULL GROUP BY n.mid")
def highest_ord(spark: SparkSession, d: str) -> DataFrame:
    per_note = base.cards(spark, d).groupBy("nid").agg(F.max("ord").alias("ord"))
    rows = base.notes(spark, d).where(c("mid").isNotNull()).join(per_note, c("id") == c("nid"), "left")
    return rows.groupBy("mid").agg(F.coalesce(F.max("ord"), F.lit(0)).cast("int").alias("ord"))


@query("g24_next_position", "SELECT CAST(coalesce(max(due) + 1, 0) AS BIGINT) AS position FROM c WHERE type = 0")
def next_position(spark: SparkSession, d: str) -> DataFrame:
    return base.cards(spark, d).where(c("type") == 0).agg(F.coalesce(F.max("due") + 1, F.lit(0)).cast("bigint").alias("position"))


@query("g25_sanity_counts", """
SELECT (SELECT count(*) FROM c) AS cards, (SELECT count(*) FROM n) AS notes, (SELECT count(*) FROM r) AS revlog, (SELECT count(*) FROM d) AS decks,
       (SELECT count(DISTINCT id) FROM notetypes) AS notetypes, (SELECT count(DISTINCT (type, oid)) FROM graves) AS graves,
       (SELECT count(*) FROM c WHERE usn = -1) + (SELECT count(*) FROM n WHERE usn = -1) + (SELECT count(*) FROM r WHERE usn = -1) AS pending""")
def sanity_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of all tables and the rows that wait for a sync; one row per table is united, not joined."""
    frames = {"cards": base.cards(spark, d), "notes": base.notes(spark, d), "revlog": base.revlog(spark, d), "decks": base.decks(spark, d), "notetypes": table(spark, d, "notetypes", "id").distinct(), "graves": table(spark, d, "graves", "type", "oid").distinct()}
    parts = [df.agg(F.lit(k).alias("t"), count(), (n_if(c("usn") == -1, "p") if k in ("cards", "notes", "revlog") else F.lit(0).cast("bigint").alias("p"))) for k, df in frames.items()]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.agg(*[F.max(F.when(c("t") == k, c("n"))).alias(k) for k in frames], F.sum("p").cast("bigint").alias("pending"))


@query("g26_media_totals", "SELECT max(usn) AS last_usn, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (size > 0) AS files FROM (SELECT DISTINCT * FROM media)")
def media_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "media").distinct().agg(F.max("usn").alias("last_usn"), F.sum("size").cast("bigint").alias("bytes"), n_if(c("size") > 0, "files"))


FIRST_FIELD = "trim(replace(regexp_replace(split_part(flds, chr(31), 1), '<[^>]*>', '', 'g'), '&nbsp;', ' '))"


def duplicate_values(notes: DataFrame, value: Column) -> DataFrame:
    """(value, n, id): each note whose text another note has, too, with the number of these notes.

    Empty texts are no duplicates. A text that very many notes have meets them by broadcast.
    """
    rows = notes.select(value.alias("value"), "id").where(c("value") != "")
    few = rows.groupBy("value").agg(count("k_")).where(c("k_") > 1).withColumn("n", c("k_"))
    return join_one_to_many(rows, few, ["value"], "k_").select("value", "n", "id")


def first_field() -> Column:
    """Without markup and without blanks of any width at its ends."""
    plain = F.replace(F.regexp_replace(tx.field_at(c("flds"), 0), "<[^>]*>", ""), F.lit("&nbsp;"), F.lit(" "))
    return F.regexp_replace(plain, r"^\p{Zs}+|\p{Zs}+$", "")


@query("g27_find_dupes_notes", f"SELECT value, n, id FROM (SELECT value, count(*) OVER (PARTITION BY value) AS n, id FROM (SELECT {FIRST_FIELD} AS value, id FROM n) WHERE value <> '') WHERE n > 1")
def find_dupes_notes(spark: SparkSession, d: str) -> DataFrame:
    """Every note with the same first field as another, markup aside: one row per note."""
    return duplicate_values(base.notes(spark, d), first_field())


@query("g27_find_dupes", f"SELECT value, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT {FIRST_FIELD} AS value, id FROM n) WHERE value <> '' GROUP BY value HAVING count(*) > 1")
def find_dupes(spark: SparkSession, d: str) -> DataFrame:
    """Notes with the same first field, markup aside; reported by count and bounds, so that a group of any size is one row."""
    return base.notes(spark, d).select(first_field().alias("value"), "id").where(c("value") != "").groupBy("value").agg(count(), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where(c("n") > 1)


@query("g28_chunked_reviews", f"""
SELECT CAST(floor((id // 1000 - {NDA}) / 86400.0 / 7) AS BIGINT) AS week, count(*) FILTER (type = 0) AS learn, count(*) FILTER (type = 1 AND last_ivl < 21) AS young,
       count(*) FILTER (type = 1 AND last_ivl >= 21) AS mature, count(*) FILTER (type = 2) AS lapse, count(*) FILTER (type = 3) AS cram, round(sum(time) / 3600000.0, 6) AS hours
FROM r WHERE type NOT IN (4, 5) GROUP BY 1""")
def chunked_reviews(spark: SparkSession, d: str, chunk: int = 7) -> DataFrame:
    """Reviews in chunks of days by kind, and hours spent."""
    week = F.floor((secs() - NDA) / float(DAY) / chunk).cast("bigint").alias("week")
    k = c("type")
    return base.revlog(spark, d).where(answered()).groupBy(week).agg(n_if(k == 0, "learn"), n_if((k == 1) & (c("last_ivl") < 21), "young"), n_if((k == 1) & (c("last_ivl") >= 21), "mature"), n_if(k == 2, "lapse"), n_if(k == 3, "cram"), F.round(F.sum("time") / 3600000.0, 6).alias("hours"))


@query("g28_days_studied", f"SELECT count(DISTINCT CAST(floor((id // 1000 - {NDA}) / 86400.0) AS BIGINT)) AS days, CAST(floor((min(id) // 1000 - {NDA}) / 86400.0) AS BIGINT) AS first_day FROM r WHERE type NOT IN (4, 5)")
def days_studied(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor((secs() - NDA) / float(DAY)).cast("bigint")
    days = base.revlog(spark, d).where(answered()).select(day.alias("day")).distinct()
    return days.agg(count("days"), F.min("day").alias("first_day"))


@query("g28_hour_breakdown", """
SELECT CAST((id // 1000 // 3600) % 24 AS INTEGER) AS hour, round(count(*) FILTER (ease > 1) * 100.0 / count(*), 6) AS percent, count(*) AS n
FROM r WHERE type IN (0, 1, 2) GROUP BY 1 HAVING count(*) > 30""")
def hour_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy by hour where there are more than 30 reviews."""
    hour = (F.floor(secs() / 3600) % 24).cast("int").alias("hour")
    rows = base.revlog(spark, d).where(c("type").isin(0, 1, 2)).groupBy(hour).agg(n_if(c("ease") > 1, "k"), count())
    return rows.where(c("n") > 30).select("hour", F.round(c("k") * 100.0 / c("n"), 6).alias("percent"), "n")


@query("g28_ease_counts", """
SELECT CASE WHEN type IN (0, 2) THEN 0 WHEN last_ivl < 21 THEN 1 ELSE 2 END AS kind, CAST(CASE WHEN type IN (0, 2) AND ease = 4 THEN 3 ELSE ease END AS INTEGER) AS button, count(*) AS n
FROM r WHERE type IN (0, 1, 2) AND ease > 0 GROUP BY 1, 2""")
def ease_counts(spark: SparkSession, d: str) -> DataFrame:
    """Buttons by learning, young and mature; the fourth button of learning counts as the third."""
    learning = c("type").isin(0, 2)
    kind = F.when(learning, 0).when(c("last_ivl") < 21, 1).otherwise(2).alias("kind")
    button = F.when(learning & (c("ease") == 4), F.lit(3)).otherwise(c("ease")).cast("int").alias("button")
    return base.revlog(spark, d).where(c("type").isin(0, 1, 2) & (c("ease") > 0)).groupBy(kind, button).agg(count())


@query("g28_factors", "SELECT CAST(min(factor) AS INTEGER) AS lo, round(avg(factor), 6) AS mean, CAST(max(factor) AS INTEGER) AS hi FROM c WHERE queue = 2")
def factors(spark: SparkSession, d: str) -> DataFrame:
    return base.cards(spark, d).where(c("queue") == 2).agg(F.min("factor").cast("int").alias("lo"), F.round(F.avg("factor"), 6).alias("mean"), F.max("factor").cast("int").alias("hi"))


@query("g29_cumulative_due", f"""
, g AS (SELECT {DUE_DAY_SQL} AS day, count(*) AS n FROM c WHERE type <> 0 AND queue <> -1 GROUP BY 1)
SELECT day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS total FROM g""")
def cumulative_due(spark: SparkSession, d: str) -> DataFrame:
    """Running total of due cards. The window runs over one row per day, a bounded number."""
    per = base.cards(spark, d).where((c("type") != 0) & (c("queue") != -1)).groupBy(due_day().alias("day")).agg(count())
    return per.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("day")).cast("bigint"))


@query("g31_interval_histogram", ", g AS (SELECT CAST(ivl // 7 AS BIGINT) AS bin, count(*) AS n FROM c WHERE type IN (2, 3) GROUP BY 1) SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS total FROM g")
def interval_histogram(spark: SparkSession, d: str, width: int = 7) -> DataFrame:
    """Intervals in bins, with cumulated totals."""
    per = base.cards(spark, d).where(c("type").isin(2, 3)).groupBy(F.floor(c("ivl") / width).cast("bigint").alias("bin")).agg(count())
    return per.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("bin")).cast("bigint"))


@query("g31_interval_quantiles", "SELECT round(quantile_cont(ivl, 0.5), 6) AS q50, round(quantile_cont(ivl, 0.95), 6) AS q95, CAST(max(ivl) AS BIGINT) AS top FROM c WHERE type IN (2, 3)")
def interval_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact 50 and 95 percent bounds for display; Spark counts equal values together, so memory follows distinct intervals."""
    rows = base.cards(spark, d).where(c("type").isin(2, 3))
    return rows.agg(F.round(F.percentile("ivl", F.lit(0.5)), 6).alias("q50"), F.round(F.percentile("ivl", F.lit(0.95)), 6).alias("q95"), F.max("ivl").cast("bigint").alias("top"))


@query("g32_retention_percent", f"SELECT period, round(CASE WHEN p + f > 0 THEN p * 100.0 / (p + f) END, 6) AS percent FROM (SELECT period, young_passed + mature_passed AS p, young_failed + mature_failed AS f FROM ({_retention_sql()}))")
def retention_percent(spark: SparkSession, d: str) -> DataFrame:
    """Share of passed reviews, null where there are none."""
    t = true_retention(base.revlog(spark, d)).select("period", (c("young_passed") + c("mature_passed")).alias("p"), (c("young_failed") + c("mature_failed")).alias("f"))
    return t.select("period", F.round(F.when(c("p") + c("f") > 0, c("p") * 100.0 / (c("p") + c("f"))), 6).alias("percent"))


@query("g33_calendar", "SELECT CAST(make_timestamp(id // 86400000 * 86400000000) AS DATE) AS date, count(*) AS n FROM r WHERE type NOT IN (4, 5) GROUP BY 1")
def calendar(spark: SparkSession, d: str) -> DataFrame:
    """Reviews per calendar date."""
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c("id") / 86_400_000).cast("int")).alias("date")
    return base.revlog(spark, d).where(answered()).groupBy(date).agg(count())


CONFIG = "TRY_CAST(json_extract_string(CASE WHEN json_valid(kind) THEN kind END, '$.normal.config_id') AS BIGINT)"


@query("g35_decks_per_preset", f"SELECT {CONFIG} AS preset, count(*) AS n FROM d WHERE {CONFIG} IS NOT NULL GROUP BY 1")
def decks_per_preset(spark: SparkSession, d: str) -> DataFrame:
    preset = F.get_json_object("kind", "$.normal.config_id").try_cast("bigint")
    return base.decks(spark, d).select(preset.alias("preset")).where(c("preset").isNotNull()).groupBy("preset").agg(count())


@query("g36_ignored_before", f"SELECT (SELECT count(DISTINCT cid) FROM r WHERE id > {SINCE_MS} AND type = 0 AND cid IN (SELECT id FROM c WHERE type <> 0)) AS included, (SELECT count(*) FROM c WHERE type <> 0) AS total")
def ignored_before(spark: SparkSession, d: str) -> DataFrame:
    """Cards learned since a day, and all cards that are not new."""
    old = base.cards(spark, d).where(c("type") != 0).select(c("id").alias("cid"))
    seen = base.revlog(spark, d).where((c("id") > SINCE_MS) & (c("type") == 0)).select("cid").distinct().withColumn("seen", F.lit(True))
    return old.join(seen, "cid", "left").agg(n_if(c("seen"), "included"), count("total"))


@query("g37_deck_tags", """
SELECT d.id AS did, lower(t.tag) AS tag, count(DISTINCT n.id) AS n FROM c JOIN d ON c.did = d.id JOIN n ON c.nid = n.id,
  (SELECT unnest(list_filter(regexp_split_to_array(n.tags, '[ 　]'), lambda x: x <> '')) AS tag) t GROUP BY 1, 2""")
def deck_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of the notes with cards in a deck, without regard to case."""
    pairs = base.cards(spark, d).join(base.decks(spark, d).select(c("id").alias("did")), "did", "left_semi").select("did", "nid").distinct()
    tags = base.notes(spark, d).select(c("id").alias("nid"), F.explode(F.array_distinct(F.transform(tx.tag_list(c("tags")), F.lower))).alias("tag"))
    return pairs.join(tags, "nid").groupBy("did", "tag").agg(count())
