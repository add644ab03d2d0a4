"""Review histories for the memory model: which reviews of a card count, gaps between them, training items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid.model import CLOCK as T
from recallgrid.model import DAY
from recallgrid.operators.sliced import SLICE, slice_of, with_previous
from recallgrid.plans import base
from recallgrid.plans.base import query
from recallgrid.plans.stats import count
from recallgrid.session import cut

c = F.col


def is_reset() -> Column:
    return (c("type") == 4) & (c("factor") == 0)


def is_cramming() -> Column:
    return (c("type") == 3) & (c("factor") == 0)


def has_rating() -> Column:
    return c("ease") > 0


def days_ago(id_: Column) -> Column:
    """Whole days from a review to the next rollover; 0 for later ones."""
    return F.greatest(F.floor((F.lit(T.next_day_at) - F.floor(id_ / 1000)) / DAY), F.lit(0)).cast("bigint")


def histories(reviews: DataFrame, *, training: bool, ignore_before_ms: int = 0, width: int = SLICE) -> DataFrame:
    """(cid, id, idx, rating, delta_t, complete): the reviews of each card from which a memory state follows.

    Looking back from the latest review, and passing over cramming: reviews before a reset do not count; the history
    starts with the first of the last unbroken run of rated learning steps. Without such a run there is no history for
    training; for a state it starts with the first rated review of at least a day after the cutoff, and is not complete.
    A card that was not rated since its reset has none. delta_t is the number of days to the review before, 0 at first.

    The scan runs over slices of time, so a card with very many reviews is not held in one task: rows are clustered by card
    and slice once and kept; in a slice it is told what happens if a later slice has, and if it has not, a learning step.
    One row per slice then says which of the two holds, and where the history begins.
    """
    wide = reviews.where(c("cid").isNotNull()).withColumn("slice_", slice_of("id", width))
    graded = has_rating() & (c("id") > ignore_before_ms) & ((c("ivl") >= 1) | (c("ivl") <= -DAY))
    told = {"plain_": ~is_cramming(), "reset_": is_reset(), "learn_": has_rating() & (c("type") == 0), "graded_": graded}
    flags = wide.select("cid", "slice_", "id", c("ease").cast("int").alias("rating"), days_ago(c("id")).alias("day_"), *[F.coalesce(x, F.lit(False)).alias(n) for n, x in told.items()])
    back = Window.partitionBy("cid", "slice_").orderBy(c("id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    live = c("plain_") & (c("resets_") == 0)
    flags = flags.withColumn("resets_", F.count_if("reset_").over(back))
    flags = flags.withColumn("learns_", F.count_if(live & c("learn_")).over(back))
    # Others are reviews that end a run: any but a learning step, once there was a learning step at or after it.
    flags = flags.withColumn("others0_", F.count_if(live & ~c("learn_") & (c("learns_") > 0)).over(back)).withColumn("others1_", F.count_if(live & ~c("learn_")).over(back))
    rows = cut(flags.drop("learns_"))

    def ends(others: Column) -> list[Column]:
        """In a slice: whether the run ends, where it begins, and the first graded review up to the one that ends it."""
        run = F.min(F.when(live & c("learn_") & (others == 0), c("id")))
        return [F.max(live & (others > 0)).alias("stop"), run.alias("run"), F.min(F.when(live & c("graded_") & ((others == 0) | ((others == 1) & ~c("learn_"))), c("id"))).alias("grade")]

    slices = rows.groupBy("cid", "slice_").agg(F.max("reset_").alias("reset_"), F.max(live & c("learn_")).alias("learn_"), F.max("id").alias("latest_"), *[x.alias(f"{n}{k}") for k, others in enumerate((c("others0_"), c("others1_"))) for n, x in zip(("stop", "run", "grade"), ends(others), strict=True)])
    later = Window.partitionBy("cid").orderBy(c("slice_").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("cid")
    slices = slices.withColumn("in_run_", F.coalesce(F.max("learn_").over(later), F.lit(False)))
    for n in ("stop", "run", "grade"):
        slices = slices.withColumn(n, F.when(c("in_run_"), c(f"{n}1")).otherwise(c(f"{n}0")))
    slices = slices.withColumn("over_", F.coalesce(F.max(c("reset_") | c("stop")).over(later), F.lit(False)))
    run, grade = (F.min(F.when(~c("over_"), c(n))).over(whole) for n in ("run", "grade"))
    slices = slices.select("cid", "slice_", run.alias("run_"), grade.alias("grade_"), F.max("latest_").over(whole).alias("latest_"))
    if training:
        starts = slices.where(c("run_") >= ignore_before_ms).select("cid", "slice_", c("run_").alias("from_"), F.lit(True).alias("complete"))
    else:
        # A learning step that is the card's very last review, cramming included, is kept even before the cutoff.
        old = (c("run_") < ignore_before_ms) & (c("run_") < c("latest_"))
        kept_run = F.when(~F.coalesce(old, F.lit(False)), c("run_"))
        starts = slices.select("cid", "slice_", F.coalesce(kept_run, c("grade_")).alias("from_"), kept_run.isNotNull().alias("complete")).where(c("from_").isNotNull())
    kept = rows.join(starts, ["cid", "slice_"]).where(c("plain_") & (c("rating") > 0) & (c("id") >= c("from_")))
    numbered = with_previous(kept.select("cid", "slice_", "id", "rating", "complete", "day_"), "cid", "id", ["day_"])
    delta = F.coalesce(c("prev_.day_") - c("day_"), F.lit(0)).cast("bigint")
    return numbered.select("cid", "id", c("idx_").cast("bigint").alias("idx"), "rating", delta.alias("delta_t"), "complete")


def histories_sql(training: bool, before: int = 0) -> str:
    """The same by running flags over each card."""
    start = (
        f"SELECT cid, run_ AS from_, true AS complete FROM starts WHERE run_ IS NOT NULL AND run_ >= {before}"
        if training
        else f"SELECT cid, coalesce(CASE WHEN NOT (run_ < {before} AND run_ < latest_) THEN run_ END, grade_) AS from_, coalesce(NOT (run_ < {before} AND run_ < latest_), false) AS complete FROM starts WHERE coalesce(CASE WHEN NOT (run_ < {before} AND run_ < latest_) THEN run_ END, grade_) IS NOT NULL"
    )
    return f"""
, e AS (SELECT *, ease > 0 AND type = 0 AS learn, type = 4 AND factor = 0 AS reset FROM r WHERE cid IS NOT NULL AND NOT (type = 3 AND factor = 0)),
b AS (SELECT *, count(*) FILTER (reset) OVER later AS resets, count(*) FILTER (learn) OVER later AS learns, (SELECT max(id) FROM r a WHERE a.cid = e.cid) AS latest_ FROM e
      WINDOW later AS (PARTITION BY cid ORDER BY id DESC ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, count(*) FILTER (NOT learn AND learns > 0) OVER (PARTITION BY cid ORDER BY id DESC ROWS UNBOUNDED PRECEDING) AS others FROM b WHERE resets = 0),
starts AS (SELECT cid, min(id) FILTER (learn AND others = 0) AS run_, min(id) FILTER (ease > 0 AND id > {before} AND (ivl >= 1 OR ivl <= -86400) AND (others = 0 OR (others = 1 AND NOT learn))) AS grade_, max(latest_) AS latest_ FROM o GROUP BY cid),
s AS ({start}),
k AS (SELECT e.cid, e.id, CAST(e.ease AS INTEGER) AS rating, s.complete, greatest(CAST(floor(({T.next_day_at} - e.id // 1000) / 86400.0) AS BIGINT), 0) AS day_ FROM e JOIN s ON e.cid = s.cid WHERE e.id >= s.from_ AND e.ease > 0),
h AS (SELECT cid, id, row_number() OVER w AS idx, rating, coalesce(lag(day_) OVER w - day_, 0) AS delta_t, complete FROM k WINDOW w AS (PARTITION BY cid ORDER BY id))
"""


BEFORE = (T.next_day_at - 60 * DAY) * 1000


@query("f8_training_reviews", histories_sql(True) + "SELECT * FROM h")
def training_reviews(spark: SparkSession, d: str) -> DataFrame:
    return histories(base.revlog(spark, d), training=True)


@query("f8_state_reviews", histories_sql(False, BEFORE) + "SELECT * FROM h")
def state_reviews(spark: SparkSession, d: str) -> DataFrame:
    """The histories for memory states, with a cutoff."""
    return histories(base.revlog(spark, d), training=False, ignore_before_ms=BEFORE)


@query("f9_training_items", histories_sql(True) + "SELECT id, cid, idx AS n_reviews FROM h WHERE idx >= 2 AND delta_t > 0")
def training_items(spark: SparkSession, d: str) -> DataFrame:
    """Training items: the first n_reviews reviews of f8_training_reviews of the card, up to a review on a later day.

    Items are named by their length instead of repeating all reviews so far: a card with n reviews has n rows, not n^2.
    """
    return histories(base.revlog(spark, d), training=True).where((c("idx") >= 2) & (c("delta_t") > 0)).select("id", "cid", c("idx").alias("n_reviews")).orderBy("id")


@query("f11_last_review_info", """
, e AS (SELECT cid, id, last_ivl, ease, type = 4 AND factor = 0 AS reset, ease > 0 AND NOT (type = 3 AND factor = 0) AS counts FROM r WHERE cid IS NOT NULL),
x AS (SELECT cid, max(id) FILTER (counts) AS id_, max(id) FILTER (reset) AS reset_ FROM e GROUP BY cid)
SELECT x.cid, CASE WHEN id_ > coalesce(reset_, 0) THEN id_ // 1000 END AS reviewed_at, CASE WHEN id_ > coalesce(reset_, 0) AND e.last_ivl >= 0 AND e.ease > 1 THEN e.last_ivl END AS previous_interval
FROM x LEFT JOIN e ON e.cid = x.cid AND e.id = x.id_""")
def last_review_info(spark: SparkSession, d: str) -> DataFrame:
    """Time and earlier interval of the last review that counts since the last reset; one combined aggregate per card."""
    rows = base.revlog(spark, d).where(c("cid").isNotNull())
    counts = has_rating() & ~is_cramming()
    one = rows.groupBy("cid").agg(F.max(F.when(counts, F.struct("id", "last_ivl", "ease"))).alias("l_"), F.max(F.when(is_reset(), c("id"))).alias("reset_"))
    valid = c("l_.id") > F.coalesce("reset_", F.lit(0))
    passed = valid & (c("l_.last_ivl") >= 0) & (c("l_.ease") > 1)
    return one.select("cid", F.when(valid, F.floor(c("l_.id") / 1000)).alias("reviewed_at"), F.when(passed, c("l_.last_ivl")).alias("previous_interval"))


@query("f13_review_kinds", """
SELECT type = 4 AND factor = 0 AS reset, type = 3 AND factor = 0 AS cramming, ease > 0 AS rated, ease > 0 AND NOT (type = 3 AND factor = 0) AS counts, count(*) AS n FROM r GROUP BY 1, 2, 3, 4""")
def review_kinds(spark: SparkSession, d: str) -> DataFrame:
    flags = [is_reset().alias("reset"), is_cramming().alias("cramming"), has_rating().alias("rated"), (has_rating() & ~is_cramming()).alias("counts")]
    return base.revlog(spark, d).groupBy(*flags).agg(count())


@query("w3_review_gaps", f"""
, k AS (SELECT cid, id, greatest(CAST(floor(({T.next_day_at} - id // 1000) / 86400.0) AS BIGINT), 0) AS day_ FROM r WHERE cid IS NOT NULL)
SELECT cid, id, row_number() OVER w AS idx, coalesce(lag(day_) OVER w - day_, 0) AS delta_t FROM k WINDOW w AS (PARTITION BY cid ORDER BY id)""")
def review_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Number of each review in its card and days since the review before."""
    rows = base.revlog(spark, d).select("cid", "id", days_ago(c("id")).alias("day_"))
    out = with_previous(rows, "cid", "id", ["day_"])
    return out.select("cid", "id", c("idx_").cast("bigint").alias("idx"), F.coalesce(c("prev_.day_") - c("day_"), F.lit(0)).cast("bigint").alias("delta_t"))


@query("src5_dataset", "SELECT * FROM r WHERE ease BETWEEN 1 AND 4 OR (ease = 0 AND factor = 0)")
def dataset(spark: SparkSession, d: str) -> DataFrame:
    """Reviews for a data set of the memory model, in card order."""
    return base.revlog(spark, d).where(c("ease").between(1, 4) | ((c("ease") == 0) & (c("factor") == 0))).select("id", *base.REVIEW).orderBy("cid", "id")
