"""Streams over the review log and the card feed (ST1-ST3), run until no file is left, as named queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.plans.base import query
from recallgrid.session import checkpoint_dir
from recallgrid.streaming import reviews as live
from recallgrid.tables import latest, table

c = F.col
HOURS_4 = 4 * 3_600


def ran(stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives until its files are read, with batch_; state and output are in the shared folder."""
    spark = stream.sparkSession
    path = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        # A batch that is run again overwrites its own folder.
        batch.write.mode("overwrite").parquet(f"{path}/out/batch_={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out")


def arriving(spark: SparkSession, d: str) -> DataFrame:
    """The review log as a stream of files."""
    schema = table(spark, d, "revlog").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")
    return live.review_stream(spark, f"{d}/revlog.parquet*", schema).where(c("id").isNotNull())


@query("st1_daily", f"""
SELECT CAST(((id // 1000 - {HOURS_4}) // 86400) * 86400 + {HOURS_4} AS BIGINT) AS day, CASE type WHEN 0 THEN 'learn' WHEN 2 THEN 'relearn' WHEN 3 THEN 'filtered' ELSE CASE WHEN last_ivl < 21 THEN 'young' ELSE 'mature' END END AS kind, count(*) AS n, CAST(sum(time) AS BIGINT) AS ms
FROM r WHERE type NOT IN (4, 5) GROUP BY 1, 2""")
def daily(spark: SparkSession, d: str) -> DataFrame:
    """Reviews and time per day and kind, kept up to date by a stream; the last state of it."""
    rows = ran(live.daily_counts(arriving(spark, d)), "complete")
    return rows.where(c("batch_") == rows.agg(F.max("batch_")).scalar()).select(c("day").cast("bigint").alias("day"), "kind", "n", "ms")


@query("st2_last_reviews", """
, e AS (SELECT cid, id, last_ivl, ease, type = 4 AND factor = 0 AS reset, ease > 0 AND NOT (type = 3 AND factor = 0) AS counts FROM r WHERE cid IS NOT NULL),
x AS (SELECT cid, max(id) FILTER (counts) AS id_, max(id) FILTER (reset) AS reset_ FROM e GROUP BY cid)
SELECT x.cid, CASE WHEN id_ > coalesce(reset_, 0) THEN id_ // 1000 END AS reviewed_at, CASE WHEN id_ > coalesce(reset_, 0) AND e.last_ivl >= 0 AND e.ease > 1 THEN e.last_ivl END AS previous_interval
FROM x LEFT JOIN e ON e.cid = x.cid AND e.id = x.id_""")
def last_states(spark: SparkSession, d: str) -> DataFrame:
    """The last review of each card that counts, as a stream of card states leaves it."""
    return latest(ran(live.last_reviews(arriving(spark, d)), "update"), "cid", c("batch_")).select("cid", "reviewed_at", "previous_interval")


@query("st3_upserted", "SELECT id, usn, mod FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY mod DESC, usn DESC) AS k FROM (SELECT DISTINCT id, usn, mod FROM cards)) WHERE k = 1")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    """Whole versions of cards applied to a table as they arrive."""
    path = f"{checkpoint_dir(spark)}/upserts-{uuid.uuid4().hex}"
    stream = spark.readStream.schema("id bigint, usn int, mod bigint").parquet(f"{d}/cards.parquet*")
    live.upsert_stream(stream, f"{path}/table", f"{path}/state").awaitTermination()
    versions = spark.read.option("basePath", f"{path}/table").parquet(f"{path}/table/v*").select("*", F.regexp_extract(c("_metadata.file_path"), r"/v(\d+)/", 1).cast("int").alias("v_"))
    return versions.where(c("v_") == versions.agg(F.max("v_")).scalar()).select("id", "usn", "mod")
