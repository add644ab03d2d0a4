"""Readers for the study tables and the rule for repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rank given to change number -1 (not yet synced), which is later than all others.
PENDING_SEQ = (1 << 62) - 1


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named table; with columns, only those are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def versions(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table with at_, the place of each row in its file."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select("*", F.col("_metadata.row_index").alias("at_"))


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Of the versions of each key the one that is last in order; rows with a null key are left out.

    No column but key and order is needed to rank, so a reader of two columns scans and shuffles no more than these. Each
    task passes on at most one row of a key (a group limit before the exchange), so a key with very many versions is cheap.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[o.desc_nulls_last() for o in order]))
    return rows.where(F.col(key).isNotNull()).withColumn("rank_", rank).where(F.col("rank_") == 1).drop("rank_")


def seq(usn: Column) -> Column:
    """Order of a change number: -1 is the latest, null the earliest."""
    return F.when(usn == -1, F.lit(PENDING_SEQ)).otherwise(F.coalesce(usn.cast("bigint"), F.lit(-PENDING_SEQ)))


def month_of_ms(ms: Column) -> Column:
    """'yyyy-MM' in UTC of a time in epoch milliseconds, independent of the session's time zone."""
    days = F.floor(ms / F.lit(86_400_000)).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM")
