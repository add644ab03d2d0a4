"""The collection as it stands, read from the tables, and the same as common table expressions for the oracle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.model import CLOCK, catalog
from recallgrid.operators import references
from recallgrid.registry import CORE
from recallgrid.search.compile import Collection, find_cards
from recallgrid.tables import latest, seq, table, versions


@dataclass(frozen=True)
class Scope:
    """Cards that statistics are about, and the time since which reviews count."""

    ids: DataFrame | None = None
    since_ms: int | None = None


_SCOPE: ContextVar[Scope] = ContextVar("scope", default=Scope())


@contextmanager
def scope(spark: SparkSession, d: str, search: str = "", days: int = 0) -> Iterator[None]:
    """Inside, cards() and revlog() hold the cards of a search and their reviews of the last days; 0: all.

    A blank search also keeps the reviews of deleted cards.
    """
    ids = find_cards(collection(spark, d), search) if search.strip() else None
    token = _SCOPE.set(Scope(ids, (CLOCK.next_day_at - (days + 1) * 86_400) * 1000 if days > 0 else None))
    try:
        yield
    finally:
        _SCOPE.reset(token)


def graves(spark: SparkSession, d: str, kind: int) -> DataFrame:
    return table(spark, d, "graves", "oid", "type", "usn").where(F.col("type") == kind)


def standing(spark: SparkSession, d: str, name: str, kind: int) -> DataFrame:
    """The rows of a table that stand: the last version of each id, unless a delete of its kind has a later usn.

    Of versions with equal usn the one with the latest mod stands; of those with equal mod the one further down the file.
    """
    rows = versions(spark, d, name)
    rows = latest(rows.withColumn("seq_", seq(F.col("usn"))), "id", F.col("seq_"), F.col("mod"), F.col("at_"))
    gone = graves(spark, d, kind).where(F.col("oid").isNotNull()).groupBy(F.col("oid").alias("oid_")).agg(F.max(seq(F.col("usn"))).alias("gone_"))
    live = rows.join(gone, F.col("id") == F.col("oid_"), "left").where(F.col("gone_").isNull() | (F.col("gone_") <= F.col("seq_")))
    return live.drop("seq_", "at_", "oid_", "gone_")


def cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards after all changes of the feed."""
    rows = standing(spark, d, "cards", 0)
    ids = _SCOPE.get().ids
    return rows if ids is None else rows.join(ids, "id", "left_semi")


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Existing notes; null tags are none."""
    return standing(spark, d, "notes", 1).withColumn("tags", F.coalesce("tags", F.lit("")))


def decks(spark: SparkSession, d: str) -> DataFrame:
    return references.existing(table(spark, d, "decks"), graves(spark, d, 2))


REVIEW = ["cid", "usn", "ease", "ivl", "last_ivl", "factor", "time", "type"]


def revlog(spark: SparkSession, d: str) -> DataFrame:
    """Reviews, one row per id; of rows sent again the one with the latest usn. Null time is 0."""
    rows = latest(versions(spark, d, "revlog").withColumn("seq_", seq(F.col("usn"))), "id", F.col("seq_"), F.col("at_"))
    out = rows.select("id", *[F.coalesce(c, F.lit(0)).alias(c) if c == "time" else c for c in REVIEW])
    s = _SCOPE.get()
    if s.since_ms is not None:
        out = out.where(F.col("id") >= s.since_ms)
    return out if s.ids is None else out.join(s.ids.select(F.col("id").alias("cid")), "cid", "left_semi").select("id", *REVIEW)


def collection(spark: SparkSession, d: str) -> Collection:
    names = catalog(decks(spark, d), table(spark, d, "notetypes"), table(spark, d, "notetype_fields"))
    return Collection(cards(spark, d), notes(spark, d), revlog(spark, d), names, CLOCK)


_S = "CASE WHEN {0}usn = -1 THEN 4611686018427387903 ELSE {0}usn END"
BASE_SQL = f"""
WITH cv AS (SELECT DISTINCT *, {_S.format("")} AS s_ FROM cards WHERE id IS NOT NULL),
c AS (SELECT * EXCLUDE (s_, r_) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s_ DESC, mod DESC NULLS LAST) AS r_ FROM cv) q
      WHERE r_ = 1 AND NOT EXISTS (SELECT 1 FROM graves g WHERE g.type = 0 AND g.oid = q.id AND {_S.format("g.")} > q.s_)),
nv AS (SELECT DISTINCT *, {_S.format("")} AS s_ FROM notes WHERE id IS NOT NULL),
n AS (SELECT * EXCLUDE (s_, r_) REPLACE (coalesce(tags, '') AS tags) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s_ DESC, guid DESC, mid DESC NULLS LAST, mod DESC) AS r_ FROM nv) q
      WHERE r_ = 1 AND NOT EXISTS (SELECT 1 FROM graves g WHERE g.type = 1 AND g.oid = q.id AND {_S.format("g.")} > q.s_)),
dv AS (SELECT DISTINCT *, {_S.format("")} AS s_ FROM decks WHERE id IS NOT NULL),
d AS (SELECT * EXCLUDE (s_, r_) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s_ DESC, name DESC, mtime_secs DESC, common DESC NULLS LAST, kind DESC NULLS LAST) AS r_ FROM dv) q
      WHERE r_ = 1 AND NOT EXISTS (SELECT 1 FROM graves g WHERE g.type = 2 AND g.oid = q.id AND {_S.format("g.")} > q.s_)),
r AS (SELECT * EXCLUDE (s_, r_) REPLACE (coalesce(time, 0) AS time) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s_ DESC, cid DESC NULLS LAST, usn DESC, ease DESC, ivl DESC, last_ivl DESC, factor DESC, time DESC NULLS LAST, type DESC) AS r_
      FROM (SELECT *, {_S.format("")} AS s_ FROM revlog WHERE id IS NOT NULL)) WHERE r_ = 1)
"""

Query = Callable[[SparkSession, str], DataFrame]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql runs over c, n, d and r: cards, notes, decks and reviews as they stand."""
    return CORE.query(name, BASE_SQL + sql if sql is not None else None)
