"""Updates of the cards of a search (M18-M20) as named queries: the rows that change, as they are afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.model import CLOCK as T
from recallgrid.model import Queue
from recallgrid.operators import updates as up
from recallgrid.operators.sliced import numbered
from recallgrid.plans import base
from recallgrid.plans.base import query
from recallgrid.plans.searches import deck_sql
from recallgrid.plans.stats import JSON
from recallgrid.search.compile import search_cards

c = F.col
SHOWN = ["id", "did", "odid", "type", "queue", "due", "odue", "ivl", "factor", "reps", "lapses", "flags"]
FILTERED, DUE = "coalesce(odid, 0) <> 0", "(CASE WHEN coalesce(odid, 0) <> 0 THEN odue ELSE due END)"
QUEUE_SQL = f"CASE WHEN type = 0 THEN 0 WHEN type = 2 THEN 2 WHEN {DUE} > 1000000000 THEN 1 ELSE 3 END"
LEFT = {"did": f"CASE WHEN {FILTERED} THEN odid ELSE did END", "odid": "0", "odue": f"CASE WHEN {FILTERED} THEN 0 ELSE odue END"}


def found(spark: SparkSession, d: str, search: str) -> DataFrame:
    return search_cards(base.collection(spark, d), search).select("c.*")


def changed_sql(condition: str, when: str, values: dict[str, str]) -> str:
    shown = ", ".join(f"CAST({values[x]} AS {'BIGINT' if x in ('id', 'did', 'odid') else 'INTEGER'}) AS {x}" if x in values else x for x in SHOWN)
    return f"SELECT {shown} FROM c WHERE ({condition}) AND ({when})"


def _update(name: str, search: str, condition: str, make: Callable[[], up.Update], when: str, values: dict[str, str]) -> None:
    @query(name, changed_sql(condition, when, values))
    def run(spark: SparkSession, d: str) -> DataFrame:
        return up.apply(found(spark, d, search), make()).select(*SHOWN)


LAW, HISTORY, ALL = deck_sql("law"), deck_sql("history"), "true"
LAST = f"TRY_CAST(json_extract_string({JSON}, '$.lrt') AS BIGINT)"
DUE_DAY = f"CASE WHEN {DUE} > 1000000000 THEN {T.days_elapsed} + CAST(trunc(({DUE} - {T.next_day_at}) / 86400.0) AS INTEGER) ELSE {DUE} END"
NEW_IVL = f"CASE WHEN queue = 0 OR ivl = 0 THEN 0 WHEN {LAST} IS NOT NULL THEN greatest(CAST(floor(({T.next_day_at} - {LAST}) / 86400.0) AS INTEGER), 0) + 5 ELSE greatest(ivl + {T.days_elapsed} + 5 - ({DUE_DAY}), 0) END"
FIRST = f"coalesce(CASE WHEN type = 0 THEN {DUE} ELSE TRY_CAST(json_extract_string({JSON}, '$.pos') AS INTEGER) END, 7)"
HOME = {"did": "odid", "odid": "0", "odue": "0", "due": "CASE WHEN odue <> 0 THEN odue ELSE due END", "queue": f"CASE WHEN queue >= 0 THEN {QUEUE_SQL} ELSE queue END"}
MOVED = {"did": "77", "odid": "0", "odue": f"CASE WHEN {FILTERED} THEN 0 ELSE odue END", "due": f"CASE WHEN {FILTERED} AND odue <> 0 THEN odue ELSE due END", "queue": f"CASE WHEN {FILTERED} AND queue >= 0 THEN {QUEUE_SQL} ELSE queue END"}

_update("m18_suspended", "deck:law", LAW, lambda: up.hold(Queue.SUSPENDED), "queue <> -1", {"queue": "-1"})
_update("m18_buried", "deck:law", LAW, lambda: up.hold(Queue.USER_BURIED), "queue NOT IN (-1, -3)", {"queue": "-3"})
_update("m18_released", "", ALL, up.release, "queue < 0", {"queue": QUEUE_SQL})
_update("m19_reset", "deck:history", HISTORY, lambda: up.reset(7, counts=True, restore=True), "true", LEFT | {"due": FIRST, "type": "0", "queue": "0", "ivl": "0", "factor": "0", "reps": "0", "lapses": "0"})
_update("m19_due_in", "", ALL, lambda: up.due_in(F.lit(5), T.days_elapsed, T.next_day_at, 2500), "true", LEFT | {"ivl": NEW_IVL, "due": str(T.days_elapsed + 5), "type": "2", "queue": "2", "factor": "CASE WHEN factor = 0 THEN 2500 ELSE factor END"})
_update("m19_flagged", "deck:law", LAW, lambda: up.flag(3), "(flags & ~7) | 3 <> flags", {"flags": "(flags & ~7) | 3"})
_update("m19_moved", "deck:history", HISTORY, lambda: up.move(77), "did IS DISTINCT FROM 77", MOVED)
_update("m20_returned", "", ALL, up.return_home, FILTERED, HOME)


POSITIONED = "(SELECT c.*, 100 + 2 * (dense_rank() OVER (ORDER BY nid) - 1) AS place FROM c WHERE type = 0)"


@query("m19_repositioned", changed_sql("true", "true", {"due": f"CASE WHEN {FILTERED} THEN due ELSE place END", "odue": f"CASE WHEN {FILTERED} THEN place ELSE odue END"}).replace("FROM c", f"FROM {POSITIONED}"))
def repositioned(spark: SparkSession, d: str) -> DataFrame:
    """New cards by note, siblings together, from 100 by steps of 2."""
    rows = found(spark, d, "is:new")
    ranks = numbered(rows.select("nid").where(c("nid").isNotNull()).distinct(), "nid", "rank_")
    placed = rows.join(ranks, "nid")
    return up.apply(placed, up.reposition(F.lit(100) + (c("rank_") - 1) * 2)).select(*SHOWN)


ENTERING = f"(SELECT *, row_number() OVER (ORDER BY id) - 100001 AS place FROM c WHERE {LAW} AND queue NOT IN (-1, -2, -3) AND NOT ({FILTERED}) AND odue = 0)"


@query("m20_entered", changed_sql("true", "true", {"odid": "did", "did": "77", "odue": "due", "due": "CASE WHEN due > 0 THEN place ELSE due END", "queue": "2"}).replace("FROM c", f"FROM {ENTERING}"))
def entered(spark: SparkSession, d: str) -> DataFrame:
    """Cards of a search in a filtered deck that does not reschedule, at positions from -100000; places are worked out by
    many tasks."""
    rows = found(spark, d, "deck:law -is:suspended -is:buried").where(~up.is_filtered() & (c("odue") == 0))
    placed = rows.join(numbered(rows.select("id"), "id", "place_"), "id")
    return up.apply(placed, up.enter_filtered(77, c("place_") - 100_001, reschedule=False)).select(*SHOWN)
