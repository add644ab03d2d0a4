"""Updates of many cards at once, as assignments of columns with a condition.

An update is a map from column to new value and a condition; what it returns are only the rows that change, with all their
columns, ready for an upsert. Every value is worked out from the row as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.model import CardType, Queue

c = F.col
#: Above this a due value of a learning card is a time, else a day.
DUE_IS_TIME = 1_000_000_000


@dataclass
class Update:
    """New values by column, for the rows that meet the condition."""

    when: Column
    values: dict[str, Column]


def apply(cards: DataFrame, update: Update) -> DataFrame:
    """The rows that the update changes, as they are after it; columns keep their types."""
    types = dict(cards.dtypes)
    rows = cards.where(F.coalesce(update.when, F.lit(False)))
    return rows.select(*[update.values[x].cast(types[x]).alias(x) if x in update.values else c(f"`{x}`") for x in cards.columns])


def is_filtered() -> Column:
    return F.coalesce(c("odid"), F.lit(0)) != 0


def home_due() -> Column:
    return F.when(is_filtered(), c("odue")).otherwise(c("due"))


def queue_of_type(due: Column) -> Column:
    """The queue that a card of a type is in when nothing holds it: learning ones by whether due is a time or a day."""
    learning = F.when(due > DUE_IS_TIME, Queue.LEARN.value).otherwise(Queue.DAY_LEARN.value)
    return F.when(c("type") == CardType.NEW, Queue.NEW.value).when(c("type") == CardType.REVIEW, Queue.REVIEW.value).otherwise(learning)


def hold(queue: Queue) -> Update:
    """Suspend or bury; suspended cards stay suspended, as burying would free them the next day."""
    return Update(~c("queue").isin(queue.value, Queue.SUSPENDED.value), {"queue": F.lit(queue.value)})


def release() -> Update:
    """Back from suspended and buried."""
    return Update(c("queue") < 0, {"queue": queue_of_type(home_due())})


def leave_filtered() -> dict[str, Column]:
    """Deck and original place of a card that leaves its filtered deck because it is scheduled anew."""
    return {"did": F.when(is_filtered(), c("odid")).otherwise(c("did")), "odid": F.lit(0), "odue": F.when(is_filtered(), 0).otherwise(c("odue"))}


def without_keys(data: Column, *keys: str) -> Column:
    """The extras without some entries; broken documents become empty ones."""
    kept = F.map_filter(F.coalesce(F.from_json(data, "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*keys) & v.isNotNull())
    return F.to_json(kept)


def reset(position: int, *, counts: bool, restore: bool) -> Update:
    """Cards become new again, at their first position if that is known and wanted, else at the one given."""
    first = F.when(c("type") == CardType.NEW, home_due()).otherwise(F.get_json_object("data", "$.pos").try_cast("int"))
    due = F.coalesce(first, F.lit(position)) if restore else F.lit(position)
    values = leave_filtered() | {"due": due, "type": F.lit(CardType.NEW.value), "queue": F.lit(Queue.NEW.value), "ivl": F.lit(0), "factor": F.lit(0), "data": without_keys(c("data"), "pos", "s", "d")}
    return Update(F.lit(True), values | ({"reps": F.lit(0), "lapses": F.lit(0)} if counts else {}))


def reposition(position: Column) -> Update:
    """New cards go to a position."""
    new = c("type") == CardType.NEW
    odue = F.when(new & is_filtered(), position).otherwise(c("odue"))
    return Update(new | (c("queue") == Queue.NEW.value), {"odue": odue, "due": F.when(new & is_filtered(), c("due")).otherwise(position)})


def due_in(days: Column, today: int, next_day_at: int, factor: int) -> Update:
    """Cards are due in a number of days, as reviews; the interval moves with the due day, new cards keep none."""
    due, last = home_due(), F.get_json_object("data", "$.lrt").try_cast("bigint")
    due_day = F.when(due > DUE_IS_TIME, F.lit(today) + ((due.cast("bigint") - next_day_at) / 86_400).cast("int")).otherwise(due)
    since = F.greatest(F.floor((F.lit(next_day_at) - last) / 86_400), F.lit(0)) + days
    moved = F.greatest(c("ivl") + (F.lit(today) + days - due_day), F.lit(0))
    interval = F.when((c("queue") == Queue.NEW.value) | (c("ivl") == 0), 0).when(last.isNotNull(), since).otherwise(moved)
    values = leave_filtered() | {"ivl": interval, "due": F.lit(today) + days, "type": F.lit(CardType.REVIEW.value), "queue": F.lit(Queue.REVIEW.value), "factor": F.when(c("factor") == 0, factor).otherwise(c("factor"))}
    return Update(F.lit(True), values)


def flag(number: int) -> Update:
    """Sets the flag, the lowest three bits."""
    new = c("flags").bitwiseAND(~7).bitwiseOR(number)
    return Update(new != c("flags"), {"flags": new})


def move(deck: int) -> Update:
    """Cards go to another deck; from a filtered one they return to their place first."""
    queue = F.when(is_filtered() & (c("queue") >= 0), queue_of_type(home_due())).otherwise(c("queue"))
    due = F.when(is_filtered() & (c("odue") != 0), c("odue")).otherwise(c("due"))
    return Update(~c("did").eqNullSafe(F.lit(deck)), {"did": F.lit(deck), "odid": F.lit(0), "odue": F.when(is_filtered(), 0).otherwise(c("odue")), "due": due, "queue": queue})


def enter_filtered(deck: int, position: Column, *, reschedule: bool) -> Update:
    """Cards go to a filtered deck at a position, and keep deck and due for their return."""
    values = {"odid": c("did"), "did": F.lit(deck), "odue": c("due"), "due": F.when(c("due") > 0, position).otherwise(c("due"))}
    return Update(~is_filtered() & (c("odue") == 0), values | ({} if reschedule else {"queue": F.lit(Queue.REVIEW.value)}))


def return_home() -> Update:
    """Cards of filtered decks return to deck, due and queue."""
    queue = F.when(c("queue") >= 0, queue_of_type(home_due())).otherwise(c("queue"))
    return Update(is_filtered(), {"did": c("odid"), "odid": F.lit(0), "due": F.when(c("odue") != 0, c("odue")).otherwise(c("due")), "odue": F.lit(0), "queue": queue})
