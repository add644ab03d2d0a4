"""Memory-model functions over card data: stability, difficulty, retrievability, decay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallgrid.model import DAY, Timing

#: Published decay of the sixth and the fifth version of the model.
DECAY_6, DECAY_5 = 0.1542, 0.5
DATA_SCHEMA = "pos int, s float, d float, dr float, decay float, lrt bigint, cd string"
#: Above this a due value is a time in seconds for the memory functions; for others above DUE_IS_TIME.
DUE_IS_TIME_MEMORY, DUE_IS_TIME = 365_000, 1_000_000_000


def card_data(data: Column) -> Column:
    """The extras of a card as a struct; bad values and broken documents give nulls."""
    return F.from_json(data, DATA_SCHEMA)


def number(data: Column, key: str) -> Column:
    """A number of the extras as DOUBLE, null if absent or no number."""
    return F.get_json_object(data, f"$.{key}").try_cast("double")


def has_state(data: Column) -> Column:
    """A card has a memory state only with both stability and difficulty."""
    return number(data, "s").isNotNull() & number(data, "d").isNotNull()


def original_position(data: Column) -> Column:
    return F.get_json_object(data, "$.pos").try_cast("int")


def custom_data(data: Column, key: str) -> Column:
    """A value of the custom data, which is a JSON document inside a string."""
    return F.get_json_object(F.get_json_object(data, "$.cd"), f"$.{key}")


def forgetting_curve(elapsed_days: Column, stability: Column, decay: Column) -> Column:
    """R = (1 + f t / S) ^ -decay with f = 0.9 ^ (-1 / decay) - 1: 0.9 where t is the stability."""
    factor = F.pow(F.lit(0.9), F.lit(-1.0) / decay) - 1
    return F.pow(F.lit(1.0) + factor * elapsed_days / stability, -decay)


def elapsed_seconds(data: Column, due: Column, ivl: Column, t: Timing) -> Column:
    """Seconds since the last review: by its time if known, else from due and interval; never below 0."""
    last = F.get_json_object(data, "$.lrt").try_cast("bigint")
    by_time = F.greatest(F.lit(t.now) - (due - ivl), F.lit(0))
    by_day = F.greatest(F.lit(t.days_elapsed) - (due - ivl), F.lit(0)) * DAY
    return F.when(last.isNotNull(), F.greatest(F.lit(t.now) - last, F.lit(0))).when(due > DUE_IS_TIME_MEMORY, by_time).otherwise(by_day).cast("double")


def retrievability(data: Column, due: Column, ivl: Column, t: Timing) -> Column:
    """The chance to remember the card now; null without a memory state."""
    decay = F.coalesce(number(data, "decay"), F.lit(DECAY_5))
    return F.when(has_state(data), forgetting_curve(elapsed_seconds(data, due, ivl, t) / DAY, number(data, "s"), decay))


def overdueness(due: Column, ivl: Column, t: Timing) -> Column:
    """Relative overdueness without a memory state; the more negative, the more overdue."""
    return -(F.lit(1.0) + (F.lit(t.days_elapsed) - due + F.lit(0.001)) / F.greatest(ivl, F.lit(1)))


def relative_retrievability(data: Column, due: Column, ivl: Column, t: Timing) -> Column:
    """How far the card has gone below the retention that is wanted; falls back to days by interval."""
    decay = F.coalesce(number(data, "decay"), F.lit(DECAY_5))
    wanted = F.greatest(F.coalesce(number(data, "dr"), F.lit(0.9)), F.lit(0.0001))
    now = F.greatest(retrievability(data, due, ivl, t), F.lit(0.0001))
    power = F.lit(-1.0) / decay
    by_state = -(F.pow(now, power) - 1) / (F.pow(wanted, power) - 1)
    days = F.greatest(elapsed_seconds(data, due, ivl, t) / DAY, F.lit(0.0))
    return F.when(has_state(data), by_state).otherwise(-(days + F.lit(0.001)) / F.greatest(ivl, F.lit(1)))


def decay_of(params: Column) -> Column:
    """The decay of a list of model parameters: the 21st, or the default of the version that the length tells."""
    return F.when(F.size(params) == 0, F.lit(DECAY_6)).when(F.size(params) < 21, F.lit(DECAY_5)).otherwise(F.try_element_at(params, F.lit(21)))


def normalized_difficulty(d: Column) -> Column:
    return (d - 1) / 9


def percent_bin(x: Column, size: int) -> Column:
    """The lower end of x's bin; 100 belongs to the last bin."""
    return F.when(x >= 100, F.lit(100 - size)).otherwise(F.floor(x / size) * size).cast("int")
