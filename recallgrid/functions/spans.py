"""Spans of time and ranges of intervals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = 365 * 86_400
#: (name, seconds), from the largest; a month is a twelfth of a year.
UNITS = (("years", YEAR), ("months", YEAR / 12), ("days", 86_400), ("hours", 3_600), ("minutes", 60), ("seconds", 1))
#: Days from, days to, and part of the days between that are added to the spread of an interval.
SPREAD = ((2.5, 7.0, 0.15), (7.0, 20.0, 0.1), (20.0, None, 0.05))


def span(seconds: Column) -> Column:
    """(amount, unit) in the largest unit that the seconds reach."""
    size = F.abs(seconds)
    out = None
    for name, n in UNITS:
        one = F.struct((seconds / n).cast("double").alias("amount"), F.lit(name).alias("unit"))
        out = F.when(size >= n, one) if out is None else out.otherwise(one) if name == "seconds" else out.when(size >= n, one)
    return out


def spread(interval: Column) -> Column:
    """Days by which an interval may vary: none below two and a half, else one and parts of its days by range."""
    total = F.lit(1.0)
    for a, b, part in SPREAD:
        top = interval if b is None else F.least(interval, F.lit(b))
        total = total + F.lit(part) * F.greatest(top - a, F.lit(0.0))
    return F.when(interval < 2.5, F.lit(0.0)).otherwise(total)


def bounds(interval: Column, least: int, most: int) -> tuple[Column, Column]:
    """The lowest and the highest number of days of a varied interval, within limits, and apart if the limits allow."""
    lo, hi = min(least, most), most
    x = F.least(F.greatest(interval.cast("double"), F.lit(float(lo))), F.lit(float(hi)))
    clamp = lambda v: F.least(F.greatest(F.round(v).cast("int"), F.lit(lo)), F.lit(hi))
    low, high = clamp(x - spread(x)), clamp(x + spread(x))
    return low, F.when((low == high) & (high > 2) & (high < hi), low + 1).otherwise(high)


def due_spec(text: str) -> tuple[int, int, bool]:
    """(first day, last day, whether the interval changes, too) of texts such as 3, 3-7 and 3-7!."""
    m = re.fullmatch(r"(\d+)(?:-(\d+))?(!)?", text.strip(), re.A)
    if not m:
        raise ValueError(f"not a number of days: {text}")
    a, b = int(m.group(1)), int(m.group(2) or m.group(1))
    return min(a, b), max(a, b), m.group(3) is not None
