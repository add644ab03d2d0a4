"""Problem 2: sessions of activity, split at gaps of inactivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A new session begins where an event starts more than this after the event before.
GAP_MS = 1_800_000
#: Width of a time slice. Event ids are distinct milliseconds, so a slice of one key has at most this many rows.
SLICE_MS = 21_600_000


def sessions(events: DataFrame, key: str, end: str, duration: str, *, gap_ms: int = GAP_MS, slice_ms: int = SLICE_MS, prefer: Column | None = None) -> DataFrame:
    """Sessions (key, session_no, start_ms, end_ms, duration_ms, n) of each key.

    An event lasts from `end` - `duration` to `end`, both in ms; `end` also identifies it. Events of a key are ordered
    by `end`; one that starts more than gap_ms after the `end` of the one before begins a new session. start_ms is the
    earliest start in the session, end_ms the last `end`.

    Method: lag over the events of a key flags the gaps, a running sum of flags numbers the sessions, and an aggregate
    makes one row of each. The windows run over slices of time, (key, end div slice_ms), so no task ever holds a whole
    key: as `end` is unique, a slice has at most slice_ms rows. A second window over one row per slice gives each slice
    the last `end` before it and the number of sessions so far; a key has at most (time span / slice_ms) slices, each with
    at most slice_ms / gap_ms + 1 pieces of sessions.

    Defined cases: null key or null `end`: left out. Null duration: 0. Negative duration: taken as it is. Several rows
    with the same `end`: one event, namely the one with the largest `prefer` (then the largest duration and key). Empty
    input: no rows. Other columns of events are ignored, whatever their names.
    """
    first = [prefer.alias("p_")] if prefer is not None else []
    rows = events.select(F.col(key).alias("k_"), F.col(end).cast("bigint").alias("e_"), F.coalesce(F.col(duration).cast("bigint"), F.lit(0)).alias("d_"), *first)
    rows = rows.where(F.col("k_").isNotNull() & F.col("e_").isNotNull())
    best = F.max(F.struct(*(["p_"] if first else []), "d_", "k_")).alias("b_")
    rows = rows.groupBy("e_").agg(best).select(F.col("b_.k_").alias("k_"), "e_", (F.col("e_") - F.col("b_.d_")).alias("s_"))
    rows = rows.withColumn("slice_", F.floor(F.col("e_") / F.lit(slice_ms)).cast("bigint"))

    in_slice = Window.partitionBy("k_", "slice_").orderBy("e_")
    before = F.lag("e_").over(in_slice)
    rows = rows.withColumn("gap_", F.when(F.col("s_") - before > gap_ms, 1).otherwise(0))
    rows = rows.withColumn("piece_", F.sum("gap_").over(in_slice.rowsBetween(Window.unboundedPreceding, 0)))
    # One row per run of events without a gap inside a slice; the clustering of the window serves this aggregate too.
    pieces = rows.groupBy("k_", "slice_", "piece_").agg(F.min("s_").alias("s_"), F.min_by("s_", "e_").alias("first_s_"), F.max("e_").alias("e_"), F.count(F.lit(1)).alias("n_"))

    # Pieces of a slice lie more than gap_ms apart, so there are few; they travel with their slice in one row.
    piece = F.struct("piece_", "s_", "e_", "n_", "first_s_")
    slices = pieces.groupBy("k_", "slice_").agg(F.array_sort(F.collect_list(piece)).alias("own_"))
    in_key = Window.partitionBy("k_").orderBy("slice_")
    first, last = F.element_at("own_", 1), F.element_at("own_", -1)
    new = F.when(first["first_s_"] - F.lag(last["e_"]).over(in_key) > gap_ms, 1).otherwise(0)
    slices = slices.withColumn("more_", F.size("own_") - 1).withColumn("new_", new)
    slices = slices.withColumn("base_", F.sum(F.col("new_") + F.col("more_")).over(in_key.rowsBetween(Window.unboundedPreceding, 0)) - F.col("more_"))
    # The window has gathered the slices of a key, and the aggregate below needs no other order of rows.
    numbered = slices.select("k_", "base_", F.inline("own_")).withColumn("session_", F.col("base_") + F.col("piece_"))
    out = numbered.groupBy("k_", "session_").agg(F.min("s_").alias("start_ms"), F.max("e_").alias("end_ms"), F.sum("n_").alias("n"))
    return out.select(F.col("k_").alias(key), (F.col("session_") + 1).cast("bigint").alias("session_no"), "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "n")
