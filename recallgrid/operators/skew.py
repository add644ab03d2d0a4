"""Helpers for keys that hold a large part of all rows.

Both splits are by measured counts and keep every row: heavy keys take another way, none is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that may be treated as heavy at once. A key outside the list holds at most 1/MAX_HEAVY of all rows,
#: and a broadcast of the list has at most MAX_HEAVY rows.
MAX_HEAVY = 1024
#: A key below this number of rows is never heavy.
MIN_HEAVY = 20_000
#: Rows of a group that meet the rest of their group in one task of salted_pairs.
SALT_ROWS = 4_096


def heavy_keys(counts: DataFrame, keys: list[str], n: str, min_rows: int = MIN_HEAVY) -> DataFrame:
    """The at most MAX_HEAVY keys with the most rows, from one row (keys, n) per key."""
    return counts.where(F.col(n) >= min_rows).orderBy(F.col(n).desc(), *keys).limit(MAX_HEAVY).select(*keys)


def join_one_to_many(rows: DataFrame, one: DataFrame, keys: list[str], n: str, how: str = "inner", min_rows: int = MIN_HEAVY) -> DataFrame:
    """rows JOIN one on keys, where one has a single row per key with n, the key's number of rows.

    Heavy keys are matched by a broadcast of at most MAX_HEAVY rows, all others by a shuffle. Keys must not be null.
    how: 'inner' adds one's columns without n, 'left_semi' adds none.
    """
    heavy = heavy_keys(one, keys, n, min_rows)
    columns = keys if how == "left_semi" else [c for c in one.columns if c != n]
    top = one.join(F.broadcast(heavy), keys, "left_semi").select(*columns)
    rest = one.join(F.broadcast(heavy), keys, "left_anti").select(*columns)
    kind = "left_semi" if how == "left_semi" else "inner"
    by_broadcast = rows.join(F.broadcast(top), keys, kind)
    by_shuffle = rows.join(F.broadcast(heavy), keys, "left_anti").join(rest.hint("shuffle_merge"), keys, kind)
    return by_broadcast.unionByName(by_shuffle)


def salted_pairs(rows: DataFrame, keys: list[str], n: str, differ: str, order: str, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Pairs (a, b) of rows with equal keys, unequal `differ` and a's `order` < b's, as order_a, order_b.

    n is the size of the row's group. A group is split into ceil(n / salt_rows) parts, and each part meets the whole
    group in a task of its own, so that a group of any size is worked on by many tasks.
    """
    parts = F.ceil(F.col(n) / F.lit(salt_rows)).cast("int")
    left = rows.select(*keys, F.col(order).alias("order_a"), F.col(differ).alias("differ_a"), F.pmod(F.xxhash64(order), parts).cast("int").alias("salt_"))
    right = rows.select(*keys, F.col(order).alias("order_b"), F.col(differ).alias("differ_b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt_"))
    pairs = left.hint("shuffle_merge").join(right, [*keys, "salt_"])
    return pairs.where((F.col("order_a") < F.col("order_b")) & (F.col("differ_a") != F.col("differ_b"))).select(*keys, "order_a", "order_b")
