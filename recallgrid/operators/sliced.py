"""Previous row and running number of each key, without ever holding a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.session import cut

#: Width of a slice in units of the order column, milliseconds for reviews: at most so many rows of a key, as ids differ.
SLICE = 21_600_000


def slice_of(order: str, width: int = SLICE) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("bigint")


def with_previous(rows: DataFrame, key: str, order: str, carry: list[str], *, width: int = SLICE) -> DataFrame:
    """rows with idx_, the number of the row in its key from 1, and prev_, a struct of carry from the row before.

    order must be an integer that differs between the rows of a key. Windows run over slices (key, order div width); one
    row per slice carries the last values and the count to the next slice. Rows with a null key or order are left out. Rows
    that have a slice_ already, and are clustered by it, are not moved again.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    if "slice_" not in rows.columns:
        rows = rows.withColumn("slice_", slice_of(order, width))
    inside = Window.partitionBy(key, "slice_").orderBy(order)
    rows = rows.withColumn("own_", F.struct(*carry)).withColumn("before_", F.lag("own_").over(inside)).withColumn("at_", F.row_number().over(inside))
    slices = rows.groupBy(key, "slice_").agg(F.max_by("own_", order).alias("last_"), F.count(F.lit(1)).alias("n_"))
    of_key = Window.partitionBy(key).orderBy("slice_")
    slices = slices.select(key, "slice_", F.lag("last_").over(of_key).alias("carried_"), (F.sum("n_").over(of_key.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_")).alias("base_"))
    out = rows.join(slices, [key, "slice_"])
    prev = F.when(F.col("at_") == 1, F.col("carried_")).otherwise(F.col("before_"))
    return out.withColumn("idx_", F.col("base_") + F.col("at_")).withColumn("prev_", prev).drop("slice_", "own_", "before_", "at_", "carried_", "base_")


def numbered(rows: DataFrame, order: str | list[Column], name: str = "n_") -> DataFrame:
    """rows with name, their number from 1 in an order that no two rows share, over any number of tasks.

    Ranges of the order go to partitions, which are sorted; a row's number is its place in its partition and the size of
    those before, of which there is one sum per partition. Of a single column, rows with a null are left out.
    """
    if isinstance(order, str):
        rows, order = rows.where(F.col(order).isNotNull()), [F.col(order)]
    # Kept as computed: both uses below must see the same partitions.
    inside = cut(rows.orderBy(*order).withColumn("at_", F.monotonically_increasing_id()))
    part, at = F.shiftright("at_", 33), F.col("at_").bitwiseAND((1 << 33) - 1)
    before = Window.partitionBy(F.lit(0)).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = inside.groupBy(part.alias("part_")).agg(F.count(F.lit(1)).alias("size_")).select("part_", F.coalesce(F.sum("size_").over(before), F.lit(0)).alias("base_"))
    placed = inside.withColumn("part_", part).join(F.broadcast(sizes), "part_")
    return placed.withColumn(name, F.col("base_") + at + 1).drop("part_", "at_", "base_")
