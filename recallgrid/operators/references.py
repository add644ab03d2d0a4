"""Problem 3: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.operators.skew import MAX_HEAVY, MIN_HEAVY
from recallgrid.session import cut
from recallgrid.tables import month_of_ms, seq

SOURCE = ["src_table", "src_field", "tgt"]


def references(df: DataFrame, src_table: str, src_field: str, tgt: str, *, id: str = "id", key: str | None = None) -> DataFrame:
    """References (src_table, src_field, tgt, src_id, key) of a table; null keys name nothing and are left out."""
    key = key or src_field
    return df.where(F.col(key).isNotNull()).select(F.lit(src_table).alias("src_table"), F.lit(src_field).alias("src_field"), F.lit(tgt).alias("tgt"), F.col(id).cast("bigint").alias("src_id"), F.col(key).cast("bigint").alias("key"))


def several_references(df: DataFrame, src_table: str, fields: dict[str, str], *, id: str = "id") -> DataFrame:
    """References of several fields (field -> kind of target) of a table, in one pass over its rows."""
    each = F.array(*[F.struct(F.lit(f).alias("src_field"), F.lit(t).alias("tgt"), F.col(f).cast("bigint").alias("key")) for f, t in fields.items()])
    rows = df.select(F.lit(src_table).alias("src_table"), F.col(id).cast("bigint").alias("src_id"), F.inline(each))
    return rows.where(F.col("key").isNotNull()).select(*SOURCE, "src_id", "key")


def existing(rows: DataFrame, deletes: DataFrame, *, id: str = "id", usn: str = "usn", deleted: str = "oid") -> DataFrame:
    """The rows that exist: the latest version of each id, unless a delete has a later usn than it.

    At equal usn the delete came first; -1 is the latest. Of versions with equal usn the greatest in column order stands.
    """
    latest = rows.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("id_")).agg(F.max(F.struct(seq(F.col(usn)).alias("seq_"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row_"))).alias("last_"))
    gone = deletes.where(F.col(deleted).isNotNull()).groupBy(F.col(deleted).alias("id_")).agg(F.max(seq(F.col(usn))).alias("gone_"))
    return latest.join(gone, "id_", "left").where(F.col("gone_").isNull() | (F.col("gone_") <= F.col("last_.seq_"))).select("last_.row_.*")


class Orphans:
    """References whose target does not exist; what is not asked for is not worked out.

    rows: (src_table, src_field, src_id, key). counts: (src_table, src_field, period, refs, orphans, orphan_keys).
    """

    def __init__(self, refs: DataFrame, targets: DataFrame, min_heavy: int) -> None:
        self.refs, self.targets, self.min_heavy = refs, targets, min_heavy

    def _per_month(self, refs: DataFrame) -> DataFrame:
        """(source, key, period, n), combined on the map side and kept, as several steps read it."""
        return cut(refs.groupBy(*SOURCE, "key", month_of_ms(F.col("src_id")).alias("period")).agg(F.count(F.lit(1)).alias("n")))

    def _of_missing(self, rows: DataFrame, per_month: DataFrame, spread: str) -> DataFrame:
        """The rows whose key is missing, in one pass over rows.

        Rows of heavy keys meet the broadcast list and go no further if their key exists; if it does not, they are dealt
        to as many tasks as the key has portions of min_heavy references, by a hash of the column spread.
        """
        totals = per_month.groupBy("tgt", "key").agg(F.sum("n").alias("n"))
        heavy = totals.where(F.col("n") >= self.min_heavy).orderBy(F.col("n").desc(), "tgt", "key").limit(MAX_HEAVY)
        found = self.targets.join(F.broadcast(heavy.select("tgt", "key")), ["tgt", "key"], "left_semi").distinct().withColumn("found_", F.lit(True))
        parts = F.ceil(F.col("n") / F.lit(max(self.min_heavy, 1))).cast("int")
        heavy = heavy.join(F.broadcast(found), ["tgt", "key"], "left").select("tgt", "key", F.col("found_").isNull().alias("gone_"), parts.alias("parts_"))
        light = totals.select("tgt", "key").join(F.broadcast(heavy.select("tgt", "key")), ["tgt", "key"], "left_anti")
        light = light.hint("shuffle_merge").join(self.targets, ["tgt", "key"], "left_anti").withColumn("salt_", F.lit(0))
        missing = light.unionByName(heavy.where("gone_").select("tgt", "key", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1)).alias("salt_")))
        left = rows.join(F.broadcast(heavy), ["tgt", "key"], "left").where(F.coalesce("gone_", F.lit(True)))
        left = left.withColumn("salt_", F.when(F.col("gone_").isNotNull(), F.pmod(F.xxhash64(spread), F.col("parts_"))).otherwise(0).cast("int"))
        return left.join(missing, ["tgt", "key", "salt_"], "left_semi").select(*rows.columns)

    @property
    def rows(self) -> DataFrame:
        # Repeats do not change which keys occur, so they are dropped last, when only orphans are left.
        found = self._of_missing(self.refs, self._per_month(self.refs), "src_id")
        return found.select("src_table", "src_field", "src_id", "key").distinct()

    @property
    def counts(self) -> DataFrame:
        per_month = self._per_month(self.refs.distinct())
        missing = self._of_missing(per_month, per_month, "period").groupBy("src_table", "src_field", "period").agg(F.sum("n").alias("orphans"), F.count(F.lit(1)).alias("orphan_keys"))
        all_refs = per_month.groupBy("src_table", "src_field", "period").agg(F.sum("n").alias("refs"))
        counts = all_refs.withColumn("orphans", F.lit(0)).withColumn("orphan_keys", F.lit(0)).unionByName(missing.withColumn("refs", F.lit(0)))
        return counts.groupBy("src_table", "src_field", "period").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("refs", "orphans", "orphan_keys")])


def find_orphans(refs: DataFrame, targets: DataFrame, *, min_heavy: int = MIN_HEAVY) -> Orphans:
    """References whose target is not among targets (tgt, key), as rows and as counts per table, field and month.

    Method: references are counted per key and month with map-side combining; the keys with the most references, at most
    1024, are checked by a broadcast of these keys; the others, each with less than 1/1024 of all references, by a
    shuffled anti-join of distinct keys; both orphan sets are united. The referring rows are then found by the same split.
    The references are read twice: for the counts per key, and for the rows of the missing keys.

    Defined cases: a row that occurs several times counts once; null keys are no references; an id that refers to several
    missing keys gives a row for each; a null id gives a row with null src_id and period; duplicate targets are one.
    """
    refs = refs.select(*SOURCE, "src_id", "key").where(F.col("key").isNotNull())
    return Orphans(refs, targets.select("tgt", "key").where(F.col("key").isNotNull()), min_heavy)
