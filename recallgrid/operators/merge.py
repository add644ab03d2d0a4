"""Set-at-a-time changes of tables: each is a function from old frames to new ones, as files are not updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions import text as tx
from recallgrid.operators.sliced import numbered


def insert_or_ignore(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """target with those rows of incoming whose keys it lacks; of incoming rows with equal keys the least stands."""
    new = incoming.join(target.select(*keys).distinct(), keys, "left_anti")
    one = new.groupBy(*keys).agg(F.min(F.struct(*[F.col(x) for x in target.columns])).alias("row_")).select("row_.*")
    return target.unionByName(one)


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """target with all rows of incoming in place of its own with equal keys."""
    one = incoming.groupBy(*keys).agg(F.max(F.struct(*[F.col(x) for x in target.columns])).alias("row_")).select("row_.*")
    return target.join(one.select(*keys), keys, "left_anti").unionByName(one)


def merge_by_rule(local: DataFrame, remote: DataFrame, key: str, remote_wins: Column) -> DataFrame:
    """One row per key: the remote one where the local is absent or remote_wins, a condition over structs l and r."""
    a = local.select(F.col(key).alias("k_"), F.struct(*local.columns).alias("l"))
    b = remote.select(F.col(key).alias("k_"), F.struct(*local.columns).alias("r"))
    both = a.join(b, "k_", "full")
    pick = F.when(F.col("l").isNull(), F.col("r")).when(F.col("r").isNull(), F.col("l")).when(remote_wins, F.col("r")).otherwise(F.col("l"))
    return both.select(pick.alias("row_")).select("row_.*")


def sync_rows(local: DataFrame, remote: DataFrame, key: str = "id") -> DataFrame:
    """Cards and notes in a sync: the remote row wins unless the local one is pending and not older."""
    return merge_by_rule(local, remote, key, (F.col("l.usn") != -1) | (F.col("l.mod") < F.col("r.mod")))


def sync_dimension(local: DataFrame, remote: DataFrame, key: str = "id", time: str = "mtime_secs") -> DataFrame:
    """Decks, note types and presets in a sync: the remote row wins unless the local one is newer."""
    return merge_by_rule(local, remote, key, F.col(f"l.{time}") <= F.col(f"r.{time}"))


def bury_with_tombstones(rows: DataFrame, removed: DataFrame, key: str, kind: int, usn: int = -1) -> tuple[DataFrame, DataFrame]:
    """rows without removed (key), and tombstones (oid, type, usn) of those that were there."""
    ids = removed.select(F.col(key)).distinct()
    gone = rows.select(key).distinct().join(ids, key, "left_semi")
    return rows.join(ids, key, "left_anti"), gone.select(F.col(key).alias("oid"), F.lit(kind).alias("type"), F.lit(usn).alias("usn"))


def allocate_ids(rows: DataFrame, taken: DataFrame, id: str, valid: Column) -> DataFrame:
    """rows with new ids, above all that exist, where the id is invalid or taken; the column old_id keeps what it was.

    The rows to change get running numbers in the order of their ids, which differ.
    """
    used = taken.select(F.col(id).alias("used_")).distinct()
    top = F.greatest(taken.agg(F.coalesce(F.max(id), F.lit(0))).scalar(), rows.where(valid).agg(F.coalesce(F.max(id), F.lit(0))).scalar())
    marked = rows.join(used, F.col(id) == F.col("used_"), "left").withColumn("bad_", ~valid | F.col("used_").isNotNull()).drop("used_")
    bad = numbered(marked.where("bad_"), id)
    new = bad.withColumn("old_id", F.col(id)).withColumn(id, (top + F.col("n_")).cast("bigint")).drop("n_", "bad_")
    kept = marked.where(~F.col("bad_")).drop("bad_").withColumn("old_id", F.col(id))
    return kept.unionByName(new)


def pending(rows: DataFrame, usn: Column, chunk: int) -> DataFrame:
    """The next chunk of rows that wait for a sync, by id; a chunk is the feature."""
    return rows.where(usn == -1).orderBy("id").limit(chunk)


def sync_action(local: tuple[int, int, int], remote: tuple[int, int, int]) -> str:
    """What a sync has to do from (mod, schema, usn) of both sides: 'none', 'full' or 'normal'."""
    if local[0] == remote[0]:
        return "none"
    return "full" if local[1] != remote[1] else "normal"


# --- fields and tags -------------------------------------------------------------------------------------------------


def find_and_replace(notes: DataFrame, pattern: str, replacement: str, *, field: int | None = None, ignore_case: bool = True) -> DataFrame:
    """Adds new_flds and changed: a regular expression replaced in every field, or in one."""
    rx = ("(?iu)" if ignore_case else "") + pattern
    each = F.transform(tx.fields_of(F.col("flds")), lambda f, i: F.regexp_replace(f, rx, replacement) if field is None else F.when(i == field, F.regexp_replace(f, rx, replacement)).otherwise(f))
    return notes.withColumn("new_flds", F.array_join(each, tx.FIELD_SEPARATOR)).withColumn("changed", F.col("new_flds") != F.col("flds"))


def remap_fields(flds: Column, order: list[int | None]) -> Column:
    """Fields in a new order; None gives an empty field."""
    parts = [F.lit("") if i is None else tx.field_at(flds, i) for i in order]
    return F.concat_ws(tx.FIELD_SEPARATOR, *parts)


def canonical_tags(tags: Column) -> Column:
    """Each tag once without regard to case, in order without regard to case; of spellings the first in order stands."""
    ordered = F.array_sort(F.array_distinct(tags), lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.filter(ordered, lambda t, i: (i == 0) | (F.lower(t) != F.lower(F.get(ordered, i - 1))))


def add_tags(tags: Column, new: list[str]) -> Column:
    return canonical_tags(F.concat(tags, F.array(*[F.lit(t) for t in new])))


def _below(tag: Column, name: str) -> Column:
    low = F.lower(tag)
    return (low == name.lower()) | F.startswith(low, F.lit(name.lower() + "::"))


def remove_tags(tags: Column, names: list[str]) -> Column:
    """Without the tags and those below them."""
    return F.filter(tags, lambda t: ~F.exists(F.array(*[F.lit(n.lower()) for n in names]), lambda n: (F.lower(t) == n) | F.startswith(F.lower(t), F.concat(n, F.lit("::")))))


def rename_tag(tags: Column, old: str, new: str) -> Column:
    """A tag and those below it under another name; tags without it stay as they are."""
    renamed = F.transform(tags, lambda t: F.when(_below(t, old), F.concat(F.lit(new), F.substr(t, F.lit(len(old) + 1)))).otherwise(t))
    return F.when(F.exists(tags, lambda t: _below(t, old)), canonical_tags(renamed)).otherwise(tags)


def reparent_tag(tags: Column, tag: str, parent: str | None) -> Column:
    """A tag moved below another one, or to the top; a tag is never moved below itself."""
    if parent is not None and (parent.lower() == tag.lower() or parent.lower().startswith(tag.lower() + "::")):
        return tags
    leaf = tag.rsplit("::", 1)[-1]
    return rename_tag(tags, tag, leaf if parent is None else f"{parent}::{leaf}")


def complete_tags(tags: DataFrame, typed: str, limit: int) -> DataFrame:
    """(tag) that match typed component by component, those that begin with it first; the limit is the feature."""
    parts = [p.lower() for p in typed.split("::")]
    levels = F.split(F.lower("tag"), "::")
    match = F.size(levels) >= len(parts)
    for i, p in enumerate(parts):
        match = match & F.contains(F.coalesce(F.get(levels, i), F.lit("")), F.lit(p))
    first = ~F.startswith(F.lower("tag"), F.lit(typed.lower()))
    return tags.select("tag").distinct().where(match).orderBy(first, F.lower("tag"), "tag").limit(limit)


def rename_subtree(names: Column, old: str, new: str, separator: str = "\x1f") -> Column:
    """A deck name and those below it under another name, without regard to case."""
    low = F.lower(names)
    inside = (low == old.lower()) | F.startswith(low, F.lit((old + separator).lower()))
    return F.when(inside, F.concat(F.lit(new), F.substr(names, F.lit(len(old) + 1)))).otherwise(names)


def thin_backups(backups: DataFrame, now_day: int, daily: int, weekly: int, monthly: int) -> DataFrame:
    """(day, keep) of backups by day number: all of the last two days, then the latest per day, week and month, so many each."""
    rows = backups.select("day").distinct().withColumn("age", F.lit(now_day) - F.col("day"))
    week, month = F.floor(F.col("day") / 7), F.floor(F.col("day") / 30)
    for name, period in (("week", week), ("month", month)):
        rows = rows.withColumn(name, F.row_number().over(Window.partitionBy(period).orderBy(F.col("day").desc())) == 1)
    # Ranks run over days and their periods, a bounded number of rows.
    number = lambda by: F.sum(F.when(F.col(by), 1).otherwise(0)).over(Window.partitionBy(F.lit(0)).orderBy(F.col("day").desc()))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("day").desc()))
    keep = (F.col("age") <= 2) | (rank <= daily) | (F.col("week") & (number("week") <= weekly)) | (F.col("month") & (number("month") <= monthly))
    return rows.select("day", keep.alias("keep"))


def media_action(local: Column, remote: Column, waiting: Column) -> Column:
    """What to do with a media file, from its local and remote checksum (null: absent or deleted) and whether a local
    change waits: none, download, delete or remove_pending."""
    same = local.eqNullSafe(remote)
    return (
        F.when(same & ~waiting, "none")
        .when(same & waiting, F.when(local.isNull(), "none").otherwise("remove_pending"))
        .when(remote.isNull() & waiting, "none")
        .when(remote.isNull(), "delete")
        .otherwise("download")
    )
