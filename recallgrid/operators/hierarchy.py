"""Trees written as paths: levels, parents, roll-ups, and limits that hold at every level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def path_of(name: Column, separator: str) -> Column:
    return F.split(name, separator)


def with_path(df: DataFrame, name: str = "name", separator: str = "\x1f") -> DataFrame:
    """Adds path, level (from 1) and parent, the name of the parent; null at the top."""
    path = path_of(F.col(name), separator)
    parent = F.when(F.size(path) > 1, F.array_join(F.slice(path, 1, F.size(path) - 1), separator))
    return df.withColumn("path", path).withColumn("level", F.size(path)).withColumn("parent", parent)


def prefixes(path: Column, separator: str = "\x1f") -> Column:
    """Names of a node and all its ancestors, from the top."""
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda k: F.array_join(F.slice(path, F.lit(1), k), separator))


def missing_parents(names: DataFrame, name: str = "name", separator: str = "\x1f") -> DataFrame:
    """(name) of ancestors that do not exist themselves."""
    wanted = names.select(F.explode(prefixes(path_of(F.col(name), separator), separator)).alias(name)).distinct()
    return wanted.join(names.select(name), name, "left_anti")


def rolled_up(nodes: DataFrame, name: str, values: list[str], separator: str = "\x1f") -> DataFrame:
    """(name, values): each node with the sums of its whole subtree; every row is added to all of its ancestors."""
    up = nodes.select(F.explode(prefixes(path_of(F.col(name), separator), separator)).alias(name), *values)
    return up.groupBy(name).agg(*[F.sum(v).cast("bigint").alias(v) for v in values])


def within_limits(rows: DataFrame, path: str, order: list[Column], limits: dict[str, int], depth: int, separator: str = "\x1f") -> DataFrame:
    """The rows that are taken when they come in order and each is taken only while no node above it is full.

    limits has the most rows of a subtree by the node's name; nodes without one have none. The limits form a laminar
    family, so taking rows greedily is the same as keeping the first ones of each subtree, level by level from the bottom:
    a row that is not among the first of its subtree can't be taken, as those before it are taken or refused higher up.
    Each level is a row number with an upper bound, which Spark cuts before the shuffle. depth is the deepest level.
    """
    for level in range(depth, 0, -1):
        names = {n: k for n, k in limits.items() if n.count(separator) == level - 1}
        if not names:
            continue
        node = F.when(F.size(path) >= level, F.array_join(F.slice(path, 1, level), separator))
        most = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("node_")]
        named = rows.withColumn("node_", node)
        bound = max(names.values())
        limited = named.where(most.isNotNull()).withColumn("rank_", F.row_number().over(Window.partitionBy("node_").orderBy(*order)))
        kept = limited.where((F.col("rank_") <= bound) & (F.col("rank_") <= most)).drop("node_", "rank_")
        rows = kept.unionByName(named.where(most.isNull()).drop("node_"))
    return rows


@dataclass
class Counts:
    new: int = 0
    review: int = 0
    intraday: int = 0
    interday: int = 0
    total: int = 0


@dataclass
class Limit:
    """What a node may still show today."""

    review: int = 9999
    new: int = 9999
    new_within_review: bool = False


def capped_tree(own: dict[str, Counts], limits: dict[str, Limit], separator: str = "\x1f") -> dict[str, dict[str, int]]:
    """Counts of every node with its children, each capped by its limits from the bottom up.

    A node has its own counts and those of its children as capped; interday learning uses up the review limit first, then
    reviews; new cards have a limit of their own and, if asked, the rest of the review limit. Limits of children are no
    larger than those above. Works on one entry per node, a dimension; nodes without a parent in own are left out.
    """
    names = sorted(own, key=lambda n: n.split(separator))
    known = [n for n in names if separator not in n or n.rsplit(separator, 1)[0] in own]
    effective: dict[str, Limit] = {}
    for n in known:
        mine = limits.get(n, Limit())
        up = effective.get(n.rsplit(separator, 1)[0]) if separator in n else None
        effective[n] = Limit(min(mine.review, up.review), min(mine.new, up.new), mine.new_within_review) if up else mine
    sums = {n: Counts(**vars(own[n])) for n in known}
    whole = {n: own[n].total for n in known}
    out: dict[str, dict[str, int]] = {}
    for n in reversed(known):
        s, limit = sums[n], effective[n]
        interday = min(s.interday, limit.review)
        review = min(s.review, limit.review - interday)
        new = min(s.new, limit.new)
        if limit.new_within_review:
            new = min(new, max(limit.review - interday - review, 0))
        out[n] = {"new": new, "review": review, "learn": s.intraday + interday, "total": whole[n]}
        parent = n.rsplit(separator, 1)[0] if separator in n else None
        if parent in sums:
            p = sums[parent]
            sums[parent] = Counts(p.new + new, p.review + review, p.intraday + s.intraday, p.interday + interday, p.total + s.total)
            whole[parent] += whole[n]
    return out
