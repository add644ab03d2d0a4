"""Problem 7: items of varying size in containers of fixed capacity, by hierarchical residual packing."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.session import cut

#: A container at least this full is closed; others go on as items of the next round.
NEARLY_FULL = 0.98
#: Open containers that one task of a merging round works on.
TASK_ITEMS = 50_000
#: Items of a task of the first round, by which the table of sizes is dealt: it is too narrow to be split by bytes.
PART_ITEMS = 50_000
#: Items that the first round packs together: a partition of any size is packed in runs of so many.
RUN_ITEMS = 200_000
#: A round that leaves more than this share of its open containers has found nearly all that fits.
STALLED = 0.995
MAX_ROUNDS = 12
#: Most rows of the table of capacities, which is broadcast.
MAX_CAPACITIES = 1_000

MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int64()), ("tokens", pa.int64())])
BIN = pa.schema([("capacity_id", pa.int32()), ("capacity", pa.int64()), ("size", pa.int64()), ("members", pa.list_(MEMBER))])
BIN_DDL = "capacity_id int, capacity bigint, size bigint, members array<struct<doc_id: bigint, piece: bigint, tokens: bigint>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit by falling size: the indices in each bin. An item goes where it leaves the least room.

    Bins are kept by their room; rooms are small integers, so the fitting bin is found by bisection.
    """
    bins: list[list[int]] = []
    rooms: list[int] = []  # the different rooms of open bins, sorted
    by_room: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                del by_room[room], rooms[at]
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - size
        if left > 0:
            if left not in by_room:
                by_room[left] = []
                insort(rooms, left)
            by_room[left].append(b)
    return bins


def _pack(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Best fit of the open containers in table, for each capacity by itself; members are joined in order."""
    ids = table.column("capacity_id").to_numpy()
    for cid in np.unique(ids):
        part = table.filter(pa.array(ids == cid)).combine_chunks()
        capacity = part.column("capacity")[0].as_py()
        members = part.column("members").combine_chunks()
        if isinstance(members, pa.ChunkedArray):
            members = pa.concat_arrays(members.chunks)
        starts, flat = members.offsets.to_numpy(), members.values
        # A fixed order, so that a task that runs again packs the same way.
        first = flat.take(pa.array(starts[:-1])).flatten()
        sizes = part.column("size").to_numpy()
        order = np.lexsort((first[1].to_numpy(), first[0].to_numpy(), -sizes))
        packed = best_fit(sizes[order].tolist(), capacity)
        picks = [[int(order[i]) for i in b] for b in packed]
        take = [np.arange(starts[i], starts[i + 1]) for b in picks for i in b]
        lengths = [sum(int(starts[i + 1] - starts[i]) for i in b) for b in picks]
        values = flat.take(pa.array(np.concatenate(take))) if take else flat.slice(0, 0)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)
        filled = np.array([int(sizes[b].sum()) for b in picks], dtype=np.int64)
        n = len(picks)
        out = pa.table([pa.array(np.full(n, cid, np.int32)), pa.array(np.full(n, capacity, np.int64)), pa.array(filled), lists.cast(BIN.field("members").type)], schema=BIN)
        yield from out.to_batches(max_chunksize=10_000)


def _pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[pa.RecordBatch] = []
    held = 0
    for b in batches:
        if b.num_rows:
            rows.append(b)
            held += b.num_rows
        if held >= RUN_ITEMS:
            yield from _pack(pa.Table.from_batches(rows))
            rows, held = [], 0
    if rows:
        yield from _pack(pa.Table.from_batches(rows))


def _pack_group(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches(list(_pack(table.select(BIN.names))), schema=BIN)


def capacities_of(capacities: DataFrame) -> list[tuple[int, int]]:
    """(capacity_id, tokens) of the small table of capacities; null and non-positive ones hold nothing and are left out."""
    rows = capacities.select("capacity_id", "capacity_tokens").distinct().limit(MAX_CAPACITIES + 1).collect()
    if len(rows) > MAX_CAPACITIES:
        raise ValueError(f"more than {MAX_CAPACITIES} capacities")
    found: dict[int, int] = {}
    for cid, tokens in rows:
        if cid is not None and tokens is not None and tokens > 0:
            found[cid] = max(found.get(cid, 0), int(tokens))
    return sorted(found.items())


def dealt(counts: DataFrame, copies: int, part_rows: int) -> DataFrame:
    """counts dealt by a hash of doc_id to so many tasks that each gets about part_rows rows, of copies for each document."""
    tasks = -(-counts.count() * max(copies, 1) // part_rows)
    return counts.repartition(max(tasks, 1), "doc_id")


def pack(counts: DataFrame, capacities: list[tuple[int, int]], *, nearly_full: float = NEARLY_FULL, task_items: int = TASK_ITEMS) -> DataFrame:
    """Containers (capacity_id, capacity, size, members) of documents (doc_id, tokens), for each capacity.

    A document larger than a container is cut into full pieces, each a container of its own, and a rest that is packed as
    an item; no other document is cut. members holds (doc_id, piece, tokens) in their places.

    Method: every partition packs its items by best fit and emits the nearly full containers. The others go on as items:
    rounds of best fit over groups of at most about task_items of them, dealt anew by hash in each round, until one group
    is left for each capacity, or a round no longer finds anything that fits. No task ever holds more, however many
    containers stay open. Each round is checkpointed, so lost executors do not change what was packed.

    Defined cases: documents without tokens need no room and are in no container; ties are packed by doc_id; no documents
    or no capacities give no containers.
    """
    spark = counts.sparkSession
    if not capacities:
        return spark.createDataFrame([], BIN_DDL)
    caps = F.array(*[F.struct(F.lit(c).cast("int").alias("capacity_id"), F.lit(t).cast("bigint").alias("capacity")) for c, t in capacities])
    sized = dealt(counts.where(F.col("tokens") > 0).select("doc_id", "tokens"), len(capacities), PART_ITEMS).select("doc_id", "tokens", F.explode(caps).alias("c_")).select("doc_id", "tokens", "c_.*")
    pieces = sized.select("*", F.floor(F.col("tokens") / F.col("capacity")).cast("bigint").alias("full_"))

    def bins(df: DataFrame, piece, size) -> DataFrame:  # noqa: ANN001
        return df.select("capacity_id", "capacity", size.alias("size"), F.array(F.struct("doc_id", piece.alias("piece"), size.alias("tokens"))).alias("members"))

    whole = pieces.where(F.col("full_") > 0).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full_") - 1)).alias("piece_"))
    closed = [bins(whole, F.col("piece_"), F.col("capacity"))]
    rest = pieces.where(F.col("tokens") > F.col("full_") * F.col("capacity"))
    items = bins(rest, F.col("full_"), F.col("tokens") - F.col("full_") * F.col("capacity"))

    packed = cut(items.mapInArrow(_pack_partition, BIN_DDL))
    is_open = F.col("size") < F.ceil(F.col("capacity") * F.lit(nearly_full))

    def open_ones(df: DataFrame) -> dict[int, tuple[int, int]]:
        """Open containers and their members for each capacity."""
        found = df.where(is_open).groupBy("capacity_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("members")).alias("m")).collect()
        return {r["capacity_id"]: (r["n"], r["m"]) for r in found}

    left = open_ones(packed)
    for round_ in range(MAX_ROUNDS):
        if not left:
            break
        groups = {c: max(-(-n // task_items), -(-m // (10 * task_items))) for c, (n, m) in left.items()}
        of = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])[F.col("capacity_id")]
        first = F.col("members")[0]
        bucket = F.pmod(F.xxhash64(first["doc_id"], first["piece"], F.lit(round_)), of).alias("bucket_")
        closed.append(packed.where(~is_open))
        merged = packed.where(is_open).select("*", bucket).groupBy("capacity_id", "bucket_").applyInArrow(_pack_group, BIN_DDL)
        packed = cut(merged)
        now = open_ones(packed)
        done = max(groups.values()) <= 1 or sum(n for n, _ in now.values()) > STALLED * sum(n for n, _ in left.values())
        left = now
        if done:
            break
    closed.append(packed)
    out = closed[0]
    for df in closed[1:]:
        out = out.unionByName(df)
    return out


def container_id(capacity_id: str = "capacity_id") -> F.Column:
    """A container is named after its capacity and its first member, which is in no other container of that capacity."""
    first = F.col("members")[0]
    return F.concat_ws("-", F.col(capacity_id), first["doc_id"], first["piece"])


def placements(containers: DataFrame) -> DataFrame:
    """One row per text or piece: its container, its place in it from 1, and which of the text's tokens it holds."""
    rows = containers.select("capacity_id", container_id().alias("container_id"), "capacity", "size", F.posexplode("members").alias("at_", "m_"))
    start = F.col("m_.piece") * F.col("capacity")
    return rows.select("capacity_id", "container_id", (F.col("at_") + 1).alias("place"), F.col("m_.doc_id").alias("doc_id"), F.col("m_.piece").cast("int").alias("piece"), start.alias("token_start"), (start + F.col("m_.tokens")).alias("token_end"), F.col("m_.tokens").alias("tokens"), F.col("size").alias("fill_tokens"))


def fills(containers: DataFrame) -> DataFrame:
    """One row per container: its fill and unused room."""
    return containers.select("capacity_id", container_id().alias("container_id"), F.size("members").alias("n_members"), F.col("size").alias("fill_tokens"), (F.col("capacity") - F.col("size")).alias("unused_tokens"))


def summary(containers: DataFrame) -> DataFrame:
    """Per capacity: containers, members, tokens, the least possible number of containers, and the unused share."""
    g = containers.groupBy("capacity_id", "capacity").agg(F.count(F.lit(1)).alias("n_containers"), F.sum(F.size("members")).alias("n_members"), F.sum("size").alias("tokens"))
    return g.select("*", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), (1 - F.col("tokens") / (F.col("n_containers") * F.col("capacity"))).alias("unused_share"))
