"""Problem 8: a mix of sources with target shares, by balanced sampling with the cube method."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.packing import dealt
from recallgrid.session import cut

#: Most rows of the table of targets, which is broadcast.
MAX_TARGETS = 10_000
#: Undecided documents of a (mix, source) that one task of a later round works on.
TASK_UNITS = 20_000
#: Documents of a task of the first round, each once for every mix.
PART_UNITS = 50_000
#: Documents that the first round decides together: a partition of any size is worked on in runs of so many.
RUN_UNITS = 200_000
#: Small documents of each (mix, source) that a round leaves for the end, where they make up for what larger ones miss: so
#: many, and on until they have so many times the tokens of the largest document, but no more than half of all.
RESERVE, RESERVE_TOKENS = 64, 6
#: In the last round all documents so many times smaller than the largest may make up for it.
SMALLER = 4
#: Probabilities this close to 0 or 1 are decided.
EPS = 1e-9

UNIT = pa.schema([("mix_name", pa.string()), ("source", pa.string()), ("doc_id", pa.int64()), ("tokens", pa.int64()), ("base", pa.int64()), ("pi", pa.float64())])
UNIT_DDL = "mix_name string, source string, doc_id bigint, tokens bigint, base bigint, pi double"


@dataclass
class Target:
    mix_name: str
    source: str
    given_share: float
    cap: int | None
    available: int = 0  # tokens of the source's documents
    n_docs: int = 0
    share: float = 0.0  # of the sources that have documents
    target_tokens: float = 0.0
    usable: int = 0  # tokens of documents no larger than the target
    uses: float = 0.0  # expected uses of each usable document
    limit: int = 0  # largest usable document


def flight(units: list[tuple[int, int, float]], rng: random.Random) -> tuple[dict[int, float], list[int]]:
    """The flight phase over units (index, tokens, probability): decided 0 or 1, and the indices left undecided.

    Three undecided units at a time move along the null space of the two constraints, sum of tokens and number of
    documents; for three columns it is (t2 - t3, t3 - t1, t1 - t2). A step ends where a probability reaches 0 or 1, and
    both ends are chosen with the odds that keep every expectation. At most two units stay undecided.
    """
    pi: dict[int, float] = {}
    hold: list[tuple[int, int]] = []
    for i, t, p in units:
        pi[i] = p
        if p <= EPS or p >= 1 - EPS:
            pi[i] = float(round(p))
            continue
        hold.append((i, t))
        while len(hold) == 3:
            (a, ta), (b, tb), (c, tc) = hold
            u = (tb - tc, tc - ta, ta - tb)
            if u == (0, 0, 0):
                u = (1, -1, 0)
            up = min(((1 - pi[x]) / v if v > 0 else -pi[x] / v) for (x, _), v in zip(hold, u, strict=True) if v)
            down = min((pi[x] / v if v > 0 else (pi[x] - 1) / v) for (x, _), v in zip(hold, u, strict=True) if v)
            step = up if rng.random() * (up + down) < down else -down
            keep = []
            for (x, t_), v in zip(hold, u, strict=True):
                q = pi[x] + step * v
                if q <= EPS or q >= 1 - EPS:
                    pi[x] = float(round(q))
                else:
                    pi[x] = q
                    keep.append((x, t_))
            hold = keep
    return pi, [i for i, _ in hold]


def landing(undecided: list[tuple[int, int, float]]) -> dict[int, float]:
    """The small problem that is left: of all roundings the one that misses the tokens least, then the documents."""
    best, found = None, {}
    for bits in range(1 << len(undecided)):
        x = [(bits >> k) & 1 for k in range(len(undecided))]
        miss = (abs(sum((v - p) * t for v, (_, t, p) in zip(x, undecided, strict=True))), abs(sum(v - p for v, (_, _, p) in zip(x, undecided, strict=True))), bits)
        if best is None or miss < best:
            best, found = miss, {i: float(v) for v, (i, _, _) in zip(x, undecided, strict=True)}
    return found


def reserve_of(rows: list[int], tokens: list[int], pi: list[float]) -> set[int]:
    """The first undecided units of rows, not larger than the median of them, that make up a reserve."""
    undecided = [i for i in rows if EPS < pi[i] < 1 - EPS]
    if len(undecided) <= 2:
        return set(undecided)
    sizes = sorted(tokens[i] for i in undecided)
    median, largest = sizes[len(sizes) // 2], sizes[-1]
    out: list[int] = []
    held = 0
    for i in undecided:
        if len(out) >= len(undecided) // 2 or len(out) >= RESERVE and held >= RESERVE_TOKENS * largest:
            break
        if tokens[i] <= median:
            out.append(i)
            held += tokens[i]
    return set(out)


def shifted(pi: list[float], tokens: list[int], want: float) -> list[float]:
    """The probabilities moved by one amount, within 0 and 1, so that the expected tokens are those wanted, if they can be."""
    lo, hi = -1.0, 1.0
    for _ in range(50):
        c = (lo + hi) / 2
        if sum(min(1.0, max(0.0, p + c)) * t for p, t in zip(pi, tokens, strict=True)) < want:
            lo = c
        else:
            hi = c
    return [min(1.0, max(0.0, p + hi)) for p in pi]


def _decide(rows: list[int], tokens: list[int], pi: list[float], rng: random.Random, last: bool) -> None:
    """Flight over rows without the reserve, which stays undecided; in the last round the landing, then the reserve.

    The last two of the others are rounded by chance, by their probabilities, and the reserve's probabilities take up what
    was rounded away; if that is more than the reserve holds, the two are landed where they miss least instead. The reserve
    is then decided in the same way, and its last two are landed. What the flight
    decides keeps its chance; what this last part decides keeps it only nearly, in favour of small documents.
    """
    reserve = reserve_of(rows, tokens, pi)
    if last:
        undecided = [i for i in rows if EPS < pi[i] < 1 - EPS]
        largest = max((tokens[i] for i in undecided), default=0)
        reserve = max(reserve, {i for i in undecided if tokens[i] * SMALLER <= largest}, key=len)
    decided, undecided = flight([(i, tokens[i], pi[i]) for i in rows if i not in reserve], rng)
    before = {i: pi[i] for i in decided}
    for i, p in decided.items():
        pi[i] = p
    if not last:
        return
    kept = sorted(reserve)
    held, room = sum(tokens[i] for i in kept), sum(pi[i] * tokens[i] for i in kept)
    part = {i: pi[i] for i in undecided}

    def miss(x: tuple[float, ...]) -> float:
        left = room + sum((part[i] - v) * tokens[i] for i, v in zip(undecided, x, strict=True))
        return max(0.0, -left, left - held)

    drawn = tuple(float(rng.random() < pi[i]) for i in undecided)
    if miss(drawn) > 0:
        drawn = min(product((0.0, 1.0), repeat=len(undecided)), key=miss)
    for i, v in zip(undecided, drawn, strict=True):
        pi[i] = v
    if not kept:
        return
    want = room + sum((p - pi[i]) * tokens[i] for i, p in before.items())
    sizes = [tokens[i] for i in kept]
    moved = shifted([pi[i] for i in kept], sizes, want)
    for i, p in zip(kept, moved, strict=True):
        pi[i] = p
    if len(kept) > 2:
        return _decide(kept, tokens, pi, rng, True)
    for i, p in landing([(i, tokens[i], pi[i]) for i in kept]).items():
        pi[i] = p


def _fly(table: pa.Table, last: bool) -> pa.Table:
    """Decide the units of each (mix, source) of table by themselves."""
    cols = table.select(UNIT.names).to_pydict()
    groups: dict[tuple, list[int]] = defaultdict(list)
    for i, k in enumerate(zip(cols["mix_name"], cols["source"], strict=True)):
        groups[k].append(i)
    for key, rows in groups.items():
        rows.sort(key=lambda i: cols["doc_id"][i])
        # The order and the seed follow from the documents, so a task that runs again decides the same way.
        rng = random.Random(repr((key, len(rows), cols["doc_id"][rows[0]], cols["doc_id"][rows[-1]])))
        rng.shuffle(rows)
        _decide(rows, cols["tokens"], cols["pi"], rng, last)
    return pa.table(cols, schema=UNIT)


def _fly_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[pa.RecordBatch] = []
    held = 0
    for b in batches:
        if b.num_rows:
            rows.append(b)
            held += b.num_rows
        if held >= RUN_UNITS:
            yield from _fly(pa.Table.from_batches(rows), False).to_batches(max_chunksize=10_000)
            rows, held = [], 0
    if rows:
        yield from _fly(pa.Table.from_batches(rows), False).to_batches(max_chunksize=10_000)


def _flyer(last: bool) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        return _fly(table, last)

    return run


def plan(targets: DataFrame, counts: DataFrame, *, total_tokens: int | None = None) -> list[Target]:
    """The targets of each mix with what its sources offer and how often each document is to be used on average.

    Shares are made to add up to 1 over the sources that have documents. The total of a mix is total_tokens, or else the
    largest at which every source with documents reaches its share within its cap; with no cap in the mix, all tokens of
    its sources. Only documents larger than the whole target of their source are not used, unless all of them are.

    Only sums per source of a table of at most MAX_TARGETS rows come to the driver.
    """
    rows = targets.select("mix_name", "source", "target_share", "max_repeats").distinct().limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    found: dict[tuple[str, str], Target] = {}
    for mix, source, share, cap in sorted(rows, key=repr):
        if mix is None or source is None:
            continue
        t = found.setdefault((mix, source), Target(mix, source, 0.0, cap))
        t.given_share = max(t.given_share, share if share is not None and share > 0 and math.isfinite(share) else 0.0)
        t.cap = cap if t.cap is None else t.cap if cap is None else min(t.cap, cap)
    if not found:
        return []
    names = F.broadcast(counts.sparkSession.createDataFrame([(s,) for s in sorted({s for _, s in found})], "source string"))
    usable = counts.where(F.col("tokens") > 0).select("source", "tokens").join(names, "source")
    offer = {r["source"]: r for r in usable.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    by_mix: dict[str, list[Target]] = defaultdict(list)
    for t in found.values():
        if t.source in offer:
            t.available, t.n_docs = offer[t.source]["t"], offer[t.source]["n"]
        by_mix[t.mix_name].append(t)
    for mix in by_mix.values():
        live = [t for t in mix if t.available and t.given_share > 0 and (t.cap is None or t.cap > 0)]
        whole = sum(t.given_share for t in live)
        for t in live:
            t.share = t.given_share / whole
        reach = [t.available * t.cap / t.share for t in live if t.cap is not None]
        total = total_tokens if total_tokens is not None else min(reach) if reach else sum(t.available for t in live)
        for t in live:
            t.target_tokens = t.share * total
    live = [t for t in found.values() if t.target_tokens > 0]
    if live:
        limits = F.broadcast(counts.sparkSession.createDataFrame([(t.mix_name, t.source, t.target_tokens) for t in live], "mix_name string, source string, target_ double"))
        fits = F.sum(F.when(F.col("tokens") <= F.floor("target_"), F.col("tokens")).otherwise(0)).alias("fits")
        fitting = {(r["mix_name"], r["source"]): r["fits"] for r in usable.join(limits, "source").groupBy("mix_name", "source").agg(fits).collect()}
        for t in live:
            tokens = fitting[t.mix_name, t.source]
            t.usable, t.limit = (tokens, math.floor(t.target_tokens)) if tokens else (t.available, 1 << 62)
            t.uses = t.target_tokens / t.usable if t.cap is None else min(float(t.cap), t.target_tokens / t.usable)
    return list(found.values())


def mix(counts: DataFrame, targets: list[Target], *, task_units: int = TASK_UNITS) -> DataFrame:
    """(mix_name, source, doc_id, tokens, uses): how often each document of the mixes' sources is used.

    Every usable document is used floor(u) times, u being the source's average, and once more with probability u - floor(u).
    These probabilities are decided by the cube method: each partition moves them through the null space of its token and
    document totals, for each mix and source by itself, until at most two documents and a small reserve are undecided; the
    undecided ones are gathered in rounds, in groups of at most about task_units. In the last round the landing decides
    the last two, and the reserve of small documents makes up for the tokens that were rounded away.

    Defined cases: documents without tokens and those too large for their source's target are used 0 times; a source with a
    share of 0, without documents or with a cap of 0 contributes nothing; sources of no mix are left out.
    """
    spark = counts.sparkSession
    if not targets:
        return spark.createDataFrame([], "mix_name string, source string, doc_id bigint, tokens bigint, uses bigint")
    dims = spark.createDataFrame([(t.mix_name, t.source, t.uses, t.limit) for t in targets], "mix_name string, source string, u_ double, limit_ bigint")
    named = counts.where(F.col("source").isNotNull()).select("source", "doc_id", "tokens")
    units = dealt(named, len({t.mix_name for t in targets}), PART_UNITS).join(F.broadcast(dims), "source")
    u = F.when((F.col("tokens") > 0) & (F.col("tokens") <= F.col("limit_")), F.col("u_")).otherwise(F.lit(0.0))
    base = F.floor(u + F.lit(EPS)).cast("bigint")
    units = units.select("mix_name", "source", "doc_id", "tokens", base.alias("base"), F.greatest(u - base, F.lit(0.0)).alias("pi"))
    flown = cut(units.mapInArrow(_fly_partition, UNIT_DDL))
    undecided = (F.col("pi") > 0) & (F.col("pi") < 1)
    done = [flown.where(~undecided)]
    while True:
        left = flown.where(undecided)
        most = left.groupBy("mix_name", "source").count().agg(F.max("count")).collect()[0][0] or 0
        if not most:
            break
        buckets = -(-most // task_units)
        last = buckets == 1
        keyed = left.select("*", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket_"))
        flown = cut(keyed.groupBy("mix_name", "source", "bucket_").applyInArrow(_flyer(last), UNIT_DDL))
        done.append(flown.where(~undecided))
        if last:
            break
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.select("mix_name", "source", "doc_id", "tokens", (F.col("base") + F.round("pi").cast("bigint")).alias("uses"))


def shares(uses: DataFrame, targets: list[Target]) -> DataFrame:
    """Per mix and source: target and actual share, tokens, documents used, and most uses of one document."""
    spark = uses.sparkSession
    got = uses.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count_if(F.col("uses") > 0).alias("docs_used"), F.max("uses").alias("most_uses"))
    whole = got.groupBy("mix_name").agg(F.sum("tokens").alias("all_"))
    schema = "mix_name string, source string, given_share double, target_share double, target_tokens double, max_repeats int, docs bigint, available_tokens bigint"
    want = spark.createDataFrame([(t.mix_name, t.source, t.given_share, t.share, t.target_tokens, t.cap, t.n_docs, t.available) for t in targets], schema)
    both = want.join(got, ["mix_name", "source"], "left").join(whole, "mix_name", "left")
    actual = F.when(F.col("all_") > 0, F.coalesce("tokens", F.lit(0)) / F.col("all_")).otherwise(F.lit(0.0))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("tokens", "docs_used", "most_uses")]
    return both.select("mix_name", "source", "given_share", "target_share", actual.alias("actual_share"), "target_tokens", *zero, "max_repeats", "docs", "available_tokens")
