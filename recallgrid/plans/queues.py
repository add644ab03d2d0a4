"""Deck trees, and gathering of due cards under limits that hold at every level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid.functions import text as tx
from recallgrid.model import CLOCK as T
from recallgrid.model import small_rows
from recallgrid.operators import hierarchy as hi
from recallgrid.operators.skew import join_one_to_many
from recallgrid.operators.sliced import numbered
from recallgrid.plans import base
from recallgrid.plans.base import query
from recallgrid.plans.searches import salt_of
from recallgrid.plans.stats import HOME, LEARN_CUTOFF, TODAY_MS, count, due_counts
from recallgrid.tables import table

c = F.col
PATHS_SQL = ", dp AS (SELECT *, string_split(name, chr(31)) AS path FROM d), up AS (SELECT dp.*, array_to_string(path[1:k], chr(31)) AS above FROM dp, (SELECT unnest(range(1, 100)) AS k) WHERE k <= len(path))"
COUNTS = ["new", "review", "interday", "intraday", "total"]
COUNTS_SQL = f"""(SELECT did, count(*) FILTER (queue = 0) AS new, count(*) FILTER (queue = 2 AND due <= {T.days_elapsed}) AS review, count(*) FILTER (queue = 3 AND due <= {T.days_elapsed}) AS interday,
  count(*) FILTER ((queue = 1 AND due < {LEARN_CUTOFF}) OR (queue = 4 AND due <= {LEARN_CUTOFF})) AS intraday, count(*) AS total FROM c GROUP BY did)"""


@query("h1_deck_tree", PATHS_SQL + "SELECT id, name, CAST(len(path) AS INTEGER) AS level, CASE WHEN len(path) > 1 THEN array_to_string(path[1:len(path) - 1], chr(31)) END AS parent, path[len(path)] AS leaf FROM dp")
def deck_tree(spark: SparkSession, d: str) -> DataFrame:
    rows = hi.with_path(base.decks(spark, d))
    return rows.select("id", "name", "level", "parent", F.element_at("path", -1).alias("leaf")).orderBy("path")


@query("h2_tree_counts", f"SELECT d.id, d.name, {', '.join(f'coalesce(k.{x}, 0) AS {x}' for x in COUNTS)} FROM d LEFT JOIN {COUNTS_SQL} k ON k.did = d.id")
def tree_counts(spark: SparkSession, d: str) -> DataFrame:
    """Due counts on the tree; decks without cards have zeros."""
    counts = due_counts(spark, d)
    return base.decks(spark, d).select("id", "name").join(counts, c("id") == c("did"), "left").select("id", "name", *[F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in COUNTS])


#: Limits of the registered queries, by preset.
PRESET_LIMITS = {1: hi.Limit(200, 20), 2: hi.Limit(15, 5), 3: hi.Limit(40, 10, True), 4: hi.Limit(9999, 3)}


def capped_tree_sql(depth: int = 4) -> str:
    """The fold by levels from the deepest up; limits are those of a deck and of all that exist above it."""
    presets = ", ".join(f"({k}, {x.review}, {x.new}, {str(x.new_within_review).lower()})" for k, x in PRESET_LIMITS.items())
    config = "TRY_CAST(json_extract_string(CASE WHEN json_valid(d.kind) THEN d.kind END, '$.normal.config_id') AS INTEGER)"
    steps = [
        f"lim AS (SELECT d.name, coalesce(p.rl, 9999) AS rl, coalesce(p.nl, 9999) AS nl, coalesce(p.within, false) AS within FROM d LEFT JOIN (VALUES {presets}) p(config, rl, nl, within) ON p.config = {config})",
        "eff AS (SELECT k.name, min(a.rl) AS rl, min(a.nl) AS nl, any_value(k.within) AS within FROM lim k JOIN lim a ON a.name = k.name OR starts_with(k.name, a.name || chr(31)) GROUP BY k.name)",
        f"b AS (SELECT d.name, len(string_split(d.name, chr(31))) AS lvl, array_to_string(string_split(d.name, chr(31))[1:-2], chr(31)) AS parent, rl, nl, within, {', '.join(f'coalesce(k.{x}, 0) AS {x}' for x in COUNTS)} FROM d JOIN eff USING (name) LEFT JOIN {COUNTS_SQL} k ON k.did = d.id)",
        "known AS (SELECT * FROM b WHERE lvl = 1 OR parent IN (SELECT name FROM d))",
        f"o{depth + 1} AS (SELECT name, parent, new, review, intraday, interday, total FROM known WHERE false)",
    ]
    for level in range(depth, 0, -1):
        sums = ", ".join(f"any_value(k.{x}) + coalesce(sum(u.{x}), 0) AS {x}" for x in COUNTS)
        steps.append(f"s{level} AS (SELECT k.name, any_value(k.parent) AS parent, any_value(rl) AS rl, any_value(nl) AS nl, any_value(within) AS within, {sums} FROM known k LEFT JOIN o{level + 1} u ON u.parent = k.name WHERE lvl = {level} GROUP BY k.name)")
        steps.append(f"i{level} AS (SELECT * REPLACE (least(interday, rl) AS interday, least(review, rl - least(interday, rl)) AS review) FROM s{level})")
        steps.append(f"o{level} AS (SELECT name, parent, CASE WHEN within THEN least(new, nl, greatest(rl - interday - review, 0)) ELSE least(new, nl) END AS new, review, intraday, interday, total FROM i{level})")
    whole = " UNION ALL ".join(f"SELECT name, CAST(new AS BIGINT) AS new, CAST(review AS BIGINT) AS review, CAST(intraday + interday AS BIGINT) AS learn, CAST(total AS BIGINT) AS total FROM o{level}" for level in range(1, depth + 1))
    return ", " + ", ".join(steps) + " " + whole


@query("h3_capped_tree", capped_tree_sql())
def capped_tree(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each deck with its children under daily limits; the fold runs over one row per deck, a dimension."""
    col = base.collection(spark, d)
    rows = small_rows(tree_counts(spark, d))
    own = {r["name"]: hi.Counts(r["new"], r["review"], r["intraday"], r["interday"], r["total"]) for r in rows}
    limits = {x.name: PRESET_LIMITS.get(x.config_id, hi.Limit()) for x in col.catalog.decks}
    found = hi.capped_tree(own, limits)
    return spark.createDataFrame([(n, v["new"], v["review"], v["learn"], v["total"]) for n, v in found.items()], "name string, new bigint, review bigint, learn bigint, total bigint")


@query("h4_totals", PATHS_SQL + f"SELECT above AS name, {', '.join(f'CAST(sum(coalesce(k.{x}, 0)) AS BIGINT) AS {x}' for x in COUNTS)} FROM up LEFT JOIN {COUNTS_SQL} k ON k.did = up.id GROUP BY above")
def totals(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each deck with all decks below it."""
    return hi.rolled_up(tree_counts(spark, d), "name", COUNTS)


@query("h7_visible_decks", "SELECT id, name FROM d WHERE NOT (id = 1 AND NOT EXISTS (SELECT 1 FROM d k WHERE starts_with(k.name, d.name || chr(31))) AND (SELECT count(*) FROM d) > 1)")
def visible_decks(spark: SparkSession, d: str) -> DataFrame:
    """All decks but the default one, if that has no children and is not the only deck."""
    decks = hi.with_path(base.decks(spark, d))
    parents = decks.select(c("parent").alias("name")).where(c("name").isNotNull()).distinct().withColumn("has", F.lit(True))
    more = decks.agg(F.count(F.lit(1)) > 1).scalar()
    return decks.select("id", "name").join(parents, "name", "left").where(~((c("id") == 1) & c("has").isNull() & more)).select("id", "name")


@query("h8_missing_parents", PATHS_SQL + "SELECT DISTINCT above AS name FROM up WHERE above NOT IN (SELECT name FROM d)")
def missing_parents(spark: SparkSession, d: str) -> DataFrame:
    return hi.missing_parents(base.decks(spark, d).select("name"))


TAGS_SQL = ", t AS (SELECT DISTINCT n.id, unnest(list_filter(regexp_split_to_array(n.tags, '[ 　]'), lambda x: x <> '')) AS tag FROM n), tu AS (SELECT DISTINCT t.id, array_to_string(string_split(tag, '::')[1:k], '::') AS tag FROM t, (SELECT unnest(range(1, 100)) AS k) WHERE k <= len(string_split(tag, '::')))"


@query("h9_tag_tree", TAGS_SQL + "SELECT tag, CAST(len(string_split(tag, '::')) AS INTEGER) AS level, count(*) AS notes FROM tu GROUP BY tag")
def tag_tree(spark: SparkSession, d: str) -> DataFrame:
    """Tags with their parents and the number of notes at or below each, without regard to case in the order."""
    tags = base.notes(spark, d).select("id", F.explode(tx.tag_list(c("tags"))).alias("tag"))
    up = tags.select("id", F.explode(hi.prefixes(F.split("tag", "::"), "::")).alias("tag")).distinct()
    return up.groupBy("tag").agg(F.first(F.size(F.split("tag", "::"))).alias("level"), count("notes")).orderBy(F.lower("tag"))


@query("h10_all_tags", TAGS_SQL + "SELECT DISTINCT tag FROM tu")
def all_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = base.notes(spark, d).select(F.explode(tx.tag_list(c("tags"))).alias("tag")).distinct()
    return tags.select(F.explode(hi.prefixes(F.split("tag", "::"), "::")).alias("tag")).distinct()


@query("h11_descendants", "SELECT p.id, k.id AS child_id, CAST(len(string_split(k.name, chr(31))) - len(string_split(p.name, chr(31))) AS INTEGER) AS depth FROM d p JOIN d k ON starts_with(k.name, p.name || chr(31))")
def descendants(spark: SparkSession, d: str) -> DataFrame:
    """(id, child_id, depth) of each deck and the decks below it: a join on ancestor names, not on prefixes."""
    decks = hi.with_path(base.decks(spark, d))
    up = decks.select(c("id").alias("child_id"), c("level").alias("child_level"), F.explode(hi.prefixes(c("path"))).alias("name"))
    return up.join(decks.select("id", "name", "level"), "name").where(c("child_level") > c("level")).select("id", "child_id", (c("child_level") - c("level")).alias("depth"))


@query("u1_used_decks", "SELECT did FROM c UNION SELECT odid FROM c WHERE odid <> 0")
def used_decks(spark: SparkSession, d: str) -> DataFrame:
    """Distinct home and current decks of all cards."""
    return base.cards(spark, d).select(F.explode(F.array("did", F.when(c("odid") != 0, c("odid")).otherwise(c("did")))).alias("did")).distinct()


@query("u2_field_names", "SELECT DISTINCT f.name FROM notetype_fields f WHERE f.ntid IN (SELECT mid FROM n)")
def field_names(spark: SparkSession, d: str) -> DataFrame:
    used = base.notes(spark, d).select(c("mid").alias("ntid")).distinct()
    return table(spark, d, "notetype_fields", "ntid", "name").join(used, "ntid", "left_semi").select("name").distinct()


@query("u3_unused_notetypes", "SELECT DISTINCT id FROM notetypes EXCEPT SELECT mid FROM n")
def unused_notetypes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notetypes", "id").distinct().join(base.notes(spark, d).select(c("mid").alias("id")), "id", "left_anti")


@query("j3_types_checksums_decks", f"SELECT DISTINCT n.mid, n.csum, {HOME} AS did FROM n JOIN c ON c.nid = n.id")
def types_checksums_decks(spark: SparkSession, d: str) -> DataFrame:
    home = base.cards(spark, d).select("nid", F.when(c("odid") == 0, c("did")).otherwise(c("odid")).alias("did")).distinct()
    return base.notes(spark, d).select("id", "mid", "csum").join(home, c("id") == c("nid")).select("mid", "csum", "did").distinct()


@query("j7_missing_decks", "SELECT did, count(*) AS n FROM c WHERE did IS NOT NULL AND did NOT IN (SELECT id FROM d) GROUP BY did")
def missing_decks(spark: SparkSession, d: str) -> DataFrame:
    """Decks that cards are in but that do not exist."""
    per = base.cards(spark, d).where(c("did").isNotNull()).groupBy("did").agg(count())
    return per.join(base.decks(spark, d).select(c("id").alias("did")), "did", "left_anti")


@query("w8_first_card_deck", "SELECT nid, arg_min(did, (ord, id)) AS did FROM (SELECT nid, coalesce(did, -1) AS did, ord, id FROM c) GROUP BY nid")
def first_card_deck(spark: SparkSession, d: str) -> DataFrame:
    """The deck of each note's card with the lowest number."""
    return base.cards(spark, d).groupBy("nid").agg(F.min_by(F.coalesce("did", F.lit(-1)), F.struct("ord", "id")).alias("did"))


@query("w9_new_positions", "SELECT c.id, CAST(10 + 5 * (dense_rank() OVER (ORDER BY nid) - 1) AS BIGINT) AS position FROM c WHERE type = 0")
def new_positions(spark: SparkSession, d: str, start: int = 10, step: int = 5) -> DataFrame:
    """New positions by note, siblings together: a rank over all notes that no single task works out."""
    cards = base.cards(spark, d).where(c("type") == 0).select("id", "nid")
    ranks = numbered(cards.select("nid").distinct(), "nid", "rank_")
    return cards.join(ranks, "nid").select("id", (F.lit(start) + (c("rank_") - 1) * step).cast("bigint").alias("position"))


# --- gathering -------------------------------------------------------------------------------------------------------


def with_deck_path(cards: DataFrame, decks: DataFrame) -> DataFrame:
    """Cards of existing decks with the path of their deck; the side of decks is a dimension."""
    return cards.join(decks.select(c("id").alias("did"), hi.path_of(c("name"), "\x1f").alias("path")), "did")


@query("q1_intraday", f"SELECT id, due FROM c WHERE did IN (SELECT id FROM d) AND queue IN (1, 4) AND due <= {T.next_day_at}")
def intraday(spark: SparkSession, d: str) -> DataFrame:
    active = base.decks(spark, d).select(c("id").alias("did"))
    return base.cards(spark, d).join(active, "did", "left_semi").where(c("queue").isin(1, 4) & (c("due") <= T.next_day_at)).select("id", "due")


LIMITS = {"History": 30, "Languages": 20, "Law": 10, "Medicine": 50, "Geography": 5}
LIMIT_ROWS = ", ".join(f"('{n}', {k})" for n, k in LIMITS.items())
DEPTH = 8


@query("q2_gathered_reviews", f"""
, x AS (SELECT c.id, c.due, string_split(d.name, chr(31))[1] AS top FROM c JOIN d ON c.did = d.id WHERE c.queue = 2 AND c.due <= {T.days_elapsed}),
y AS (SELECT *, row_number() OVER (PARTITION BY top ORDER BY due, id) AS k FROM x)
SELECT id, due FROM y LEFT JOIN (VALUES {LIMIT_ROWS}) l(top, most) USING (top) WHERE most IS NULL OR k <= most""")
def gathered_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Due reviews by day, as many as the limits of their decks and of the decks above allow."""
    due = base.cards(spark, d).where((c("queue") == 2) & (c("due") <= T.days_elapsed))
    rows = with_deck_path(due, base.decks(spark, d)).select("id", "due", "path")
    return hi.within_limits(rows, "path", [c("due"), c("id")], LIMITS, DEPTH).select("id", "due")


HASH_SQL = tx.fnv_sql("c.nid", str(salt_of(T.days_elapsed)))


@query("q3_gathered_new", f"""
, x AS (SELECT c.id, c.nid, c.ord, CAST({HASH_SQL} AS BIGINT) AS hash, string_split(d.name, chr(31))[1] AS top FROM c JOIN d ON c.did = d.id WHERE c.queue = 0),
y AS (SELECT *, row_number() OVER (PARTITION BY top ORDER BY hash, ord, id) AS k FROM x)
SELECT id, nid, ord, hash FROM y LEFT JOIN (VALUES {LIMIT_ROWS}) l(top, most) USING (top) WHERE most IS NULL OR k <= most""")
def gathered_new(spark: SparkSession, d: str) -> DataFrame:
    """New cards in a random order of notes that is stable for the day, under the same limits."""
    new = base.cards(spark, d).where(c("queue") == 0)
    rows = with_deck_path(new, base.decks(spark, d)).select("id", "nid", "ord", "path", tx.fnv_hash(c("nid"), F.lit(salt_of(T.days_elapsed))).alias("hash"))
    return hi.within_limits(rows, "path", [c("hash"), c("ord"), c("id")], LIMITS, DEPTH).select("id", "nid", "ord", "hash")


# --- limits of the day -----------------------------------------------------------------------------------------------

PRESET_ROWS = ", ".join(f"({k}, {x.review}, {x.new}, {str(x.new_within_review).lower()})" for k, x in PRESET_LIMITS.items())
LIMITS_SQL = f"""
, seen AS (SELECT cid, min(id) AS first_, count(*) FILTER (id > {TODAY_MS} AND type = 1) AS reviews FROM r WHERE cid IS NOT NULL AND ease > 0 GROUP BY cid),
done AS (SELECT {HOME} AS did, count(*) FILTER (first_ > {TODAY_MS}) AS new_, CAST(sum(reviews) AS BIGINT) AS rev_ FROM seen JOIN c ON c.id = seen.cid GROUP BY 1),
preset AS (SELECT d.id, d.name, p.*, coalesce(done.new_, 0) AS new_, coalesce(done.rev_, 0) AS rev_ FROM d
  LEFT JOIN (VALUES {PRESET_ROWS}) p(config, per_review, per_new, within) ON p.config = TRY_CAST(json_extract_string(CASE WHEN json_valid(d.kind) THEN d.kind END, '$.normal.config_id') AS INTEGER) LEFT JOIN done ON done.did = d.id),
limits AS (SELECT id, name, CAST(CASE WHEN config IS NULL THEN 9999 ELSE greatest(per_review - rev_ - CASE WHEN within THEN new_ ELSE 0 END, 0) END AS BIGINT) AS review,
  CAST(CASE WHEN config IS NULL THEN 9999 WHEN within THEN greatest(least(per_new - new_, per_review - rev_ - new_), 0) ELSE greatest(per_new - new_, 0) END AS BIGINT) AS new FROM preset)"""


def remaining_limits(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, review, new): what each deck may still show today: the limits of its preset without what was answered.

    A card is new today if its first answer is of today. Where new cards count as reviews, they use up the review limit,
    and no more of them are shown than it allows. Decks without a preset have no limit. Answers are counted per card
    before they are joined.
    """
    rows = base.revlog(spark, d).where(c("cid").isNotNull() & (c("ease") > 0))
    seen = rows.groupBy("cid").agg((F.min("id") > TODAY_MS).cast("int").alias("new_"), F.count_if((c("id") > TODAY_MS) & (c("type") == 1)).alias("rev_"))
    home = base.cards(spark, d).select("id", F.when(c("odid") == 0, c("did")).otherwise(c("odid")).alias("did"))
    done = seen.join(home, c("cid") == c("id")).groupBy("did").agg(F.sum("new_").alias("new_"), F.sum("rev_").alias("rev_"))
    presets = F.broadcast(spark.createDataFrame([(k, x.review, x.new, x.new_within_review) for k, x in PRESET_LIMITS.items()], "config int, per_review int, per_new int, within boolean"))
    decks = base.decks(spark, d).select("id", "name", F.get_json_object("kind", "$.normal.config_id").try_cast("int").alias("config"))
    rows = decks.join(presets, "config", "left").join(done, c("id") == c("did"), "left")
    new, rev = F.coalesce("new_", F.lit(0)), F.coalesce("rev_", F.lit(0))
    within = F.coalesce("within", F.lit(False))
    review = F.greatest(c("per_review") - rev - F.when(within, new).otherwise(0), F.lit(0))
    fresh = F.greatest(F.when(within, F.least(c("per_new") - new, c("per_review") - rev - new)).otherwise(c("per_new") - new), F.lit(0))
    free = c("per_review").isNull()
    return rows.select("id", "name", F.when(free, 9999).otherwise(review).cast("bigint").alias("review"), F.when(free, 9999).otherwise(fresh).cast("bigint").alias("new"))


@query("h5_remaining_limits", LIMITS_SQL + " SELECT * FROM limits")
def h5_remaining_limits(spark: SparkSession, d: str) -> DataFrame:
    return remaining_limits(spark, d)


@query("h6_limit_tree", LIMITS_SQL + """
SELECT k.id, k.name, min(a.review) AS review, min(a.new) AS new FROM limits k JOIN limits a ON a.name = k.name OR starts_with(k.name, a.name || chr(31)) GROUP BY ALL""")
def limit_tree(spark: SparkSession, d: str) -> DataFrame:
    """The limits of each deck, no larger than those of the decks above it; a join on the names of ancestors."""
    own = remaining_limits(spark, d)
    up = own.select("id", "name", F.explode(hi.prefixes(hi.path_of(c("name"), "\x1f"))).alias("above"))
    return up.join(own.select(c("name").alias("above"), "review", "new"), "above").groupBy("id", "name").agg(F.min("review").alias("review"), F.min("new").alias("new"))


@query("m24_deck_stats", f"""
, seen AS (SELECT cid, min(id) AS first_, count(*) FILTER (id > {TODAY_MS} AND type = 1) AS reviews, sum(CASE WHEN id > {TODAY_MS} THEN time ELSE 0 END) AS ms, max(id) AS last_ FROM r WHERE cid IS NOT NULL AND ease > 0 GROUP BY cid),
own AS (SELECT {HOME} AS did, count(*) FILTER (first_ > {TODAY_MS}) AS new, sum(reviews) AS review, sum(ms) AS ms FROM seen JOIN c ON c.id = seen.cid WHERE last_ > {TODAY_MS} GROUP BY 1),
dp AS (SELECT d.id, string_split(d.name, chr(31)) AS path, own.* FROM d JOIN own ON own.did = d.id), up AS (SELECT dp.*, array_to_string(path[1:k], chr(31)) AS above FROM dp, (SELECT unnest(range(1, 100)) AS k) WHERE k <= len(path))
SELECT above AS name, CAST(sum(new) AS BIGINT) AS new, CAST(sum(review) AS BIGINT) AS review, CAST(sum(ms) AS BIGINT) AS ms FROM up GROUP BY above""")
def deck_stats(spark: SparkSession, d: str) -> DataFrame:
    """What was studied today in each deck and the decks below it: new cards, reviews and time."""
    rows = base.revlog(spark, d).where(c("cid").isNotNull() & (c("ease") > 0))
    today = c("id") > TODAY_MS
    seen = rows.groupBy("cid").agg((F.min("id") > TODAY_MS).cast("int").alias("new"), F.count_if(today & (c("type") == 1)).alias("review"), F.sum(F.when(today, c("time")).otherwise(0)).alias("ms"), F.max("id").alias("last_")).where(c("last_") > TODAY_MS)
    home = base.cards(spark, d).select("id", F.when(c("odid") == 0, c("did")).otherwise(c("odid")).alias("did"))
    own = seen.join(home, c("cid") == c("id")).groupBy("did").agg(*[F.sum(x).alias(x) for x in ("new", "review", "ms")])
    named = own.join(base.decks(spark, d).select(c("id").alias("did"), "name"), "did")
    return hi.rolled_up(named, "name", ["new", "review", "ms"])


def limited_sql(select: str, kind: str, order: str, depth: int = 4) -> str:
    """Rows (id, ..., name) that the limits of all levels allow, from the deepest level up."""
    steps = [f"x{depth} AS (SELECT *, string_split(name, chr(31)) AS path FROM ({select}))"]
    for level in range(depth, 0, -1):
        node = f"CASE WHEN len(path) >= {level} THEN array_to_string(path[1:{level}], chr(31)) END"
        ranked = f"SELECT *, {node} AS node, row_number() OVER (PARTITION BY {node} ORDER BY {order}) AS k FROM x{level}"
        steps.append(f"x{level - 1} AS (SELECT y.* EXCLUDE (node, k) FROM ({ranked}) y LEFT JOIN limits l ON l.name = y.node WHERE l.name IS NULL OR k <= l.{kind})")
    return LIMITS_SQL + ", " + ", ".join(steps)


def limited(spark: SparkSession, d: str, cards: DataFrame, kind: str, order: list[Column]) -> DataFrame:
    """The cards that today's limits of their decks and of all decks above allow; limits are one row per deck."""
    limits = {r["name"]: r[kind] for r in small_rows(remaining_limits(spark, d).select("name", kind))}
    return hi.within_limits(with_deck_path(cards, base.decks(spark, d)), "path", order, limits, DEPTH)


@query("q2_limited_reviews", limited_sql(f"SELECT c.id, c.due, d.name FROM c JOIN d ON c.did = d.id WHERE c.queue IN (2, 3) AND c.due <= {T.days_elapsed}", "review", "queue_ DESC, due, id").replace("SELECT c.id, c.due, d.name", "SELECT c.id, c.due, c.queue AS queue_, d.name") + " SELECT id, due FROM x0")
def limited_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Interday learning first, then reviews by day, under today's limits at every level."""
    due = base.cards(spark, d).where(c("queue").isin(2, 3) & (c("due") <= T.days_elapsed)).select("id", "did", "due", "queue")
    return limited(spark, d, due, "review", [c("queue").desc(), c("due"), c("id")]).select("id", "due")


NEW_SQL = "SELECT c.id, c.due, c.ord, {0} c.nid, d.name FROM c JOIN d ON c.did = d.id WHERE c.queue = 0"
#: Orders in which new cards are gathered, the columns by name; a minus is a falling one.
GATHER = {
    "deck": ["path", "due", "ord", "id"],
    "lowest_position": ["due", "ord", "id"],
    "highest_position": ["-due", "ord", "id"],
    "random_notes": ["note_hash", "ord", "id"],
    "random_cards": ["card_hash", "id"],
    "deck_then_random_notes": ["path", "note_hash", "ord", "id"],
}


def _gather(name: str) -> None:
    order_sql = ", ".join(f"{x[1:]} DESC" if x[0] == "-" else x for x in GATHER[name])
    salt = salt_of(T.days_elapsed)
    hashes = f"{HASH_SQL} AS note_hash, {tx.fnv_sql('c.id', str(salt))} AS card_hash,"

    @query(f"q3_limited_{name}", limited_sql(NEW_SQL.format(hashes), "new", order_sql) + " SELECT id FROM x0")
    def run(spark: SparkSession, d: str) -> DataFrame:
        new = base.cards(spark, d).where(c("queue") == 0).select("id", "did", "nid", "due", "ord", tx.fnv_hash(c("nid"), F.lit(salt)).alias("note_hash"), tx.fnv_hash(c("id"), F.lit(salt)).alias("card_hash"))
        return limited(spark, d, new, "new", [c(x[1:]).desc() if x[0] == "-" else c(x) for x in GATHER[name]]).select("id")


for _name in GATHER:
    _gather(_name)


KIND_SQL = f"CASE WHEN queue IN (1, 4) AND due <= {T.next_day_at} THEN 0 WHEN queue = 3 AND due <= {T.days_elapsed} THEN 1 WHEN queue = 2 AND due <= {T.days_elapsed} THEN 2 WHEN queue = 0 THEN 3 END"


@query("q4_buried_siblings", f"""
, k AS (SELECT id, nid, due, {KIND_SQL} AS kind FROM c)
SELECT id, CAST(kind AS INTEGER) AS kind FROM (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY kind, due, id) AS n FROM k WHERE kind IS NOT NULL AND nid IS NOT NULL) WHERE n > 1 AND kind > 0""")
def buried_siblings(spark: SparkSession, d: str) -> DataFrame:
    """Cards that a sibling hides which is gathered before them: learning of the day, other learning, reviews, new cards.

    Learning of the day is never hidden. Only the first card of each note is worked out, by a minimum that combines on the
    map side; notes with very many cards are matched by broadcast. Cards without a note have no siblings.
    """
    kind = F.when(c("queue").isin(1, 4) & (c("due") <= T.next_day_at), 0).when((c("queue") == 3) & (c("due") <= T.days_elapsed), 1).when((c("queue") == 2) & (c("due") <= T.days_elapsed), 2).when(c("queue") == 0, 3)
    rows = base.cards(spark, d).select("id", "nid", "due", kind.alias("kind")).where(c("kind").isNotNull() & c("nid").isNotNull())
    first = rows.groupBy("nid").agg(F.min(F.struct("kind", "due", "id"))["id"].alias("first_"), F.count(F.lit(1)).alias("n_"))
    return join_one_to_many(rows, first.where(c("n_") > 1), ["nid"], "n_").where((c("id") != c("first_")) & (c("kind") > 0)).select("id", "kind")


def interspersed(first: DataFrame, second: DataFrame, n1: int, n2: int) -> DataFrame:
    """Two ordered frames (id, pos from 0) mixed evenly: (id, source, place).

    The k-th row of the second comes after those of the first with (k + 1) * ratio >= i + 1, the ratio being
    (n1 + 1) / (n2 + 1); as positions are known, the order is a sort by one number.
    """
    ratio = (n1 + 1) / (n2 + 1)
    a = first.select("id", F.lit(1).alias("source"), (c("pos") + 1).cast("double").alias("place"))
    b = second.select("id", F.lit(2).alias("source"), ((c("pos") + 1) * ratio).alias("place"))
    return a.unionByName(b).orderBy("place", "source")


@query("q6_queue_counts", f"SELECT count(*) FILTER (queue = 0) AS new, count(*) FILTER (queue = 2 AND due <= {T.days_elapsed}) AS review, count(*) FILTER ((queue = 1 AND due < {LEARN_CUTOFF}) OR (queue = 4 AND due <= {LEARN_CUTOFF}) OR (queue = 3 AND due <= {T.days_elapsed})) AS learn FROM c")
def queue_counts(spark: SparkSession, d: str) -> DataFrame:
    q = due_counts(spark, d)
    return q.agg(F.sum("new").cast("bigint").alias("new"), F.sum("review").cast("bigint").alias("review"), F.sum(c("intraday") + c("interday")).cast("bigint").alias("learn"))


@query("q9_siblings", f"SELECT c.id FROM c WHERE queue IN (0, 2, 3) AND nid IN (SELECT nid FROM c JOIN r ON r.cid = c.id WHERE r.id >= {TODAY_MS - 20 * 86_400_000} AND r.ease > 0) AND id NOT IN (SELECT cid FROM r WHERE cid IS NOT NULL AND id >= {TODAY_MS - 20 * 86_400_000} AND ease > 0)")
def siblings(spark: SparkSession, d: str) -> DataFrame:
    """Waiting cards of notes of which another card was answered lately."""
    cards = base.cards(spark, d)
    seen = base.revlog(spark, d).where((c("id") >= TODAY_MS - 20 * 86_400_000) & (c("ease") > 0) & c("cid").isNotNull()).select(c("cid").alias("id")).distinct()
    notes = cards.join(seen, "id", "left_semi").select("nid").distinct()
    return cards.where(c("queue").isin(0, 2, 3)).join(notes, "nid", "left_semi").join(seen, "id", "left_anti").select("id")


@query("q10_load_histogram", f"""
SELECT TRY_CAST(json_extract_string(d.kind, '$.normal.config_id') AS BIGINT) AS preset, CAST(c.due - {T.days_elapsed} AS BIGINT) AS day, count(*) AS n, count(DISTINCT c.nid) AS notes
FROM c JOIN d ON d.id = {HOME} WHERE c.type = 2 AND c.queue <> -1 AND c.due - {T.days_elapsed} BETWEEN 0 AND 98 AND json_extract_string(d.kind, '$.normal.config_id') IS NOT NULL GROUP BY 1, 2""")
def load_histogram(spark: SparkSession, d: str, window: int = 99) -> DataFrame:
    """Cards and notes due per preset and day ahead."""
    presets = base.decks(spark, d).select(c("id").alias("home"), F.get_json_object("kind", "$.normal.config_id").try_cast("bigint").alias("preset")).where(c("preset").isNotNull())
    rows = base.cards(spark, d).where((c("type") == 2) & (c("queue") != -1)).withColumn("day", (c("due") - T.days_elapsed).cast("bigint")).where(c("day").between(0, window - 1))
    rows = rows.withColumn("home", F.when(c("odid") == 0, c("did")).otherwise(c("odid"))).join(presets, "home")
    return rows.groupBy("preset", "day").agg(count(), F.countDistinct("nid").cast("bigint").alias("notes"))


def interval_weight(n: Column, ivl: Column, sibling: Column, easy: Column) -> Column:
    """The weight of a day in load balancing: few cards, short intervals, no sibling, no easy day."""
    return F.when(n == 0, F.lit(1.0)).otherwise(F.pow(F.lit(1.0) / n, F.lit(2.15)) * F.pow(F.lit(1.0) / ivl, F.lit(3.0)) * sibling * easy)


@query("q11_day_weights", f"""
, g AS (SELECT TRY_CAST(json_extract_string(d.kind, '$.normal.config_id') AS BIGINT) AS preset, CAST(c.due - {T.days_elapsed} AS BIGINT) AS day, count(*) AS n FROM c JOIN d ON d.id = {HOME}
  WHERE c.type = 2 AND c.queue <> -1 AND c.due - {T.days_elapsed} BETWEEN 1 AND 98 AND json_extract_string(d.kind, '$.normal.config_id') IS NOT NULL GROUP BY 1, 2)
SELECT preset, day, round(pow(1.0 / n, 2.15) * pow(1.0 / day, 3), 9) AS weight FROM g""")
def day_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the days ahead that have cards; the draw among them is left to the caller."""
    rows = load_histogram(spark, d).where(c("day") >= 1)
    return rows.select("preset", "day", F.round(interval_weight(c("n"), c("day"), F.lit(1.0), F.lit(1.0)), 9).alias("weight"))


@query("q13_preset_load", f"""
, p AS (SELECT id, TRY_CAST(json_extract_string(kind, '$.normal.config_id') AS BIGINT) AS preset FROM d WHERE json_extract_string(kind, '$.normal.config_id') IS NOT NULL),
k AS (SELECT {HOME} AS home, c.* FROM c)
SELECT preset, CAST(sum(due_) AS BIGINT) AS due, CAST(sum(seen) AS BIGINT) AS reviewed FROM (
  SELECT p.preset, CASE WHEN k.type = 2 AND k.queue <> -1 AND (CASE WHEN k.odid = 0 THEN k.due ELSE k.odue END) <= {T.days_elapsed} THEN 1 ELSE 0 END AS due_,
         CASE WHEN k.id IN (SELECT cid FROM r WHERE cid IS NOT NULL AND id > {TODAY_MS - 6 * 86_400_000} AND ease > 0 AND (type < 3 OR factor <> 0)) THEN 1 ELSE 0 END AS seen FROM k JOIN p ON p.id = k.home) GROUP BY preset""")
def preset_load(spark: SparkSession, d: str) -> DataFrame:
    """Due and lately reviewed cards per preset."""
    since = TODAY_MS - 6 * 86_400_000
    seen = base.revlog(spark, d).where((c("id") > since) & (c("ease") > 0) & ((c("type") < 3) | (c("factor") != 0)) & c("cid").isNotNull()).select(c("cid").alias("id")).distinct().withColumn("seen", F.lit(1))
    presets = base.decks(spark, d).select(c("id").alias("home"), F.get_json_object("kind", "$.normal.config_id").try_cast("bigint").alias("preset")).where(c("preset").isNotNull())
    due = (c("type") == 2) & (c("queue") != -1) & (F.when(c("odid") == 0, c("due")).otherwise(c("odue")) <= T.days_elapsed)
    rows = base.cards(spark, d).join(seen, "id", "left").select(F.when(c("odid") == 0, c("did")).otherwise(c("odid")).alias("home"), F.when(due, 1).otherwise(0).alias("due"), F.coalesce("seen", F.lit(0)).alias("seen"))
    return rows.join(presets, "home").groupBy("preset").agg(F.sum("due").cast("bigint").alias("due"), F.sum("seen").cast("bigint").alias("reviewed"))


@query("t215_note_rows", f"""
SELECT nid, count(*) AS cards, CAST(sum(reps) AS BIGINT) AS reps, CAST(sum(lapses) AS BIGINT) AS lapses, max(mod) AS card_mod, count(DISTINCT did) AS decks,
  min(due) FILTER (odid = 0 AND type <> 0 AND queue > 0) AS due, CAST(sum(factor) FILTER (type <> 0) // count(*) FILTER (type <> 0) // 10 AS BIGINT) AS ease, round(avg(ivl) FILTER (type IN (2, 3)), 6) AS ivl FROM c GROUP BY nid""")
def note_rows(spark: SparkSession, d: str) -> DataFrame:
    """Browser columns of notes: one aggregate for a whole page instead of a query per row."""
    def only(x: str, w: Column) -> Column:
        return F.when(w, c(x))

    aggs = [
        count("cards"), F.sum("reps").cast("bigint").alias("reps"), F.sum("lapses").cast("bigint").alias("lapses"), F.max("mod").alias("card_mod"), F.countDistinct("did").cast("bigint").alias("decks"),
        F.min(only("due", (c("odid") == 0) & (c("type") != 0) & (c("queue") > 0))).alias("due"), F.sum(only("factor", c("type") != 0)).alias("f_"), F.count(only("factor", c("type") != 0)).alias("k_"), F.round(F.avg(only("ivl", c("type").isin(2, 3))), 6).alias("ivl"),
    ]
    ease = F.when(c("k_") > 0, F.floor(F.floor(c("f_") / c("k_")) / 10)).cast("bigint")
    return base.cards(spark, d).groupBy("nid").agg(*aggs).select("nid", "cards", "reps", "lapses", "card_mod", "decks", "due", ease.alias("ease"), "ivl")

