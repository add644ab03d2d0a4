"""Merges, imports, integrity checks and bulk edits as named queries over the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.functions import text as tx
from recallgrid.operators import hierarchy as hi
from recallgrid.operators import merge, replay
from recallgrid.plans import base
from recallgrid.plans.base import query
from recallgrid.plans.searches import deck_sql, first_sql
from recallgrid.plans.stats import count, n_if
from recallgrid.search.compile import find_cards
from recallgrid.tables import table

c = F.col
#: Change number that parts the feed into a local and a remote side.
SIDE = 51_050
LATEST = "row_number() OVER (PARTITION BY id ORDER BY usn DESC, mod DESC)"


def side(spark: SparkSession, d: str, remote: bool) -> DataFrame:
    """The latest version of each card on one side of a change number; pending rows are local."""
    rows = table(spark, d, "cards").where((c("usn") > SIDE) if remote else (c("usn") <= SIDE))
    return rows.groupBy("id").agg(F.max(F.struct("usn", "mod", F.struct(*rows.columns).alias("row_"))).alias("x_")).select("x_.row_.*")


def side_sql(remote: bool) -> str:
    op = ">" if remote else "<="
    return f"(SELECT * EXCLUDE (k_) FROM (SELECT *, {LATEST} AS k_ FROM (SELECT DISTINCT * FROM cards WHERE usn {op} {SIDE})) WHERE k_ = 1)"


@query("m2_insert_or_ignore", f", l AS {side_sql(False)}, m AS {side_sql(True)} SELECT id, usn, mod FROM l UNION ALL SELECT id, usn, mod FROM m WHERE id NOT IN (SELECT id FROM l)")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    return merge.insert_or_ignore(side(spark, d, False), side(spark, d, True), ["id"]).select("id", "usn", "mod")


@query("m3_upsert", f", l AS {side_sql(False)}, m AS {side_sql(True)} SELECT id, usn, mod FROM m UNION ALL SELECT id, usn, mod FROM l WHERE id NOT IN (SELECT id FROM m)")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    return merge.upsert(side(spark, d, False), side(spark, d, True), ["id"]).select("id", "usn", "mod")


@query("m4_sync_merge", f""", l AS {side_sql(False)}, m AS {side_sql(True)}
SELECT coalesce(l.id, m.id) AS id, CASE WHEN l.id IS NULL OR (m.id IS NOT NULL AND (l.usn <> -1 OR l.mod < m.mod)) THEN m.usn ELSE l.usn END AS usn,
       CASE WHEN l.id IS NULL OR (m.id IS NOT NULL AND (l.usn <> -1 OR l.mod < m.mod)) THEN m.mod ELSE l.mod END AS mod FROM l FULL JOIN m ON l.id = m.id""")
def sync_merge(spark: SparkSession, d: str) -> DataFrame:
    """Last writer wins, unless the local row is pending and not older."""
    return merge.sync_rows(side(spark, d, False), side(spark, d, True)).select("id", "usn", "mod")


@query("m5_revlog_merge", f"SELECT id, coalesce(min(usn) FILTER (usn <= {SIDE}), min(usn)) AS usn FROM revlog WHERE id IS NOT NULL GROUP BY id")
def revlog_merge(spark: SparkSession, d: str) -> DataFrame:
    """Reviews of both sides, each id once: inserting again changes nothing, so late rows need no rule."""
    rows = table(spark, d, "revlog", "id", "usn").where(c("id").isNotNull())
    local, remote = rows.where(c("usn") <= SIDE), rows.where(c("usn") > SIDE)
    first = F.min("usn").alias("usn")
    return merge.insert_or_ignore(local.groupBy("id").agg(first), remote.groupBy("id").agg(first), ["id"])


@query("m6_deck_merge", "SELECT id, max(mtime_secs) AS mtime_secs FROM decks GROUP BY id")
def deck_merge(spark: SparkSession, d: str) -> DataFrame:
    """Decks of two sides, the newer by modification time."""
    rows = table(spark, d, "decks", "id", "name", "mtime_secs", "usn").distinct()
    return merge.sync_dimension(rows.where(c("usn") <= 30), rows.where(c("usn") > 30)).select("id", "mtime_secs")


@query("m6_notetype_merge", "SELECT id, arg_max(name, (mtime_secs, usn > 30)) AS name FROM (SELECT DISTINCT id, name, mtime_secs, usn FROM notetypes) GROUP BY id")
def notetype_merge(spark: SparkSession, d: str) -> DataFrame:
    """Note types of two sides, the newer by modification time."""
    rows = table(spark, d, "notetypes", "id", "name", "mtime_secs", "usn").distinct()
    return merge.sync_dimension(rows.where(c("usn") <= 30), rows.where(c("usn") > 30)).select("id", "name")


@query("m7_graves_applied", "SELECT id FROM notes WHERE id NOT IN (SELECT oid FROM graves WHERE type = 1) GROUP BY id")
def graves_applied(spark: SparkSession, d: str) -> DataFrame:
    """Notes without all that were ever deleted."""
    kept, _ = merge.bury_with_tombstones(table(spark, d, "notes", "id").distinct(), base.graves(spark, d, 1).select(c("oid").alias("id")), "id", 1)
    return kept


@query("m8_pending_chunk", "SELECT id FROM c WHERE usn = -1 ORDER BY id LIMIT 250")
def pending_chunk(spark: SparkSession, d: str) -> DataFrame:
    return merge.pending(base.cards(spark, d), c("usn"), 250).select("id")


@query("m10_export_notes", f", x AS (SELECT DISTINCT nid FROM c WHERE {deck_sql('law')}) SELECT n.id, len(list_filter(list_filter(regexp_split_to_array(n.tags, '[ 　]'), lambda t: t <> ''), lambda t: lower(t) NOT IN ('marked', 'leech'))) AS tags FROM n JOIN x ON x.nid = n.id")
def export_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes of a search for export, without the tags that are about studying."""
    col = base.collection(spark, d)
    nids = col.cards.join(find_cards(col, "deck:law"), "id", "left_semi").select(c("nid").alias("id")).distinct()
    rows = col.notes.join(nids, "id", "left_semi")
    return rows.select("id", F.size(merge.remove_tags(tx.tag_list(c("tags")), ["marked", "leech"])).cast("bigint").alias("tags"))


@query("m10_export_decks", f", x AS (SELECT DISTINCT did FROM c WHERE {deck_sql('law')}), y AS (SELECT unnest(range(1, 100)) AS k) SELECT DISTINCT array_to_string(string_split(d.name, chr(31))[1:k], chr(31)) AS name FROM d JOIN x ON x.did = d.id, y WHERE k <= len(string_split(d.name, chr(31)))")
def export_decks(spark: SparkSession, d: str) -> DataFrame:
    """Decks of a search for export, with all decks above them."""
    col = base.collection(spark, d)
    used = col.cards.join(find_cards(col, "deck:law"), "id", "left_semi").select(c("did").alias("id")).distinct()
    return base.decks(spark, d).join(used, "id", "left_semi").select(F.explode(hi.prefixes(hi.path_of(c("name"), "\x1f"))).alias("name")).distinct()


@query("m10_export_notetypes", f"SELECT DISTINCT t.id, t.name, x.ord, x.name AS field FROM notetypes t JOIN notetype_fields x ON x.ntid = t.id WHERE t.id IN (SELECT mid FROM n WHERE id IN (SELECT nid FROM c WHERE {deck_sql('law')}))")
def export_notetypes(spark: SparkSession, d: str) -> DataFrame:
    """Note types of a search for export, with their fields."""
    col = base.collection(spark, d)
    nids = col.cards.join(find_cards(col, "deck:law"), "id", "left_semi").select(c("nid").alias("id"))
    used = col.notes.join(nids, "id", "left_semi").select(c("mid").alias("id")).where(c("id").isNotNull()).distinct()
    fields = table(spark, d, "notetype_fields", "ntid", "ord", "name").select(c("ntid").alias("id"), "ord", c("name").alias("field"))
    return table(spark, d, "notetypes", "id", "name").join(F.broadcast(used), "id", "left_semi").join(fields, "id").distinct()


@query("m10_export_presets", f"SELECT DISTINCT TRY_CAST(json_extract_string(CASE WHEN json_valid(kind) THEN kind END, '$.normal.config_id') AS INTEGER) AS preset FROM d WHERE id IN (SELECT did FROM c WHERE {deck_sql('law')})")
def export_presets(spark: SparkSession, d: str) -> DataFrame:
    """Presets of the decks of a search for export."""
    col = base.collection(spark, d)
    used = col.cards.join(find_cards(col, "deck:law"), "id", "left_semi").select(c("did").alias("id"))
    return base.decks(spark, d).join(used, "id", "left_semi").select(F.get_json_object("kind", "$.normal.config_id").try_cast("int").alias("preset")).distinct()


@query("m11_text_import", f"""
, x AS (SELECT id, mid, CASE WHEN id % 2 = 1 THEN nullif(guid, '') END AS key, guid, usn > {SIDE} OR usn = -1 AS newer, {first_sql('flds')} AS f FROM n), i AS (SELECT * FROM x WHERE newer),
g AS (SELECT guid, min(id) AS nid FROM x WHERE NOT newer GROUP BY 1), o AS (SELECT mid, f, min(id) AS nid, count(*) AS k FROM x WHERE NOT newer GROUP BY 1, 2)
SELECT i.id, CASE WHEN g.nid IS NOT NULL THEN 'same_guid' WHEN i.key IS NOT NULL THEN 'new' WHEN i.f = '' THEN 'empty_first' WHEN o.nid IS NULL THEN 'new' WHEN o.k > 1 THEN 'ambiguous' ELSE 'duplicate' END AS result, coalesce(g.nid, o.nid) AS nid
FROM i LEFT JOIN g ON g.guid = i.key LEFT JOIN o ON i.key IS NULL AND i.f <> '' AND i.mid = o.mid AND i.f = o.f""")
def text_import(spark: SparkSession, d: str) -> DataFrame:
    """What an import of the newer notes would do, every second of which comes without its guid.

    A note with a guid is matched by it alone; one without by its note type and first field without markup, by checksum and
    text. Empty first fields match nothing.
    """
    plain = tx.strip_html_keep_media(tx.field_at(c("flds"), 0))
    notes = base.notes(spark, d).select("id", "mid", "usn", "guid", plain.alias("f")).withColumn("sum_", tx.field_checksum(c("f")))
    newer = (c("usn") > SIDE) | (c("usn") == -1)
    old = notes.where(~newer)
    by_guid = old.groupBy(c("guid").alias("key")).agg(F.min("id").alias("guid_nid"))
    by_field = old.where(c("f") != "").groupBy("mid", "sum_", "f").agg(F.min("id").alias("nid"), count("k"))
    new = notes.where(newer).select("id", "mid", "sum_", "f", F.when(c("id") % 2 == 1, F.nullif("guid", F.lit(""))).alias("key"))
    named = new.where(c("key").isNotNull()).join(by_guid, "key", "left").select("id", F.when(c("guid_nid").isNotNull(), "same_guid").otherwise("new").alias("result"), c("guid_nid").alias("nid"))
    rest = new.where(c("key").isNull()).join(by_field, ["mid", "sum_", "f"], "left")
    result = F.when(c("f") == "", "empty_first").when(c("nid").isNull(), "new").when(c("k") > 1, "ambiguous").otherwise("duplicate")
    return named.unionByName(rest.select("id", result.alias("result"), "nid"))


@query("m12_package_import", f"""
, i AS (SELECT id, guid, mid, mod FROM n WHERE usn > {SIDE} OR usn = -1), o AS (SELECT guid, max(mod) AS mod, min(mid) AS mid FROM n WHERE usn <= {SIDE} AND usn <> -1 GROUP BY guid)
SELECT i.id, CASE WHEN o.guid IS NULL THEN 'new' WHEN i.mid IS DISTINCT FROM o.mid THEN 'conflicting' WHEN i.mod > o.mod THEN 'updated' ELSE 'duplicate' END AS result FROM i LEFT JOIN o ON i.guid = o.guid""")
def package_import(spark: SparkSession, d: str) -> DataFrame:
    """What an import by guid would do if newer notes win."""
    notes = base.notes(spark, d)
    old = notes.where((c("usn") <= SIDE) & (c("usn") != -1)).groupBy("guid").agg(F.max("mod").alias("omod"), F.min("mid").alias("omid"), F.lit(True).alias("there"))
    both = notes.where((c("usn") > SIDE) | (c("usn") == -1)).join(old, "guid", "left")
    result = F.when(c("there").isNull(), "new").when(~c("mid").eqNullSafe(c("omid")), "conflicting").when(c("mod") > c("omod"), "updated").otherwise("duplicate")
    return both.select("id", result.alias("result"))


@query("m13_shifted_due", "SELECT id, CASE WHEN queue IN (2, 3) THEN greatest(due + 37, 0) ELSE due END AS due FROM c")
def shifted_due(spark: SparkSession, d: str, days: int = 37) -> DataFrame:
    """Cards of another collection: due days move by the difference of ages."""
    return base.cards(spark, d).select("id", F.when(c("queue").isin(2, 3), F.greatest(c("due") + days, F.lit(0))).otherwise(c("due")).alias("due"))


@query("m14_remapped_fields", "SELECT id, concat_ws(chr(31), coalesce(string_split(flds, chr(31))[2], ''), coalesce(string_split(flds, chr(31))[1], ''), '') AS flds FROM n")
def remapped_fields(spark: SparkSession, d: str) -> DataFrame:
    """Notes with their first two fields exchanged and an empty third one."""
    return base.notes(spark, d).select("id", merge.remap_fields(c("flds"), [1, 0, None]).alias("flds"))


@query("m15_find_replace", r"SELECT id, regexp_replace(flds, '(?i)the (\w+)', 'a \1', 'g') AS new_flds FROM n WHERE regexp_matches(flds, '(?i)the (\w+)')")
def find_replace(spark: SparkSession, d: str) -> DataFrame:
    return merge.find_and_replace(base.notes(spark, d), r"the (\w+)", "a $1").where("changed").select("id", "new_flds")


@query("m16_tags_added", "SELECT id, len(list_distinct(list_transform(list_filter(regexp_split_to_array(tags, '[ 　]'), lambda t: t <> '') || ['New::tag'], lambda t: lower(t)))) AS n FROM n")
def tags_added(spark: SparkSession, d: str) -> DataFrame:
    return base.notes(spark, d).select("id", F.size(merge.add_tags(tx.tag_list(c("tags")), ["New::tag"])).cast("bigint").alias("n"))


@query("m16_tag_renamed", "SELECT id FROM n WHERE len(list_filter(regexp_split_to_array(tags, '[ 　]'), lambda t: lower(t) = 'med' OR starts_with(lower(t), 'med::'))) > 0")
def tag_renamed(spark: SparkSession, d: str) -> DataFrame:
    """Notes that change when a tag gets another name, and their tags."""
    tags = tx.tag_list(c("tags"))
    return base.notes(spark, d).where(F.exists(merge.rename_tag(tags, "med", "renamed"), lambda t: F.startswith(t, F.lit("renamed")))).select("id")


TAGS_SQL = "list_filter(regexp_split_to_array(tags, '[ \u3000]'), lambda t: t <> '')"


@query("m16_tags_removed", f"SELECT id, len(list_distinct(list_transform(list_filter({TAGS_SQL}, lambda t: NOT (lower(t) = 'lang' OR starts_with(lower(t), 'lang::'))), lambda t: lower(t)))) AS n FROM n WHERE regexp_matches(tags, '(?i)(^|[ \u3000])lang(::|[ \u3000]|$)')")
def tags_removed(spark: SparkSession, d: str) -> DataFrame:
    """Notes that lose a tag and those below it, with the number of tags they keep."""
    rows = base.notes(spark, d).select("id", tx.tag_list(c("tags")).alias("old"))
    kept = merge.remove_tags(c("old"), ["lang"])
    hit = F.exists(c("old"), lambda t: (F.lower(t) == "lang") | F.startswith(F.lower(t), F.lit("lang::")))
    return rows.where(hit).select("id", F.size(F.array_distinct(F.transform(kept, F.lower))).alias("n"))


@query("m16_tags_in_use", f"SELECT t AS tag, count(DISTINCT id) AS n FROM (SELECT id, unnest({TAGS_SQL}) AS t FROM n) GROUP BY t")
def tags_in_use(spark: SparkSession, d: str) -> DataFrame:
    """Tags that notes have, with their number of notes; all others are to be cleared."""
    rows = base.notes(spark, d).select("id", F.explode(F.array_distinct(tx.tag_list(c("tags")))).alias("tag"))
    return rows.groupBy("tag").agg(count())


@query("m17_tag_completion", "SELECT DISTINCT tag FROM (SELECT unnest(regexp_split_to_array(tags, '[ 　]')) AS tag FROM n) WHERE lower(tag) LIKE '%me%' ORDER BY NOT starts_with(lower(tag), 'me'), lower(tag), tag LIMIT 20")
def tag_completion(spark: SparkSession, d: str) -> DataFrame:
    tags = base.notes(spark, d).select(F.explode(tx.tag_list(c("tags"))).alias("tag"))
    return merge.complete_tags(tags, "me", 20)


@query("m21_clamped", """
SELECT count(*) FILTER (queue = 0 AND NOT due BETWEEN 0 AND 1000000) AS due_new, count(*) FILTER (queue <> 0 AND NOT due BETWEEN -2147483648 AND 2147483647) AS due_other, count(*) FILTER (odue > 0 AND (type = 1 OR queue = 2) AND odid = 0) AS odue,
       count(*) FILTER (NOT ivl BETWEEN 0 AND 36500) AS ivl, count(*) FILTER (factor <> 0 AND factor < 1300) AS low_ease, count(*) FILTER (ord NOT BETWEEN 0 AND 499) AS ord FROM c""")
def clamped(spark: SparkSession, d: str) -> DataFrame:
    """How many cards an integrity check would correct, by column."""
    due, big = c("due"), (1 << 31) - 1
    return base.cards(spark, d).agg(
        n_if((c("queue") == 0) & ~due.between(0, 1_000_000), "due_new"), n_if((c("queue") != 0) & ~due.between(-big - 1, big), "due_other"), n_if((c("odue") > 0) & ((c("type") == 1) | (c("queue") == 2)) & (c("odid") == 0), "odue"),
        n_if(~c("ivl").between(0, 36_500), "ivl"), n_if((c("factor") != 0) & (c("factor") < 1300), "low_ease"), n_if(~c("ord").between(0, 499), "ord"),
    )


@query("m21_fixed_reviews", "SELECT id, CASE WHEN type = 0 AND time = 0 AND ease = 0 THEN 5 ELSE type END AS type, greatest(time, 0) AS time FROM r WHERE time < 0 OR (type = 0 AND time = 0 AND ease = 0)")
def fixed_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Reviews that an integrity check would correct, as they would be."""
    entered = (c("type") == 0) & (c("time") == 0) & (c("ease") == 0)
    return base.revlog(spark, d).where((c("time") < 0) | entered).select("id", F.when(entered, F.lit(5)).otherwise(c("type")).cast("tinyint").alias("type"), F.greatest(c("time"), F.lit(0)).alias("time"))


@query("m22_integrity", """
, f AS (SELECT ntid, count(DISTINCT ord) AS k FROM notetype_fields GROUP BY ntid)
SELECT (SELECT count(*) FROM c WHERE nid NOT IN (SELECT id FROM n)) AS cards_without_note, (SELECT count(*) FROM n WHERE id NOT IN (SELECT nid FROM c WHERE nid IS NOT NULL)) AS notes_without_card,
       (SELECT coalesce(sum(k - 1), 0)::BIGINT FROM (SELECT count(*) AS k FROM c WHERE nid IS NOT NULL GROUP BY nid, ord)) AS duplicate_ordinals, (SELECT count(*) FROM n JOIN f ON f.ntid = n.mid WHERE len(string_split(n.flds, chr(31))) <> f.k) AS field_count,
       (SELECT count(*) FROM n WHERE mid IS NULL OR mid NOT IN (SELECT id FROM notetypes)) AS without_notetype""")
def integrity(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of what is wrong: cards and notes without each other, ordinals used twice, wrong numbers of fields."""
    cards, notes = base.cards(spark, d), base.notes(spark, d)
    fields = table(spark, d, "notetype_fields").groupBy(c("ntid").alias("mid")).agg(F.countDistinct("ord").alias("k"))
    types = table(spark, d, "notetypes").select(c("id").alias("mid")).distinct()
    parts = {
        "cards_without_note": cards.where(c("nid").isNotNull()).join(notes.select(c("id").alias("nid")), "nid", "left_anti").agg(count()),
        "notes_without_card": notes.join(cards.select(c("nid").alias("id")), "id", "left_anti").agg(count()),
        "duplicate_ordinals": cards.where(c("nid").isNotNull()).groupBy("nid", "ord").agg(count("k")).agg(F.coalesce(F.sum(c("k") - 1), F.lit(0)).cast("bigint").alias("n")),
        "field_count": notes.join(fields, "mid").where(F.size(tx.fields_of(c("flds"))) != c("k")).agg(count()),
        "without_notetype": notes.join(types, "mid", "left_anti").agg(count()),
    }
    rows = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("name"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*[F.max(F.when(c("name") == k, c("n"))).alias(k) for k in parts])


@query("m22_new_ids", """
, b AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM n WHERE NOT id < 1756000000000)
SELECT n.id AS old_id, CASE WHEN b.id IS NULL THEN n.id ELSE (SELECT max(id) FROM n WHERE id < 1756000000000) + b.k END AS id FROM n LEFT JOIN b ON b.id = n.id""")
def new_ids(spark: SparkSession, d: str) -> DataFrame:
    """Notes with ids from the future get ids above the others, in their order."""
    rows = base.notes(spark, d).select("id")
    return merge.allocate_ids(rows, rows.limit(0), "id", c("id") < 1_756_000_000_000).select("old_id", "id")


@query("m23_revlog_upgrade", "SELECT id, CASE WHEN ease IN (2, 3) AND type IN (0, 2) THEN ease + 1 ELSE ease END AS ease FROM r")
def revlog_upgrade(spark: SparkSession, d: str) -> DataFrame:
    return base.revlog(spark, d).select("id", F.when(c("ease").isin(2, 3) & c("type").isin(0, 2), c("ease") + 1).otherwise(c("ease")).cast("tinyint").alias("ease"))


def media_names(spark: SparkSession, d: str) -> DataFrame:
    """(id, fname) that notes refer to."""
    return base.notes(spark, d).select("id", F.explode(F.array_distinct(tx.media_refs(c("flds")))).alias("fname"))


REFS = r"""
, refs AS (SELECT DISTINCT id, fname FROM (
  SELECT id, unnest(regexp_extract_all(flds, '(?is)<img[^>]*?src\s*=\s*"([^">]*)"', 1)) AS fname FROM n UNION ALL SELECT id, unnest(regexp_extract_all(flds, '(?is)\[sound:(.*?)\]', 1)) FROM n) WHERE fname <> ''),
files AS (SELECT DISTINCT fname FROM media WHERE csum IS NOT NULL)"""


@query("m25_missing_media", REFS + "SELECT fname, count(*) AS notes FROM refs WHERE fname NOT IN (SELECT fname FROM files) GROUP BY fname")
def missing_media(spark: SparkSession, d: str) -> DataFrame:
    """Files that notes refer to but that do not exist."""
    files = table(spark, d, "media", "fname", "csum").where(c("csum").isNotNull()).select("fname").distinct()
    return media_names(spark, d).join(files, "fname", "left_anti").groupBy("fname").agg(count("notes"))


@query("m25_unused_media", REFS + "SELECT fname FROM files WHERE NOT starts_with(fname, '_') AND fname NOT IN (SELECT fname FROM refs)")
def unused_media(spark: SparkSession, d: str) -> DataFrame:
    """Files that no note refers to; those that begin with an underscore are kept."""
    files = table(spark, d, "media", "fname", "csum").where(c("csum").isNotNull() & ~F.startswith("fname", F.lit("_"))).select("fname").distinct()
    return files.join(media_names(spark, d).select("fname").distinct(), "fname", "left_anti")


@query("m26_backups_kept", """
, b AS (SELECT DISTINCT id // 86400000 AS day FROM r), w AS (SELECT day, 20363 - day AS age, row_number() OVER (ORDER BY day DESC) AS k, row_number() OVER (PARTITION BY day // 7 ORDER BY day DESC) = 1 AS week, row_number() OVER (PARTITION BY day // 30 ORDER BY day DESC) = 1 AS month FROM b)
SELECT day, age <= 2 OR k <= 12 OR (week AND count(*) FILTER (week) OVER down <= 10) OR (month AND count(*) FILTER (month) OVER down <= 9) AS keep FROM w WINDOW down AS (ORDER BY day DESC)""")
def backups_kept(spark: SparkSession, d: str) -> DataFrame:
    """Days with reviews as if each had a backup: which would be kept."""
    days = base.revlog(spark, d).select(F.floor(c("id") / 86_400_000).alias("day")).distinct()
    return merge.thin_backups(days, 20_363, 12, 10, 9)


@query("m27_renamed_decks", "SELECT id, CASE WHEN name = 'Law' OR starts_with(name, 'Law' || chr(31)) THEN 'Recht' || chr(31) || 'Law' || substr(name, 4) ELSE name END AS name FROM d")
def renamed_decks(spark: SparkSession, d: str) -> DataFrame:
    """A deck moved below another one, with all decks below it."""
    return base.decks(spark, d).select("id", merge.rename_subtree(c("name"), "Law", "Recht\x1fLaw").alias("name"))


@query("m27_removed_decks", f", x AS (SELECT id FROM d WHERE name = 'Law' OR starts_with(name, 'Law' || chr(31))) SELECT id AS oid, 2 AS type FROM x UNION ALL SELECT id, 0 FROM c WHERE did IN (SELECT id FROM x) OR (odid <> 0 AND odid IN (SELECT id FROM x))")
def removed_decks(spark: SparkSession, d: str) -> DataFrame:
    """Tombstones of a deck, the decks below it, and their cards, those away in filtered decks included."""
    gone = base.decks(spark, d).where((c("name") == "Law") | F.startswith("name", F.lit("Law\x1f"))).select("id")
    cards = base.cards(spark, d).select("id", F.explode(F.array_distinct(F.array("did", "odid"))).alias("deck_")).join(F.broadcast(gone.select(c("id").alias("deck_"))), "deck_", "left_semi")
    return gone.select(c("id").alias("oid"), F.lit(2).alias("type")).unionByName(cards.select(c("id").alias("oid"), F.lit(0).alias("type")).distinct())


@query("m28_removed_notes", ", x AS (SELECT id FROM n WHERE regexp_matches(tags, '(?i).* leech(::| ).*')) SELECT id AS oid, 1 AS type FROM x UNION ALL SELECT id, 0 FROM c WHERE nid IN (SELECT id FROM x)")
def removed_notes(spark: SparkSession, d: str) -> DataFrame:
    """Tombstones of notes with a tag and of their cards."""
    notes, cards = base.notes(spark, d), base.cards(spark, d)
    gone = notes.where(c("tags").rlike("(?iu).* leech(::| ).*")).select("id")
    _, note_stones = merge.bury_with_tombstones(notes, gone, "id", 1)
    _, card_stones = merge.bury_with_tombstones(cards, cards.join(gone.select(c("id").alias("nid")), "nid", "left_semi").select("id"), "id", 0)
    return note_stones.unionByName(card_stones).select("oid", "type")


@query("m28_orphaned_notes", f", x AS (SELECT id FROM c WHERE id NOT IN (SELECT c.id FROM c WHERE {deck_sql('history')})) SELECT DISTINCT nid AS id FROM c WHERE nid IS NOT NULL AND nid NOT IN (SELECT nid FROM c WHERE id IN (SELECT id FROM x) AND nid IS NOT NULL)")
def orphaned_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes that would have no card left if the cards of a deck were removed."""
    col = base.collection(spark, d)
    removed = find_cards(col, "deck:history")
    left = col.cards.join(removed, "id", "left_anti").select("nid").where(c("nid").isNotNull())
    return col.cards.where(c("nid").isNotNull()).select("nid").distinct().join(left, "nid", "left_anti").select(c("nid").alias("id"))


@query("m29_checksums", "SELECT id, ('0x' || substr(sha1(split_part(flds, chr(31), 1)), 1, 8))::BIGINT AS csum, len(string_split(flds, chr(31))) AS fields FROM n")
def checksums(spark: SparkSession, d: str) -> DataFrame:
    """Checksum of the first field as stored, and the number of fields."""
    return base.notes(spark, d).select("id", tx.field_checksum(tx.field_at(c("flds"), 0)).alias("csum"), F.size(tx.fields_of(c("flds"))).cast("bigint").alias("fields"))


@query("m33_media_actions", """
, l AS (SELECT fname, max(csum) AS csum FROM (SELECT DISTINCT * FROM media) WHERE usn <= 51050 AND usn <> -1 GROUP BY fname), m AS (SELECT fname, max(csum) AS csum, bool_or(usn = -1) AS w FROM (SELECT DISTINCT * FROM media) WHERE usn > 51050 OR usn = -1 GROUP BY fname)
SELECT fname, CASE WHEN l.csum IS NOT DISTINCT FROM m.csum AND NOT coalesce(w, false) THEN 'none' WHEN l.csum IS NOT DISTINCT FROM m.csum THEN CASE WHEN l.csum IS NULL THEN 'none' ELSE 'remove_pending' END
  WHEN m.csum IS NULL AND coalesce(w, false) THEN 'none' WHEN m.csum IS NULL THEN 'delete' ELSE 'download' END AS action FROM l FULL JOIN m USING (fname)""")
def media_actions(spark: SparkSession, d: str) -> DataFrame:
    """What a media sync would do with each file."""
    rows = table(spark, d, "media").distinct()
    old = (c("usn") <= SIDE) & (c("usn") != -1)
    local = rows.where(old).groupBy("fname").agg(F.max("csum").alias("l"))
    remote = rows.where(~old).groupBy("fname").agg(F.max("csum").alias("m"), F.bool_or(c("usn") == -1).alias("w"))
    return local.join(remote, "fname", "full").select("fname", merge.media_action(c("l"), c("m"), F.coalesce("w", F.lit(False))).alias("action"))


@query("m7_deleted_cards", "SELECT DISTINCT id FROM cards WHERE id NOT IN (SELECT id FROM c)")
def deleted_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards that had a version and are deleted."""
    state = replay.replay(replay.change_feed(table(spark, d, "cards"), base.graves(spark, d, 0)))
    had = table(spark, d, "cards", "id").distinct()
    return state.where(~c("alive_")).select(c("key_").alias("id")).join(had, "id", "left_semi")
