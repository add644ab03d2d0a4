"""Search predicates P1-P36 and browser orders O1-O26 as named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid.functions import memory as mem
from recallgrid.functions import text as tx
from recallgrid.model import CLOCK as T
from recallgrid.model import DAY
from recallgrid.operators.sliced import numbered
from recallgrid.plans import base
from recallgrid.plans.base import query
from recallgrid.plans.stats import DECAY, DUE, ELAPSED, JSON, LEARN_CUTOFF, NUM, R_SQL, STATE, _retention_sql, true_due, true_retention
from recallgrid.search import writer
from recallgrid.search.ast import Node, Term
from recallgrid.search.compile import find_cards, find_notes, search_cards
from recallgrid.tables import table

c = F.col


def ms(days: int) -> int:
    return (T.next_day_at - DAY * days) * 1000


def deck_sql(pattern: str) -> str:
    inside = f"(SELECT id FROM d WHERE regexp_matches(name, '(?i)^{pattern}($|\\x1f)'))"
    return f"(c.did IN {inside} OR (c.odid <> 0 AND c.odid IN {inside}))"


def field_sql(name: str, condition: str) -> str:
    """condition over f, the text of a field of that name in the note's type."""
    text = "coalesce(string_split(n.flds, chr(31))[x.ord + 1], '')"
    return f"EXISTS (SELECT 1 FROM notetype_fields x WHERE x.ntid = n.mid AND lower(x.name) = '{name}' AND {condition.replace('{f}', text)})"


def any_field_sql(condition: str) -> str:
    return f"len(list_filter(string_split(n.flds, chr(31)), lambda f: {condition})) > 0"


def rated_sql(when: str, how: str) -> str:
    return f"c.id IN (SELECT cid FROM r WHERE cid IS NOT NULL AND {when} AND {how})"


DAYS_DUE = f"CAST(trunc(({DUE.replace('odue', 'c.odue').replace('ELSE due', 'ELSE c.due')} - {T.next_day_at}) / 86400.0) AS BIGINT)"
TRUE_DUE_SQL = "(CASE WHEN c.odue <> 0 THEN c.odue ELSE c.due END)"
CLOZE = "n.mid IN (SELECT id FROM notetypes WHERE config LIKE '%\"cloze\"%')"

STRIPPED = r"replace(replace(replace(replace(replace(regexp_replace(regexp_replace({0}, '(?is)<!--.*?-->|<style.*?>.*?</style>|<script.*?>.*?</script>', '', 'g'), '(?s)<.*?>', '', 'g'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), chr(160), ' ')"
MEDIA_SQL = r"""'(?is)<(?:img|audio|video|object|source)\b[^>]*?\b(?:src|data)\s*=\s*(?:"([^">]*)"|''([^''>]*)''|([^\s>"'']+))[^>]*>', ' \1\2\3 ', 'g'"""


def first_sql(flds: str) -> str:
    """A note's first field without markup but the names of media."""
    return STRIPPED.format(f"regexp_replace(split_part({flds}, chr(31), 1), {MEDIA_SQL})")


DUPE_SQL = f"n.mid = 1008379549705 AND n.csum = ('0x' || substr(sha1('Define: Kikawyse'), 1, 8))::BIGINT AND {first_sql('n.flds')} = 'Define: Kikawyse'"

#: (name, search, what is found, condition over c and n; None: no SQL, tested against brute force)
SEARCHES: list[tuple[str, str | Node, str, str | None]] = [
    ("p1_text", "bridge", "notes", "n.sfld ILIKE '%bridge%' OR n.flds ILIKE '%bridge%'"),
    ("p1_glob", "bri*ge", "cards", "n.sfld ILIKE '%bri%ge%' OR n.flds ILIKE '%bri%ge%'"),
    ("p3_field", "front:*harvest*", "notes", field_sql("front", "{f} ILIKE '%harvest%'")),
    ("p3_field_nonempty", "back:_*", "notes", field_sql("back", "{f} LIKE '_%'")),
    ("p3_field_empty", "hint:", "notes", field_sql("hint", "{f} = ''")),
    ("p4_field_accents", "back:nc:*raiz*", "notes", field_sql("back", "strip_accents({f}) ILIKE '%raiz%'")),
    ("p5_field_regex", r'"back:re:^the \w+"', "notes", field_sql("back", r"regexp_matches({f}, '(?i)^the \w+')")),
    ("p6_any_field", "*:*river*", "notes", any_field_sql("regexp_matches(f, '(?is)^.*river.*$')")),
    ("p7_any_field_regex", r"*:re:^\d{2,3}.kinds", "notes", any_field_sql(r"regexp_matches(f, '(?i)^\d{2,3}.kinds')")),
    ("p8_regex", r"re:\d+.kinds", "notes", r"regexp_matches(n.flds, '(?i)\d+.kinds')"),
    ("p9_word", "w:muscle", "notes", r"regexp_matches(n.flds, '(?i)(^|[^\pL\pM\pN_])muscle([^\pL\pM\pN_]|$)')"),
    ("p10_accents", "nc:raiz", "notes", f"{tx.plain_sql('n.sfld')} ILIKE '%raiz%' OR {tx.plain_sql('n.flds')} ILIKE '%raiz%'"),
    ("p11_cloze", "sc:the", "notes", rf"{CLOZE} AND (regexp_replace(n.sfld, '(?s)\{{\{{c[\d,]+::(.*?)(::.*?)?\}}\}}', '\1', 'g') ILIKE '%the%' OR regexp_replace(n.flds, '(?s)\{{\{{c[\d,]+::(.*?)(::.*?)?\}}\}}', '\1', 'g') ILIKE '%the%')"),
    ("p12_tag", "tag:lang", "notes", "regexp_matches(n.tags, '(?i).* lang(::| ).*')"),
    ("p12_tag_glob", "tag:ch0_", "notes", r"regexp_matches(n.tags, '(?i).* ch0\S(::| ).*')"),
    ("p13_tag_none", "tag:none", "notes", "n.tags = ''"),
    ("p13_tag_any", "tag:*", "notes", "true"),
    ("p14_tag_regex", r"tag:re:^ch0\d$", "notes", r"len(list_filter(regexp_split_to_array(n.tags, '[ 　]'), lambda t: regexp_matches(t, '(?i)^ch0\d$'))) > 0"),
    ("p14_tag_accents", "tag:nc:geografia", "notes", f"regexp_matches({tx.plain_sql('n.tags')}, '(?i).* geografia(::| ).*')"),
    ("p15_deck", "deck:history", "cards", deck_sql("history")),
    ("p15_deck_glob", "deck:med*::*", "cards", deck_sql("med.*\\x1f.*")),
    ("p16_deck_filtered", "deck:filtered", "cards", "c.odid <> 0"),
    ("p16_deck_current", "deck:current", "cards", deck_sql("Default")),
    ("p17_did", "did:1", "cards", "c.did = 1 OR (c.odid <> 0 AND c.odid = 1)"),
    ("p18_did_tree", Term("did_tree", (1029202450652,)), "cards", "c.did IN (SELECT k.id FROM d k JOIN d p ON p.id = 1029202450652 WHERE k.name = p.name OR starts_with(k.name, p.name || chr(31)))"),
    ("p19_preset", '"preset:Preset 2"', "cards", "c.did IN (SELECT id FROM d WHERE json_extract_string(kind, '$.normal.config_id') = '2') OR (c.odid <> 0 AND c.odid IN (SELECT id FROM d WHERE json_extract_string(kind, '$.normal.config_id') = '2'))"),
    ("p20_template_number", "card:2", "cards", "c.ord = 1"),
    ("p20_template_name", '"card:card 1"', "cards", "c.ord = 0 AND n.mid IN (SELECT id FROM notetypes WHERE config NOT LIKE '%\"cloze\"%')"),
    ("p21_notetype", '"note:basic*"', "notes", "n.mid IN (SELECT id FROM notetypes WHERE name ILIKE 'basic%')"),
    ("p21_mid", "mid:1008379549705", "notes", "n.mid = 1008379549705"),
    ("p22_cid", "cid:1752434438377,1752432345934", "cards", "c.id IN (1752434438377, 1752432345934)"),
    ("p22_nid", "nid:1752434438369,1752432345932", "notes", "n.id IN (1752434438369, 1752432345932)"),
    ("p23_flag", "flag:3", "cards", "(c.flags & 7) = 3"),
    ("p24_new", "is:new", "cards", "c.type = 0"),
    ("p24_review", "is:review", "cards", "c.type IN (2, 3)"),
    ("p24_learn", "is:learn", "cards", "c.type IN (1, 3)"),
    ("p24_due", "is:due", "cards", f"(c.queue IN (2, 3) AND c.due <= {T.days_elapsed}) OR (c.queue IN (1, 4) AND c.due <= {LEARN_CUTOFF})"),
    ("p24_buried", "is:buried", "cards", "c.queue IN (-2, -3)"),
    ("p24_buried_kinds", "is:buried-manually or is:buried-sibling", "cards", "c.queue IN (-2, -3)"),
    ("p24_suspended", "is:suspended", "cards", "c.queue = -1"),
    ("p25_added", "added:60", "cards", f"c.id > {ms(60)}"),
    ("p26_edited", "edited:70", "notes", f"n.mod > {T.next_day_at - DAY * 70}"),
    ("p27_introduced", "introduced:40", "cards", f"c.id IN (SELECT cid FROM r WHERE ease <> 0 AND cid IS NOT NULL GROUP BY cid HAVING min(id) > {ms(40)})"),
    ("p28_rated", "rated:30", "cards", rated_sql(f"id >= {ms(30)}", "ease > 0")),
    ("p28_rated_button", "rated:60:1", "cards", rated_sql(f"id >= {ms(60)}", "ease = 1")),
    ("p28_resched", "resched:90", "cards", rated_sql(f"id >= {ms(90)}", "ease = 0")),
    ("p29_prop_rated", "prop:rated>=-7:2", "cards", rated_sql(f"id >= {ms(8)}", "ease = 2")),
    ("p29_prop_rated_not", "prop:rated!=-3", "cards", rated_sql(f"id NOT BETWEEN {ms(4)} AND {ms(3) - 1}", "ease > 0")),
    ("p29_prop_resched", "prop:resched<-30", "cards", rated_sql(f"id < {ms(31)}", "ease = 0")),
    ("p30_prop_due", "prop:due<=-3", "cards", f"(c.queue IN (2, 3) AND {TRUE_DUE_SQL} <= {T.days_elapsed - 3}) OR (c.queue IN (1, 4) AND {DAYS_DUE} <= -3)"),
    ("p31_prop_ivl", "prop:ivl>=10", "cards", "c.ivl >= 10"),
    ("p31_prop_reps", "prop:reps!=1 prop:lapses<2", "cards", "c.reps <> 1 AND c.lapses < 2"),
    ("p31_prop_ease", "prop:ease>2.25", "cards", "c.factor > 2250"),
    ("p31_prop_pos", "prop:pos<40000", "cards", f"c.type = 0 AND {TRUE_DUE_SQL} < 40000"),
    ("p32_prop_stability", "prop:s>20", "cards", f"{NUM.format('s')} > 20"),
    ("p32_prop_difficulty", "prop:d<0.3", "cards", f"{NUM.format('d')} < 3.7"),
    ("p32_prop_retrievability", "prop:r<0.8", "cards", f"c.type <> 0 AND {STATE} AND {R_SQL} < 0.8"),
    ("p33_custom_number", "prop:cdn:k>1", "cards", f"TRY_CAST(json_extract_string(json_extract_string({JSON}, '$.cd'), '$.k') AS DOUBLE) > 1"),
    ("p33_custom_key", "-has-cd:k", "cards", f"json_extract_string(json_extract_string({JSON}, '$.cd'), '$.k') IS NULL"),
    ("p34_dupe", '"dupe:1008379549705,<b>Define:</b>&nbsp;Kikawyse"', "notes", DUPE_SQL),
    ("p35_all", "", "cards", "true"),
    ("b2_and_or", "(tag:marked OR is:due) -is:suspended deck:history", "cards", f"(regexp_matches(n.tags, '(?i).* marked(::| ).*') OR (c.queue IN (2, 3) AND c.due <= {T.days_elapsed}) OR (c.queue IN (1, 4) AND c.due <= {LEARN_CUTOFF})) AND NOT c.queue = -1 AND {deck_sql('history')}"),
    ("b3_not_rated", "-rated:30 or flag:1", "cards", f"NOT {rated_sql(f'id >= {ms(30)}', 'ease > 0')} OR (c.flags & 7) = 1"),
    ("b4_groups", "-(flag:1 or flag:2) (is:new or (is:review prop:ivl>5))", "cards", "NOT ((c.flags & 7) = 1 OR (c.flags & 7) = 2) AND (c.type = 0 OR (c.type IN (2, 3) AND c.ivl > 5))"),
    ("q8_forgot", writer.forgot("Languages", 30), "cards", f"{rated_sql(f'id >= {ms(30)}', 'ease = 1')} AND {deck_sql('languages')}"),
    ("q8_ahead", writer.ahead("Languages", 500), "cards", f"c.type IN (2, 3) AND ((c.queue IN (2, 3) AND {TRUE_DUE_SQL} <= {T.days_elapsed + 500}) OR (c.queue IN (1, 4) AND {DAYS_DUE} <= 500)) AND {deck_sql('languages')}"),
    ("q8_preview", writer.preview("Law", 90), "cards", f"c.type = 0 AND c.id > {ms(90)} AND {deck_sql('law')}"),
    ("q8_cram", writer.cram("Law", "review", ("marked", "leech"), ("verbs",)), "cards", f"NOT c.type = 0 AND (regexp_matches(n.tags, '(?i).* marked(::| ).*') OR regexp_matches(n.tags, '(?i).* leech(::| ).*')) AND NOT regexp_matches(n.tags, '(?i).* verbs(::| ).*') AND {deck_sql('law')}"),
]


def _search(search: str | Node, what: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return (find_cards if what == "cards" else find_notes)(base.collection(spark, d), search)

    return run


def _search_sql(what: str, condition: str | None) -> str | None:
    if condition is None:
        return None
    if "c." not in condition.replace("kc.", "") and what == "notes":
        return f"SELECT n.id FROM n WHERE {condition}"
    source = "c JOIN n ON c.nid = n.id" if "n." in condition.replace("json", "").replace("min(", "") else "c"
    return f"SELECT {'c.id' if what == 'cards' else 'DISTINCT c.nid AS id'} FROM {source} WHERE {condition}"


# Names of search queries begin with s_, as the names of problems begin with p and a number.
for _name, _text, _what, _sql in SEARCHES:
    query(f"s_{_name}", _search_sql(_what, _sql))(_search(_text, _what))


@query("s_p2_excluded", "SELECT n.id FROM n JOIN notetypes t ON t.id = n.mid WHERE t.name = 'Basic' AND (n.sfld ILIKE '%bridge%' OR split_part(n.flds, chr(31), 1) ILIKE '%bridge%') UNION SELECT n.id FROM n JOIN notetypes t ON t.id = n.mid WHERE t.name <> 'Basic' AND (n.sfld ILIKE '%bridge%' OR n.flds ILIKE '%bridge%')")
def excluded_fields(spark: SparkSession, d: str) -> DataFrame:
    """A text search that leaves out the second field of one note type."""
    col = base.collection(spark, d)
    types = [replace(nt, excluded={1} if nt.name == "Basic" else {99}) for nt in col.catalog.notetypes]
    return find_notes(replace(col, catalog=replace(col.catalog, notetypes=types)), "bridge")


@query("s_find_notes_of_cards", f"SELECT DISTINCT nid AS id FROM c WHERE (c.queue IN (2, 3) AND c.due <= {T.days_elapsed}) OR (c.queue IN (1, 4) AND c.due <= {LEARN_CUTOFF})")
def notes_of_due_cards(spark: SparkSession, d: str) -> DataFrame:
    """Notes mode with a condition on cards only: the notes table is not read."""
    return find_notes(base.collection(spark, d), "is:due")


@query("g3_retention_of_search", f", x AS (SELECT r.* FROM r WHERE cid IN (SELECT c.id FROM c WHERE {deck_sql('history')} AND NOT c.queue = -1)) {_retention_sql('x')}")
def retention_of_search(spark: SparkSession, d: str) -> DataFrame:
    """True retention of the reviews of a search."""
    col = base.collection(spark, d)
    ids = find_cards(col, "deck:history -is:suspended").select(c("id").alias("cid"))
    return true_retention(col.revlog.join(ids, "cid", "left_semi"))


@query("src4_revlog_of_search", f"SELECT r.* FROM r WHERE cid IN (SELECT c.id FROM c WHERE {deck_sql('law')}) AND id >= {ms(60)}")
def revlog_of_search(spark: SparkSession, d: str) -> DataFrame:
    """Reviews of a search since a day, in card order."""
    col = base.collection(spark, d)
    ids = find_cards(col, "deck:law").select(c("id").alias("cid"))
    return col.revlog.where(c("id") >= ms(60)).join(ids, "cid", "left_semi").select("id", *base.REVIEW).orderBy("cid", "id")


@query("src4_revlog_after", f"SELECT * FROM r WHERE id >= {ms(30)}")
def revlog_after(spark: SparkSession, d: str) -> DataFrame:
    """Reviews since a day, by time; the bound reaches the scan."""
    return base.revlog(spark, d).where(c("id") >= ms(30)).select("id", *base.REVIEW).orderBy("id")


HOT_SQL = "(SELECT cid FROM r WHERE cid IS NOT NULL GROUP BY cid ORDER BY count(*) DESC, cid LIMIT 1)"


@query("src4_revlog_of_card", f"SELECT * FROM r WHERE cid = {HOT_SQL}")
def revlog_of_card(spark: SparkSession, d: str) -> DataFrame:
    """All reviews of one card, the one with the most."""
    rows = base.revlog(spark, d)
    hot = rows.where(c("cid").isNotNull()).groupBy("cid").count().orderBy(c("count").desc(), "cid").limit(1).select("cid")
    return rows.join(F.broadcast(hot), "cid", "left_semi").select("id", *base.REVIEW)


@query("src4_revlog_in_card_order", "SELECT *, row_number() OVER (ORDER BY cid NULLS FIRST, id) AS rank FROM r")
def revlog_in_card_order(spark: SparkSession, d: str) -> DataFrame:
    """All reviews in card order with their places."""
    return numbered(base.revlog(spark, d).select("id", *base.REVIEW), [c("cid").asc(), c("id").asc()], "rank")


@query("src4_studied_days", f"SELECT DISTINCT CAST(floor((id // 1000 - {T.next_day_at}) / 86400.0) AS BIGINT) AS day FROM r WHERE type NOT IN (4, 5)")
def studied_days(spark: SparkSession, d: str) -> DataFrame:
    """Days with an answer, by days from the next rollover."""
    return base.revlog(spark, d).where(~c("type").isin(4, 5)).select(F.floor((F.floor(c("id") / 1000) - T.next_day_at) / 86_400).cast("bigint").alias("day")).distinct()


# --- orders ----------------------------------------------------------------------------------------------------------

def now_due(p: str = "c.") -> Column:
    """Due as a time: days are counted from now."""
    return F.when((c(f"{p}due") > mem.DUE_IS_TIME) | (c(f"{p}type") == 0), c(f"{p}due").cast("bigint")).otherwise((c(f"{p}due").cast("bigint") - T.days_elapsed) * DAY + T.now)


NOW_DUE_SQL = f"CASE WHEN c.due > 1000000000 OR c.type = 0 THEN CAST(c.due AS BIGINT) ELSE (CAST(c.due AS BIGINT) - {T.days_elapsed}) * 86400 + {T.now} END"


def position(p: str = "c.") -> Column:
    return F.coalesce(mem.original_position(c(f"{p}data")), F.when(c(f"{p}type") == 0, c(f"{p}due")).otherwise(F.lit(0)))


POSITION_SQL = "coalesce(TRY_CAST(json_extract_string(CASE WHEN json_valid(c.data) THEN c.data END, '$.pos') AS INTEGER), CASE WHEN c.type = 0 THEN c.due ELSE 0 END)"
DECK_NAME = "(SELECT name FROM d WHERE d.id = c.did)"
TYPE_NAME = "(SELECT min(name) FROM notetypes t WHERE t.id = n.mid)"


def sort_number(x: Column) -> Column:
    """Numbers sort before texts, by value."""
    return x.try_cast("bigint")


#: Card mode: column -> (keys as columns, keys as SQL, whether notes are needed). Nulls come first.
CARD_ORDERS: dict[str, tuple[Callable[[], list[Column]], list[str], bool]] = {
    "cardMod": (lambda: [c("c.mod")], ["c.mod"], False),
    "template": (lambda: [c("c.ord")], ["c.ord"], False),
    "deck": (lambda: [c("deck_name")], [DECK_NAME], False),
    "cardDue": (lambda: [now_due()], [NOW_DUE_SQL], False),
    "cardEase": (lambda: [c("c.type") == 0, c("c.factor")], ["c.type = 0", "c.factor"], False),
    "cardIvl": (lambda: [c("c.ivl")], ["c.ivl"], False),
    "cardLapses": (lambda: [c("c.lapses")], ["c.lapses"], False),
    "cardReps": (lambda: [c("c.reps")], ["c.reps"], False),
    "noteCrt": (lambda: [c("n.id"), c("c.ord")], ["n.id", "c.ord"], True),
    "noteMod": (lambda: [c("n.mod"), c("c.ord")], ["n.mod", "c.ord"], True),
    "note": (lambda: [c("type_name")], [TYPE_NAME], True),
    "originalPosition": (lambda: [position()], [POSITION_SQL], False),
    "noteFld": (lambda: [sort_number(c("n.sfld")), F.lower(c("n.sfld")), c("c.ord")], ["TRY_CAST(n.sfld AS BIGINT)", "lower(n.sfld)", "c.ord"], True),
    "noteTags": (lambda: [c("n.tags")], ["n.tags"], True),
    "stability": (lambda: [mem.number(c("c.data"), "s")], [NUM.format("s")], False),
    "difficulty": (lambda: [mem.number(c("c.data"), "d")], [NUM.format("d")], False),
    "retrievability": (lambda: [F.round(mem.retrievability(c("c.data"), F.when(c("c.odue") != 0, c("c.odue")).otherwise(c("c.due")), c("c.ivl"), T), 9)], [f"CASE WHEN {STATE} THEN round({R_SQL}, 9) END"], False),
}


def in_order(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank, their place in an order that ends with the id; the places are worked out by many tasks."""
    return numbered(rows, [*order, c("id").asc()], "rank").withColumn("rank", c("rank").cast("bigint"))


def rank_sql(select: str, order: str) -> str:
    """The rows of a SELECT with their place; Spark's rising orders have nulls first, its falling ones last."""
    return f"SELECT *, row_number() OVER (ORDER BY {order}, id) AS rank FROM ({select})"


def sorted_cards(spark: SparkSession, d: str, column: str, search: str = "", reverse: bool = False) -> DataFrame:
    """(id, k0, ..., rank) of the cards of a search, in the order of a browser column; names are joined from small tables."""
    make, _, with_notes = CARD_ORDERS[column]
    keys = make()
    df = search_cards(base.collection(spark, d), search, with_notes)
    if column == "deck":
        df = df.join(base.decks(spark, d).select(c("id").alias("deck_id"), c("name").alias("deck_name")), c("c.did") == c("deck_id"), "left")
    if column == "note":
        df = df.join(type_names(spark, d), c("n.mid") == c("type_id"), "left")
    out = df.select(c("c.id").alias("id"), *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    numbers_first = [c("k0").asc_nulls_last(), c("k1").asc(), c("k2").asc()] if column == "noteFld" else None
    order = numbers_first or [c(f"k{i}").desc() if reverse else c(f"k{i}").asc() for i in range(len(keys))]
    return in_order(out, order)


def type_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notetypes", "id", "name").groupBy(c("id").alias("type_id")).agg(F.min("name").alias("type_name"))


def _sorted(column: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: sorted_cards(spark, d, column)


for _column, (_keys, _sqls, _notes) in CARD_ORDERS.items():
    _cols = ", ".join(f"{s} AS k{i}" for i, s in enumerate(_sqls))
    _order = ", ".join(f"k{i} ASC NULLS {'LAST' if _column == 'noteFld' and i == 0 else 'FIRST'}" for i in range(len(_sqls)))
    query(f"o_cards_{_column}", rank_sql(f"SELECT c.id, {_cols} FROM c {'JOIN n ON c.nid = n.id' if _notes else ''}", _order))(_sorted(_column))


@dataclass(frozen=True)
class NoteOrder:
    """Keys of notes: aggregates over those of their cards that count, or columns of the notes themselves."""

    keys: Callable[[], list[Column]]
    sql: list[str]
    which: Callable[[], Column] = lambda: F.lit(True)
    which_sql: str = "true"
    own: bool = False


DECK_POS_SQL = "(SELECT id AS deck_id, row_number() OVER (ORDER BY name, id) AS deck_pos FROM d)"
NOTE_ORDERS = {
    "cardMod": NoteOrder(lambda: [F.max("mod")], ["max(mod)"]),
    "template": NoteOrder(lambda: [F.count(F.lit(1))], ["count(*)"]),
    "deck": NoteOrder(lambda: [F.countDistinct("did"), F.min("deck_pos")], ["count(DISTINCT did)", "min(deck_pos)"], lambda: c("deck_pos").isNotNull(), "deck_pos IS NOT NULL"),
    "cardDue": NoteOrder(lambda: [F.min(now_due(""))], [f"min({NOW_DUE_SQL.replace('c.', '')})"], lambda: (c("odid") == 0) & (c("type") != 0) & (c("queue") > 0), "odid = 0 AND type <> 0 AND queue > 0"),
    "cardEase": NoteOrder(lambda: [F.round(F.avg("factor"), 6)], ["round(avg(factor), 6)"], lambda: c("type") != 0, "type <> 0"),
    "cardIvl": NoteOrder(lambda: [F.round(F.avg("ivl"), 6)], ["round(avg(ivl), 6)"], lambda: c("type").isin(2, 3), "type IN (2, 3)"),
    "cardLapses": NoteOrder(lambda: [F.sum("lapses").cast("bigint")], ["CAST(sum(lapses) AS BIGINT)"]),
    "cardReps": NoteOrder(lambda: [F.sum("reps").cast("bigint")], ["CAST(sum(reps) AS BIGINT)"]),
    "originalPosition": NoteOrder(lambda: [F.min(position(""))], [f"min({POSITION_SQL.replace('c.', '')})"]),
    "noteCrt": NoteOrder(lambda: [c("id")], ["id"], own=True),
    "noteMod": NoteOrder(lambda: [c("mod")], ["mod"], own=True),
    "note": NoteOrder(lambda: [c("type_name")], ["(SELECT min(name) FROM notetypes t WHERE t.id = n.mid)"], own=True),
    "noteFld": NoteOrder(lambda: [F.lower("sfld")], ["lower(sfld)"], own=True),
    "noteTags": NoteOrder(lambda: [c("tags")], ["tags"], own=True),
}


def deck_positions(spark: SparkSession, d: str) -> DataFrame:
    """(deck_id, deck_pos): decks by name; the window runs over decks, a dimension."""
    return base.decks(spark, d).select(c("id").alias("deck_id"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("name", "id")).alias("deck_pos"))


def sorted_notes(spark: SparkSession, d: str, column: str) -> DataFrame:
    """(id, k0, ..., rank) of all notes in the order of a browser column; notes without a card that counts come first."""
    order = NOTE_ORDERS[column]
    names = [f"k{i}" for i in range(len(order.sql))]
    keys = [k.alias(n) for k, n in zip(order.keys(), names, strict=True)]
    notes = base.notes(spark, d)
    if order.own:
        rows = (notes.join(type_names(spark, d), c("mid") == c("type_id"), "left") if column == "note" else notes).select("id", *keys)
    else:
        cards = base.cards(spark, d)
        cards = cards.join(deck_positions(spark, d), c("did") == c("deck_id"), "left") if column == "deck" else cards
        per = cards.where(order.which()).groupBy("nid").agg(*keys)
        rows = notes.select("id").join(per, c("id") == c("nid"), "left").select("id", *names)
    return in_order(rows, [c(n).asc() for n in names])


def _sorted_notes(column: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: sorted_notes(spark, d, column)


for _column, _o in NOTE_ORDERS.items():
    _names = [f"k{i}" for i in range(len(_o.sql))]
    _cols = ", ".join(f"{s} AS {n}" for s, n in zip(_o.sql, _names, strict=True))
    _cards = f"(SELECT * FROM c LEFT JOIN {DECK_POS_SQL} ON deck_id = did)" if _column == "deck" else "c"
    _rows = f"SELECT id, {_cols} FROM n" if _o.own else f"SELECT n.id, {', '.join('k.' + n for n in _names)} FROM n LEFT JOIN (SELECT nid, {_cols} FROM {_cards} WHERE {_o.which_sql} GROUP BY nid) k ON k.nid = n.id"
    query(f"o_notes_{_column}", rank_sql(_rows, ", ".join(f"{n} ASC NULLS FIRST" for n in _names)))(_sorted_notes(_column))


REL_SQL = f"CASE WHEN {STATE} THEN -(pow(greatest({R_SQL}, 0.0001), -1.0 / {DECAY}) - 1) / (pow(greatest(coalesce({NUM.format('dr')}, 0.9), 0.0001), -1.0 / {DECAY}) - 1) ELSE -(greatest({ELAPSED} / 86400.0, 0) + 0.001) / greatest(ivl, 1) END"
HASH_SQL = tx.fnv_sql("id", "mod")


@dataclass(frozen=True)
class Key:
    """A sort key as a column and as SQL over c; numbers with a fraction are rounded, so that equal ones tie."""

    column: Callable[[], Column]
    sql: str
    falling: bool = False

    @property
    def order_sql(self) -> str:
        return "DESC NULLS LAST" if self.falling else "ASC NULLS FIRST"


def _r() -> Column:
    return F.round(mem.retrievability(c("data"), true_due(), c("ivl"), T), 9)


DUE_KEY, DECK_KEY = Key(lambda: c("due"), "due"), Key(lambda: c("deck_pos"), "deck_pos")
R_SQL9 = f"CASE WHEN {STATE} THEN round({R_SQL}, 9) END"
RELATIVE_KEY = Key(lambda: F.round(mem.relative_retrievability(c("data"), true_due(), c("ivl"), T), 6), f"round({REL_SQL}, 6)")
ADDED = [Key(lambda: c("nid"), "nid"), Key(lambda: c("ord"), "ord")]
REVERSE_ADDED = [Key(lambda: c("nid"), "nid", True), Key(lambda: c("ord"), "ord")]
HASH_KEY = Key(lambda: tx.fnv_hash(c("id"), c("mod")), HASH_SQL)
REVIEW_ORDERS: dict[str, list[Key]] = {
    "day": [DUE_KEY],
    "day_then_deck": [DUE_KEY, DECK_KEY],
    "deck_then_day": [DECK_KEY, DUE_KEY],
    "intervals_ascending": [Key(lambda: c("ivl"), "ivl")],
    "intervals_descending": [Key(lambda: c("ivl"), "ivl", True)],
    "ease_ascending": [Key(lambda: c("factor"), "factor")],
    "ease_descending": [Key(lambda: c("factor"), "factor", True)],
    "difficulty_ascending": [Key(lambda: mem.number(c("data"), "d"), NUM.format("d"))],
    "difficulty_descending": [Key(lambda: mem.number(c("data"), "d"), NUM.format("d"), True)],
    "retrievability_ascending": [Key(_r, R_SQL9)],
    "retrievability_descending": [Key(_r, R_SQL9, True)],
    "relative_overdueness": [RELATIVE_KEY],
    "overdueness": [Key(lambda: F.round(mem.overdueness(c("due"), F.nullif(c("ivl"), F.lit(0)), T), 9), f"round(-(1 + ({T.days_elapsed} - due + 0.001) / greatest(nullif(ivl, 0), 1)), 9)")],
    "random": [],
    "added": ADDED,
    "reverse_added": REVERSE_ADDED,
}


def salt_of(day: int) -> int:
    return day * 2_654_435_761 % (1 << 32)


SALT = salt_of(T.days_elapsed)
NOTE_HASH = Key(lambda: tx.fnv_hash(c("nid"), F.lit(SALT)), tx.fnv_sql("nid", str(SALT)))
CARD_HASH = Key(lambda: tx.fnv_hash(c("id"), F.lit(SALT)), tx.fnv_sql("id", str(SALT)))
NEW_ORDERS: dict[str, list[Key]] = {
    "lowest_position": [DUE_KEY, ADDED[1]],
    "highest_position": [Key(lambda: c("due"), "due", True), ADDED[1]],
    "random_notes": [NOTE_HASH, ADDED[1]],
    "random_cards": [CARD_HASH],
}


def day_hash(column: str) -> Key:
    """The order by hash after gathering: the hash is unsigned here, so its sign bit is turned for comparing."""
    sql = f"({tx.fnv_sql(column, str(T.days_elapsed))} + {1 << 64}) % {1 << 64}"
    return Key(lambda: (tx.fnv_hash(c(column), F.lit(T.days_elapsed)).bitwiseXOR(F.lit(-(1 << 63)))), f"CAST({sql} - {1 << 63} AS BIGINT)")


#: Sorting after new cards are gathered, which here is in the order of their position.
GATHERED = [DUE_KEY, ADDED[1], Key(lambda: c("id"), "id")]
AFTER_ORDERS: dict[str, list[Key]] = {
    "template": [ADDED[1], *GATHERED],
    "no_sort": GATHERED,
    "template_then_random": [ADDED[1], day_hash("id")],
    "random_note_then_template": [day_hash("nid"), ADDED[1]],
    "random_card": [day_hash("id")],
}
FILTERED_ORDERS: dict[str, list[Key]] = {
    "oldest_reviewed": [Key(lambda: c("last_review"), "last_review")],
    "intervals_ascending": REVIEW_ORDERS["intervals_ascending"],
    "intervals_descending": REVIEW_ORDERS["intervals_descending"],
    "lapses": [Key(lambda: c("lapses"), "lapses", True)],
    "added": ADDED,
    "reverse_added": REVERSE_ADDED,
    "due": [Key(lambda: F.when(c("due") > mem.DUE_IS_TIME, c("due").cast("bigint")).otherwise((c("due").cast("bigint") - T.days_elapsed) * DAY + T.now), f"CASE WHEN due > 1000000000 THEN CAST(due AS BIGINT) ELSE (CAST(due AS BIGINT) - {T.days_elapsed}) * 86400 + {T.now} END"), ADDED[1]],
    "retrievability_ascending": REVIEW_ORDERS["retrievability_ascending"],
    "retrievability_descending": REVIEW_ORDERS["retrievability_descending"],
    "relative_overdueness": [RELATIVE_KEY],
    "random": [Key(lambda: tx.fnv_hash(c("id"), F.lit(42)), tx.fnv_sql("id", "42"))],
}


def keyed(rows: DataFrame, keys: list[Key]) -> tuple[DataFrame, list[Column]]:
    """(id, k0, ...) of rows, and the order by these keys."""
    out = rows.select("id", *[k.column().alias(f"k{i}") for i, k in enumerate(keys)])
    return out, [c(f"k{i}").desc() if k.falling else c(f"k{i}").asc() for i, k in enumerate(keys)]


def keyed_sql(source: str, keys: list[Key]) -> str:
    return rank_sql(f"SELECT id, {', '.join(f'{k.sql} AS k{i}' for i, k in enumerate(keys))} FROM {source}", ", ".join(f"k{i} {k.order_sql}" for i, k in enumerate(keys)))


def ordered_query(name: str, source: Callable[[SparkSession, str], DataFrame], source_sql: str, keys: list[Key]) -> None:
    """Registers the rows of source with their keys and places."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return in_order(*keyed(source(spark, d), keys))

    query(name, keyed_sql(source_sql, keys))(run)


def due_cards(spark: SparkSession, d: str) -> DataFrame:
    """Due review cards with the place of their deck."""
    rows = base.cards(spark, d).where((c("queue") == 2) & (c("due") <= T.days_elapsed))
    return rows.join(deck_positions(spark, d), c("did") == c("deck_id"), "left")


def new_cards(spark: SparkSession, d: str) -> DataFrame:
    return base.cards(spark, d).where(c("queue") == 0)


def due_reviews(cards: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """Due review cards in a review order; ties in the order of a hash of id and mod. A limit keeps only the first rows of
    each partition before the rows meet."""
    rows = cards.where((c("queue") == 2) & (c("due") <= T.days_elapsed))
    out = rows.orderBy(*[k.column().desc() if k.falling else k.column().asc() for k in [*REVIEW_ORDERS[order], HASH_KEY]], "id")
    return out.limit(limit) if limit is not None else out


DUE_SQL = f"(SELECT * FROM c LEFT JOIN {DECK_POS_SQL} ON deck_id = did WHERE queue = 2 AND due <= {T.days_elapsed})"
for _name, _keys in REVIEW_ORDERS.items():
    ordered_query(f"o20_{_name}", due_cards, DUE_SQL, [*_keys, HASH_KEY])
for _name, _keys in NEW_ORDERS.items():
    ordered_query(f"o22_{_name}", new_cards, "(SELECT * FROM c WHERE queue = 0)", _keys)
for _name, _keys in AFTER_ORDERS.items():
    ordered_query(f"o23_{_name}", new_cards, "(SELECT * FROM c WHERE queue = 0)", _keys)


@query("o21_overdueness", f"SELECT id, round(-(1 + ({T.days_elapsed} - due + 0.001) / greatest(ivl, 1)), 6) AS overdueness FROM c WHERE queue = 2 AND due <= {T.days_elapsed}")
def overdue(spark: SparkSession, d: str) -> DataFrame:
    rows = base.cards(spark, d).where((c("queue") == 2) & (c("due") <= T.days_elapsed))
    return rows.select("id", F.round(mem.overdueness(c("due"), c("ivl"), T), 6).alias("overdueness")).orderBy("overdueness", "id")


def filtered_candidates(spark: SparkSession, d: str, search: str) -> DataFrame:
    """The cards of a search without suspended, buried and already filtered ones, with the time of their last review."""
    text = f"({search}) -is:suspended -is:buried -deck:filtered" if search.strip() else "-is:suspended -is:buried -deck:filtered"
    col = base.collection(spark, d)
    last = col.revlog.where(c("cid").isNotNull()).groupBy("cid").agg(F.max("id").alias("last_review"))
    return search_cards(col, text).select("c.*").join(last, c("id") == c("cid"), "left").drop("cid")


def filtered_cards(spark: SparkSession, d: str, search: str, order: str, limit: int) -> DataFrame:
    """What a filtered deck takes: its candidates, ordered and limited. The random order has an explicit seed; a column that
    no key needs is not read."""
    keys = [*FILTERED_ORDERS[order], HASH_KEY]
    return filtered_candidates(spark, d, search).orderBy(*[k.column().desc() if k.falling else k.column().asc() for k in keys], "id").limit(limit)


FILTERED_SQL = "(SELECT c.*, l.last_review FROM c LEFT JOIN (SELECT cid, max(id) AS last_review FROM r GROUP BY cid) l ON l.cid = c.id WHERE queue NOT IN (-1, -2, -3) AND odid = 0 AND lapses >= 1)"
for _name, _keys in FILTERED_ORDERS.items():
    ordered_query(f"o24_{_name}", lambda spark, d: filtered_candidates(spark, d, "prop:lapses>=1"), FILTERED_SQL, [*_keys, HASH_KEY])


@query("o25_learning_order", rank_sql("SELECT id, reps, due FROM c WHERE queue IN (1, 4)", "reps = 0, due"))
def learning_order(spark: SparkSession, d: str) -> DataFrame:
    rows = base.cards(spark, d).where(c("queue").isin(1, 4)).select("id", "reps", "due")
    return in_order(rows, [(c("reps") == 0).asc(), c("due").asc()])


@query("o26_media_page", "SELECT fname, usn FROM (SELECT DISTINCT * FROM media) WHERE usn > 50000 ORDER BY usn, fname LIMIT 1000")
def media_page(spark: SparkSession, d: str) -> DataFrame:
    """The next thousand media changes after a change number: a page is the feature."""
    return table(spark, d, "media").distinct().where(c("usn") > 50_000).select("fname", "usn").orderBy("usn", "fname").limit(1000)


@query("src2_ordered_ids", "SELECT c.id, CAST(p.pos AS INTEGER) AS pos, c.due FROM c JOIN (VALUES (1, 1752434438377), (2, 1752432345934), (3, 1752406062097)) p(pos, id) ON p.id = c.id")
def ordered_ids(spark: SparkSession, d: str) -> DataFrame:
    """Cards of a given list of ids, in the order of the list."""
    wanted = spark.createDataFrame([(i + 1, x) for i, x in enumerate((1752434438377, 1752432345934, 1752406062097))], "pos int, id bigint")
    return base.cards(spark, d).join(wanted, "id").select("id", "pos", "due").orderBy("pos")
