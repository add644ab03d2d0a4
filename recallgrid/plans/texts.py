"""Text functions over notes as named queries: markup, media, clozes, card generation, rendering."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.functions import answerdiff, cloze, template
from recallgrid.functions import memory as mem
from recallgrid.functions import text as tx
from recallgrid.model import CLOCK as T
from recallgrid.plans import base
from recallgrid.plans.base import query
from recallgrid.plans.searches import REL_SQL, STRIPPED, first_sql
from recallgrid.plans.stats import R_SQL, STATE, count
from recallgrid.session import checkpoint_dir
from recallgrid.sources import delimited
from recallgrid.tables import table

c = F.col


@query("t1_strip_html", f"SELECT id, {STRIPPED.format('flds')} AS text FROM n")
def strip_html(spark: SparkSession, d: str) -> DataFrame:
    return base.notes(spark, d).select("id", tx.strip_html(c("flds")).alias("text"))


@query("t2_strip_keep_media", "SELECT id, " + STRIPPED.format(r"""regexp_replace(flds, '(?is)<(?:img|audio|video|object|source)\b[^>]*?\b(?:src|data)\s*=\s*"([^">]*)"[^>]*>', ' \1 ', 'g')""") + " AS text FROM n")
def strip_keep_media(spark: SparkSession, d: str) -> DataFrame:
    return base.notes(spark, d).select("id", tx.strip_html_keep_media(c("flds")).alias("text"))


@query("t3_text_line", "SELECT id, trim(" + STRIPPED.format(r"regexp_replace(regexp_replace(flds, '(?i)<br\s*/?>|<div>|\n', ' ', 'g'), '(?is)\[sound:(.*?)\]', '', 'g')") + ", ' ') AS text FROM n")
def text_line(spark: SparkSession, d: str) -> DataFrame:
    return base.notes(spark, d).select("id", tx.to_text_line(c("flds")).alias("text"))


@query("t4_without_sounds", r"SELECT id, regexp_replace(flds, '(?is)\[sound:(.*?)\]', '', 'g') AS text FROM n WHERE contains(flds, '[sound:')")
def without_sounds(spark: SparkSession, d: str) -> DataFrame:
    return base.notes(spark, d).where(F.contains("flds", F.lit("[sound:"))).select("id", tx.strip_av_tags(c("flds")).alias("text"))


@query("t5_media_refs", r"""
SELECT id, fname FROM (SELECT id, unnest(regexp_extract_all(flds, '(?is)<img[^>]*?src\s*=\s*"([^">]*)"', 1)) AS fname FROM n UNION ALL SELECT id, unnest(regexp_extract_all(flds, '(?is)\[sound:(.*?)\]', 1)) FROM n) WHERE fname <> ''""")
def media_refs(spark: SparkSession, d: str) -> DataFrame:
    return base.notes(spark, d).select("id", F.explode(tx.media_refs(c("flds"))).alias("fname"))


@query("t7_composed", "SELECT id, nfc_normalize(flds) AS flds FROM n WHERE nfc_normalize(flds) <> flds")
def composed(spark: SparkSession, d: str) -> DataFrame:
    """Notes that change when they are composed."""
    return base.notes(spark, d).select("id", "flds", tx.nfc(c("flds")).alias("x")).where(c("x") != c("flds")).select("id", c("x").alias("flds"))


@query("t8_without_accents", f"SELECT id, {tx.plain_sql('sfld')} AS sfld FROM n")
def without_accents(spark: SparkSession, d: str) -> DataFrame:
    return base.notes(spark, d).select("id", tx.without_accents(c("sfld")).alias("sfld"))


@query("t11_checksum_mismatch", "SELECT id FROM n WHERE csum IS NULL OR csum <> ('0x' || substr(sha1(sfld), 1, 8))::BIGINT")
def checksum_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Notes whose stored checksum is not that of their sort field."""
    return base.notes(spark, d).where(c("csum").isNull() | (c("csum") != tx.field_checksum(c("sfld")))).select("id")


@query("t12_normalized_fields", r"SELECT id, nfc_normalize(regexp_replace(sfld, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')) AS sfld FROM n")
def normalized_fields(spark: SparkSession, d: str) -> DataFrame:
    """Sort fields without control characters, composed."""
    return base.notes(spark, d).select("id", tx.normalized_field(c("sfld")).alias("sfld"))


@query("t13_first_field_states", f"""
, f AS (SELECT id, mid, flds, {first_sql('flds')} AS f FROM n), k AS (SELECT mid, f, count(*) AS k FROM f GROUP BY 1, 2)
SELECT f.id, CASE WHEN f.f = '' THEN 'empty' WHEN k.k > 1 THEN 'duplicate' WHEN t.config LIKE '%"cloze"%' AND NOT regexp_matches(f.flds, '\\{{\\{{c[1-9]') THEN 'missing_cloze' WHEN t.config NOT LIKE '%"cloze"%' AND regexp_matches(f.flds, '\\{{\\{{c[1-9]') THEN 'no_cloze_type' ELSE 'normal' END AS state
FROM f LEFT JOIN k ON k.mid IS NOT DISTINCT FROM f.mid AND k.f = f.f LEFT JOIN (SELECT id, min(config) AS config FROM notetypes GROUP BY id) t ON t.id = f.mid""")
def field_states(spark: SparkSession, d: str) -> DataFrame:
    """State of each note's first field without markup: empty, duplicate within its type, cloze marks missing or out of
    place. Notes are counted by the checksum and the text of the field; empty fields, of which there may be very many, are
    not counted."""
    first = tx.strip_html_keep_media(tx.field_at(c("flds"), 0))
    notes = base.notes(spark, d).select("id", F.coalesce("mid", F.lit(-1)).alias("mid"), "flds", first.alias("f"))
    same = notes.where(c("f") != "").groupBy("mid", "f").agg(count("k")).where(c("k") > 1)
    types = table(spark, d, "notetypes", "id", "config").groupBy(c("id").alias("mid")).agg(F.contains(F.min("config"), F.lit('"cloze"')).alias("is_cloze"))
    marked = c("flds").rlike(r"\{\{c[1-9]")
    rows = notes.join(same, ["mid", "f"], "left").join(types, "mid", "left")
    state = F.when(c("f") == "", "empty").when(c("k") > 1, "duplicate").when(c("is_cloze") & ~marked, "missing_cloze").when(~c("is_cloze") & marked, "no_cloze_type").otherwise("normal")
    return rows.select("id", state.alias("state"))


@query("c2_without_clozes", r"SELECT id, regexp_replace(flds, '(?s)\{\{c[\d,]+::(.*?)(::.*?)?\}\}', '\1', 'g') AS flds FROM n WHERE contains(flds, '{{c')")
def without_clozes(spark: SparkSession, d: str) -> DataFrame:
    return base.notes(spark, d).where(F.contains("flds", F.lit("{{c"))).select("id", tx.strip_clozes(c("flds")).alias("flds"))


@query("c3_cloze_numbers", r"SELECT DISTINCT id, unnest(list_transform(regexp_extract_all(flds, '\{\{c(\d+)::', 1), lambda x: x::INTEGER)) AS number FROM n")
def cloze_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = base.notes(spark, d).where(F.contains("flds", F.lit("{{c")))
    return rows.select("id", F.explode(cloze.cloze_numbers(c("flds"))).alias("number"))


@query("c4_cloze_answers", r"""
, a AS (SELECT id, regexp_extract_all(flds, '(?s)\{\{c1::(.*?)(?:::.*?)?\}\}', 1) AS a FROM n)
SELECT id, CASE WHEN len(list_distinct(a)) = 1 THEN a[1] ELSE array_to_string(a, ', ') END AS answer FROM a WHERE len(a) > 0""")
def cloze_answers(spark: SparkSession, d: str) -> DataFrame:
    """What has to be typed for the first cloze of every note that has it."""
    rows = base.notes(spark, d).where(F.contains("flds", F.lit("{{c1::")))
    return rows.select("id", cloze.cloze_answer(c("flds"), F.lit(1)).alias("answer"))


#: Templates of the registered queries, by what is in the name of a note type.
FRONT, BACK = "{{#%s}}{{%s}}{{/%s}}", "{{FrontSide}}<hr id=answer>{{%s}}"


def templates_of(fields: list[str], kinds: list[str], is_cloze: bool) -> list[tuple[str, str]]:
    """(front, back) of each template of a note type."""
    if is_cloze:
        return [(f"{{{{cloze:{fields[0]}}}}}", f"{{{{cloze:{fields[0]}}}}}<br>{{{{{fields[-1]}}}}}")]
    a, b = fields[0], fields[min(1, len(fields) - 1)]
    pairs = [(a, b), (b, a)][: len(kinds)]
    return [(FRONT % (x, x, x), BACK % y) for x, y in pairs]


def _generator(types: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    parsed = {mid: ([(template.parse(f), template.parse(b)) for f, b in pairs], fields, is_cloze) for mid, (pairs, fields, is_cloze) in types.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for nid, mid, flds in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if mid not in parsed or flds is None:
                    continue
                pairs, names, is_cloze = parsed[mid]
                texts = flds.split("\x1f")
                fields = {n: texts[i] if i < len(texts) else "" for i, n in enumerate(names)}
                filled = {n for n, t in fields.items() if not template.is_empty_field(t)}
                ords = [min(k - 1, cloze.MAX_ORD) for k in cloze.numbers(flds)] if is_cloze else [i for i, (f, _) in enumerate(pairs) if template.renders(f, filled)]
                for o in sorted(set(ords)):
                    f, b = pairs[0] if is_cloze else pairs[o]
                    front = template.render(f, fields, ord_=o)
                    out.append((nid, o, front, template.render(b, fields, ord_=o, question=False, front=front)))
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["nid", "ord", "question", "answer"])

    return run


def generated(spark: SparkSession, d: str) -> DataFrame:
    """(nid, ord, question, answer) of the cards that the templates give for each note."""
    col = base.collection(spark, d)
    types = {nt.id: (templates_of(nt.fields, nt.templates, nt.cloze), nt.fields, nt.cloze) for nt in col.catalog.notetypes if nt.fields}
    return col.notes.select("id", "mid", "flds").mapInArrow(_generator(types), "nid bigint, ord int, question string, answer string")


GENERATED_SQL = r"""
, t AS (SELECT id, min(name) AS name, min(config) AS config FROM notetypes GROUP BY id), f AS (SELECT n.id, t.name, t.config, n.flds, string_split(n.flds, chr(31)) AS x FROM n JOIN t ON t.id = n.mid)
SELECT id AS nid, 0 AS ord FROM f WHERE config NOT LIKE '%"cloze"%' AND NOT regexp_full_match(coalesce(x[1], ''), '(?is)(?:\s|</?(?:br|div)\s*/?>)*')
UNION ALL SELECT id, 1 FROM f WHERE name LIKE '%reversed%' AND NOT regexp_full_match(coalesce(x[2], ''), '(?is)(?:\s|</?(?:br|div)\s*/?>)*')
UNION ALL SELECT DISTINCT id, unnest(list_transform(regexp_extract_all(flds, '\{\{c(\d+)::', 1), lambda v: v::INTEGER - 1)) FROM f WHERE config LIKE '%"cloze"%'"""


@query("c6_generated_cards", GENERATED_SQL)
def generated_cards(spark: SparkSession, d: str) -> DataFrame:
    return generated(spark, d).select("nid", "ord")


@query("c8_rendered_cards")
def rendered_cards(spark: SparkSession, d: str) -> DataFrame:
    """Question and answer of every card of the templates."""
    return generated(spark, d)


@query("q14_empty_cards", GENERATED_SQL.replace("SELECT id AS nid", "SELECT k.id FROM c k JOIN n ON n.id = k.nid WHERE NOT EXISTS (SELECT 1 FROM (SELECT id AS nid", 1) + ") g WHERE g.nid = k.nid AND g.ord = k.ord)")
def empty_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards that their templates no longer give."""
    cards = base.cards(spark, d).select("id", "nid", "ord")
    return cards.join(base.notes(spark, d).select(c("id").alias("nid")), "nid", "left_semi").join(generated(spark, d).select("nid", "ord"), ["nid", "ord"], "left_anti").select("id")


@query("c11_latex", r"SELECT id FROM n WHERE regexp_matches(flds, '(?is)\[latex\].+?\[/latex\]|\[\$\].+?\[/\$\]|\[\$\$\].+?\[/\$\$\]')")
def latex(spark: SparkSession, d: str) -> DataFrame:
    return base.notes(spark, d).where(F.size(tx.latex_parts(c("flds"))) > 0).select("id")


@query("c12_answer_diffs")
def answer_diffs(spark: SparkSession, d: str) -> DataFrame:
    """The second field of each note as if the first had been typed."""
    rows = base.notes(spark, d).select("id", tx.field_at(c("flds"), 1).alias("b"), tx.field_at(c("flds"), 0).alias("a"))
    return rows.select("id", answerdiff.compare_answers(c("b"), c("a")).alias("diff"))


@query("fnv_of_cards", f"SELECT id, CAST({tx.fnv_sql('id', 'mod')} AS BIGINT) AS hash FROM c")
def fnv_of_cards(spark: SparkSession, d: str) -> DataFrame:
    return base.cards(spark, d).select("id", tx.fnv_hash(c("id"), c("mod")).alias("hash"))


def register(spark: SparkSession, d: str) -> None:
    """Tables as views and functions under their usual names, for plain SQL."""
    for name, df in {"cards": base.cards(spark, d), "notes": base.notes(spark, d), "revlog": base.revlog(spark, d), "decks": base.decks(spark, d)}.items():
        df.createOrReplaceTempView(name)
    table(spark, d, "notetypes").createOrReplaceTempView("notetypes")
    spark.udf.register("fnvhash", tx.fnv_hash)
    spark.udf.register("without_combining", tx.without_accents)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION field_at_index(flds STRING, i INT) RETURNS STRING RETURN coalesce(try_element_at(split(flds, '\\u001f'), i + 1), '')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION extract_original_position(data STRING) RETURNS INT RETURN try_cast(get_json_object(data, '$.pos') AS INT)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION extract_custom_data(data STRING, k STRING) RETURNS STRING RETURN get_json_object(get_json_object(data, '$.cd'), concat('$.', k))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION extract_fsrs_variable(data STRING, k STRING) RETURNS DOUBLE RETURN try_cast(get_json_object(data, concat('$.', k)) AS DOUBLE)")
    spark.udf.register("process_text", tx.process_text)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION regexp_fields(pattern STRING, flds STRING, ords ARRAY<INT> DEFAULT array()) RETURNS BOOLEAN RETURN exists(transform(split(flds, '\\u001f'), (f, i) -> (size(ords) = 0 OR array_contains(ords, i)) AND f RLIKE pattern), x -> x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION regexp_tags(pattern STRING, tags STRING) RETURNS BOOLEAN RETURN exists(split(tags, ' '), t -> t RLIKE pattern)")
    number = "try_cast(get_json_object(data, '$.{}') AS DOUBLE)".format
    decay = f"coalesce({number('decay')}, {mem.DECAY_5}D)"
    last = "try_cast(get_json_object(data, '$.lrt') AS BIGINT)"
    elapsed = f"(CASE WHEN {last} IS NOT NULL THEN greatest(now - {last}, 0) WHEN due > {mem.DUE_IS_TIME_MEMORY} THEN greatest(now - (due - ivl), 0) ELSE greatest(today - (due - ivl), 0) * 86400 END / 86400D)"
    curve = f"pow(1 + (pow(0.9D, -1 / {decay}) - 1) * {elapsed} / {number('s')}, -{decay})"
    known = f"{number('s')} IS NOT NULL AND {number('d')} IS NOT NULL"
    # The day's end is an argument for the sake of the usual form; days are counted by today.
    args = "data STRING, due BIGINT, ivl BIGINT, today BIGINT, next_day_at BIGINT, now BIGINT"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION extract_fsrs_retrievability({args}) RETURNS DOUBLE RETURN CASE WHEN {known} THEN {curve} END")
    relative = f"-(pow(greatest({curve}, 0.0001D), -1 / {decay}) - 1) / (pow(greatest(coalesce({number('dr')}, 0.9D), 0.0001D), -1 / {decay}) - 1)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION extract_fsrs_relative_retrievability({args}) RETURNS DOUBLE RETURN CASE WHEN {known} THEN {relative} ELSE -(greatest({elapsed}, 0D) + 0.001D) / greatest(ivl, 1) END")


@query("snk5_functions", f"""
SELECT k.id, r, relative, regexp_matches(split_part(n.flds, chr(31), 1), 'the') AS in_first, regexp_matches(n.flds, '[0-9]') AS in_any, len(list_filter(string_split(n.tags, ' '), lambda t: regexp_matches(t, '^lang'))) > 0 AS tagged
FROM (SELECT id, nid, round({R_SQL}, 6) AS r, round({REL_SQL}, 6) AS relative FROM c WHERE type = 2 AND {STATE}) k JOIN n ON k.nid = n.id""")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The functions of the SQL surface in one statement."""
    register(spark, d)
    args = f"c.data, CASE WHEN c.odue <> 0 THEN c.odue ELSE c.due END, c.ivl, {T.days_elapsed}, {T.next_day_at}, {T.now}"
    return spark.sql(f"""
SELECT c.id, round(extract_fsrs_retrievability({args}), 6) AS r, round(extract_fsrs_relative_retrievability({args}), 6) AS relative,
       regexp_fields('the', n.flds, array(0)) AS in_first, regexp_fields('[0-9]', n.flds) AS in_any, regexp_tags('^lang', n.tags) AS tagged
FROM cards c JOIN notes n ON c.nid = n.id WHERE c.type = 2 AND extract_fsrs_variable(c.data, 's') IS NOT NULL AND extract_fsrs_variable(c.data, 'd') IS NOT NULL""")


@query("snk5_raw_sql", "SELECT d.name, count(*) AS n, CAST(sum(length(split_part(n.flds, chr(31), 1))) AS BIGINT) AS chars FROM c JOIN n ON c.nid = n.id JOIN d ON c.did = d.id GROUP BY d.name")
def raw_sql(spark: SparkSession, d: str) -> DataFrame:
    """SQL text over the views, with the registered functions."""
    register(spark, d)
    return spark.sql("SELECT d.name, count(*) AS n, sum(length(field_at_index(n.flds, 0))) AS chars FROM cards c JOIN notes n ON c.nid = n.id JOIN decks d ON c.did = d.id GROUP BY d.name")



# --- sinks and sources -----------------------------------------------------------------------------------------------

CELL_SQL = "CASE WHEN regexp_matches({0}, '[\"\\t\\n\\r]|^#') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@query("snk1_note_lines", f"""
, w AS (SELECT max(len(string_split(flds, chr(31)))) AS width FROM n), x AS (SELECT id, list_transform(range(width), lambda i: coalesce(string_split(flds, chr(31))[i + 1], '')) || [array_to_string(list_filter(regexp_split_to_array(tags, '[ \u3000]'), lambda t: t <> ''), ' ')] AS cells FROM n, w)
SELECT id, array_to_string(list_transform(cells, lambda x: {CELL_SQL.format('x')}), chr(9)) AS line FROM x""")
def note_lines(spark: SparkSession, d: str) -> DataFrame:
    """The notes as the lines of an export."""
    notes = base.notes(spark, d)
    return notes.select("id", delimited.note_line(delimited.widest(notes)).alias("line"))


@query("src10_round_trip", r"""
SELECT guid, list_transform(range((SELECT max(len(string_split(flds, chr(31)))) FROM n)), lambda i: regexp_replace(trim(coalesce(string_split(flds, chr(31))[i + 1], '')), '\r\n|\n', '<br>', 'g')) AS fields, list_sort(list_distinct(list_filter(regexp_split_to_array(tags, '[ 　]'), lambda t: t <> ''))) AS tags FROM n""")
def round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Notes written as delimited text into the shared folder and imported again by their header lines."""
    notes = base.notes(spark, d)
    path = f"{checkpoint_dir(spark)}/notes-{uuid.uuid4().hex}"
    delimited.write_notes(notes, path, extra={"guid": c("guid")})
    return delimited.read_notes(spark, path, n_columns=delimited.widest(notes) + 2, multiline=True).select("guid", "fields", F.array_sort("tags").alias("tags"))
