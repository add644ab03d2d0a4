"""Problem 1: one consistent form for texts that look the same.

The form is computed by DuckDB SQL inside Arrow partitions (nfc_normalize, translate, regular expressions). Its tables
are built from the Unicode character database by the rules below; only the look-alike letters are stated.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.duck import over_partitions
from recallgrid.operators.skew import salted_pairs
from recallgrid.session import cut

# Letters of other scripts that are drawn like a Latin letter, or like one of another script, in pairs
# (letter, what it is drawn like). No two unaccented letters of one script may have the same target.
CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԌG ԚQ ԜW аa сc еe һh іi јj ԛq оo рp ѕs ԝw хx уy ԁd ӏl ѵv"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ οo ρp ϲc ϳj"
ARMENIAN = "ՕO ՍU ՏS օo սu հh"
CHEROKEE = "ᎪA ᏴB ᏟC ᎠD ᎬE ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᏚS ᎢT ᏙV ᎳW ᏃZ"
COPTIC = "ⲞO ⲟo ⲤC ⲥc ⲢP ⲣp ⲘM ⲚN ⲦT"
#: Katakana drawn like Han characters or Hiragana.
KANA = "カ力 エ工 タ夕 ニ二 ト卜 ロ口 ハ八 ヘへ"
#: Pairs whose capital and small forms are drawn like different letters would merge two Latin letters when case is
#: ignored, too; problem 4 uses these small letters, which belong to a capital above.
SMALL_BY_CAPITAL = "вb кk мm нh тt αa βb εe ζz ηh ιi κk μm νn τt υy χx"

#: Characters with a format category that are nevertheless drawn.
DRAWN_FORMAT = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
#: Characters without width outside the format category: joiner of graphemes, fillers and variation selectors.
WIDTHLESS = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0000, 0xE1000)]
#: Hyphens drawn like hyphen-minus, blanks that are not of the separator category.
HYPHENS, BLANKS = [0x2010, 0x2011], [0x2800, 0x3164, 0xFFA0]
#: Ranges of compatibility characters that are a second code of the same character, not another form of it: micro sign,
#: digraphs, ligatures, Roman numerals, radicals, jamo.
SAME_CHARACTER = [range(0xB5, 0xB6), range(0x132, 0x134), range(0x1C4, 0x1CD), range(0x1F1, 0x1F4), range(0xFB00, 0xFB07), range(0xFB13, 0xFB18), range(0x2160, 0x2180), range(0x2E80, 0x2FD6), range(0x3131, 0x318F)]


def pairs(*rows: str) -> dict[str, str]:
    return {p[0]: p[1] for row in rows for p in row.split()}


LETTERS = pairs(CYRILLIC, GREEK, ARMENIAN, CHEROKEE, COPTIC, KANA)


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(points: list[int]) -> str:
    """A regular-expression class of code points, as ranges."""
    out, points = [], sorted(set(points))
    start = last = points[0]
    for p in [*points[1:], -1]:
        if p != last + 1:
            out.append(f"\\x{{{start:X}}}" + (f"-\\x{{{last:X}}}" if last > start else ""))
            start = p
        last = p
    return "[" + "".join(out) + "]"


@cache
def widthless() -> str:
    controls = [*range(0x00, 0x09), *range(0x0E, 0x1C), 0x7F, *range(0x80, 0x85), *range(0x86, 0xA0)]
    formats = [cp for cp in range(0xF0000) if unicodedata.category(chr(cp)) == "Cf" and cp not in DRAWN_FORMAT]
    return _class(controls + formats + WIDTHLESS)


@cache
def compatibility() -> tuple[dict[str, str], dict[str, str]]:
    """Wide and narrow forms, blanks, hyphens and second codes: those of one character and those of several."""
    one, more = {}, {}
    for cp in range(0xA0, 0x20000):
        ch = chr(cp)
        kind, _, rest = unicodedata.decomposition(ch).partition(" ")
        if unicodedata.category(ch) == "Zs" or cp in BLANKS:
            one[ch] = " "
        elif cp in HYPHENS:
            one[ch] = "-"
        elif kind in ("<wide>", "<narrow>") or kind == "<noBreak>" or kind == "<compat>" and any(cp in r for r in SAME_CHARACTER):
            to = unicodedata.normalize("NFC", "".join(chr(int(x, 16)) for x in rest.split()))
            to = "".join(one.get(c, c) for c in to) if kind != "<narrow>" else to
            (one if len(to) == 1 else more)[ch] = to
    # A digraph such as the capital one with caron decomposes in two steps.
    more = {k: unicodedata.normalize("NFKC", v) if any(ord(k) in r for r in SAME_CHARACTER) else v for k, v in more.items()}
    return one, more


@cache
def letters() -> tuple[dict[str, str], dict[str, str]]:
    """Look-alike letters with and without accents: targets of one character and of several."""
    one, more = dict(LETTERS), {}
    for cp in range(0xC0, 0x20000):
        ch = chr(cp)
        if ch in one or unicodedata.decomposition(ch).startswith("<"):
            continue
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and parts[0] in LETTERS and unicodedata.normalize("NFC", parts) == ch:
            to = unicodedata.normalize("NFC", LETTERS[parts[0]] + parts[1:])
            (one if len(to) == 1 else more)[ch] = to
    return one, more


def translate_sql(name: str, table: dict[str, str]) -> str:
    """translate with the table, worked out only for texts that hold one of its characters: it reads the table for each."""
    table = {a: b for a, b in sorted(table.items()) if a != b}
    matches = f"regexp_matches({name}, {_literal(_class([ord(c) for c in table]))})"
    return f"CASE WHEN {matches} THEN translate({name}, {_literal(''.join(table))}, {_literal(''.join(table.values()))}) ELSE {name} END"


def parted(table: dict[str, str]) -> list[dict[str, str]]:
    """The table in parts that occur together: blanks and hyphens, wide and narrow forms, all others."""
    near = {a: b for a, b in table.items() if b in (" ", "-")}
    forms = {a: b for a, b in table.items() if 0xFF00 <= ord(a) <= 0xFFEF and a not in near}
    return [t for t in (near, forms, {a: b for a, b in table.items() if a not in near and a not in forms}) if t]


def replace_sql(expr: str, name: str, table: dict[str, str]) -> str:
    """Chained replacements, worked out only for texts that hold one of the characters."""
    chain = name
    for a, b in sorted(table.items()):
        chain = f"replace({chain}, {_literal(a)}, {_literal(b)})"
    return f"CASE WHEN regexp_matches({name}, {_literal(_class([ord(c) for c in table]))}) THEN {chain} ELSE {name} END"


@cache
def steps_sql(source: str, column: str = "text", keep: str = "*") -> str:
    """A query over source that adds form, the consistent form of column.

    In this order: line breaks of any kind become one kind and characters without width go; composition; compatibility
    forms; composition again, as narrow voiced sounds have only now become marks; look-alike letters; composition.
    """
    one, more = compatibility()
    l_one, l_more = letters()
    a = f"regexp_replace(regexp_replace({column}, '\\r\\n|[\\r\\x0b\\x0c\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), {_literal(widthless())}, '', 'g')"
    q = f"SELECT {keep}, nfc_normalize({a}) AS f1 FROM {source}"
    for table in parted(one):
        q = f"SELECT * REPLACE ({translate_sql('f1', table)} AS f1) FROM ({q})"
    q = f"SELECT * RENAME (f1 AS f2) FROM ({q})"
    q = f"SELECT * EXCLUDE (f2), nfc_normalize({replace_sql('f2', 'f2', more)}) AS f3 FROM ({q})"
    q = f"SELECT * EXCLUDE (f3), {translate_sql('f3', l_one)} AS f4 FROM ({q})"
    return f"SELECT * EXCLUDE (f4), nfc_normalize({replace_sql('f4', 'f4', l_more)}) AS form FROM ({q})"


def consistent_form(texts: DataFrame) -> DataFrame:
    """(tbl, key, form) of texts (tbl, key, text): texts look the same if and only if their forms are equal.

    Defined cases: a null text has a null form, an empty text an empty one; repeated rows are kept; the unit separator
    between the fields of a note is kept, so whole notes are compared field by field.
    """
    return over_partitions(texts.select("tbl", "key", "text"), f"SELECT tbl, key, form FROM ({steps_sql('part')})", "tbl string, key string, form string")


def look_alike_rows(texts: DataFrame) -> DataFrame:
    """(tbl, key, form_hash, form_check, raw_hash, n): rows in a group of equal forms with at least two different texts.

    Only hashes of 128 bits and a second hash leave the partition, not the texts. Null texts and keys are left out,
    repeated rows count once.
    """
    rows = texts.select("tbl", "key", "text").where(F.col("text").isNotNull() & F.col("key").isNotNull())
    sql = f"SELECT tbl, key, unhex(md5(form)) AS form_hash, (hash(form) >> 1)::BIGINT AS form_check, unhex(md5(text)) AS raw_hash FROM ({steps_sql('part')})"
    hashed = over_partitions(rows, sql, "tbl string, key string, form_hash binary, form_check bigint, raw_hash binary").distinct()
    hashed = cut(hashed)  # the texts are worked on once, not for each of the uses below
    group = ["tbl", "form_hash", "form_check"]
    groups = hashed.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("raw_hash").alias("lo_"), F.max("raw_hash").alias("hi_")).where(F.col("lo_") != F.col("hi_"))
    return hashed.join(groups.select(*group, "n"), group)


def look_alike_pairs(texts: DataFrame) -> DataFrame:
    """(tbl, key_a, key_b): all pairs of keys whose texts look the same but are not the same string; key_a < key_b.

    A group may be of any size: it is split, and each part meets the group in a task of its own.
    """
    pairs_ = salted_pairs(look_alike_rows(texts), ["tbl", "form_hash", "form_check"], "n", "raw_hash", "key")
    return pairs_.select("tbl", F.col("order_a").alias("key_a"), F.col("order_b").alias("key_b")).distinct()


def look_alike_classes(texts: DataFrame) -> DataFrame:
    """(tbl, key, class_id, n_members, n_links) of each row that looks like another one but is not the same string.

    class_id names the common form; n_members are the rows of the class, n_links those whose text differs from the row's
    own. One row per text, however large a class is.
    """
    rows = look_alike_rows(texts)
    same = rows.groupBy("tbl", "form_hash", "form_check", "raw_hash").agg(F.count(F.lit(1)).alias("same_"))
    both = rows.join(same, ["tbl", "form_hash", "form_check", "raw_hash"])
    return both.select("tbl", "key", F.lower(F.hex("form_hash")).alias("class_id"), F.col("n").alias("n_members"), (F.col("n") - F.col("same_")).alias("n_links"))
