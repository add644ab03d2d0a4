"""Text functions: markup, media references, wildcards, accents, checksums.

Native expressions wherever Spark has them; Arrow UDFs for entities, normalisation and accents.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters without a decomposition, and what stands for them when accents are ignored.
PLAIN_LETTERS = {
    "€": "E", "Æ": "AE", "Ð": "D", "Ø": "O", "Þ": "TH", "ß": "s", "æ": "ae", "ð": "d", "ø": "o", "þ": "th", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h",
    "ı": "i", "ĸ": "k", "Ł": "L", "ł": "l", "Ŋ": "N", "ŋ": "n", "Œ": "OE", "œ": "oe", "Ŧ": "T", "ŧ": "t", "Ə": "E", "ǝ": "e", "ɑ": "a",
}

FIELD_SEPARATOR = "\x1f"
# The patterns of markup.
_COMMENT_STYLE_SCRIPT = r"(?is)<!--.*?-->|<style.*?>.*?</style>|<script.*?>.*?</script>"
_ANY_TAG = r"(?s)<.*?>"
#: Media of tags that name a file in an attribute, quoted or not.
MEDIA_TAG = r"""(?is)<(?:img|audio|video|object|source)\b[^>]*?\b(?:src|data)\s*=\s*(?:"([^">]*)"|'([^'>]*)'|([^\s>"']+))[^>]*>"""
SOUND_TAG = r"(?is)\[sound:(.*?)\]"
CLOZE = r"(?s)\{\{c[\d,]+::(.*?)(::.*?)?\}\}"


# --- wildcards -------------------------------------------------------------------------------------------------------


class Sign(NamedTuple):
    """A character of a wildcard text; any: what it stands for, '' for itself; held: a backslash stood before it."""

    char: str
    any: str = ""
    held: bool = False


def signs(text: str) -> Iterator[Sign]:
    """The characters of a wildcard text: * stands for any run, _ for any one, unless a backslash holds them back."""
    rest = iter(text)
    for char in rest:
        if char == "\\":
            held = next(rest, None)
            yield Sign(char) if held is None else Sign(held, held=True)
        else:
            yield Sign(char, any={"*": "run", "_": "one"}.get(char, ""))


def is_glob(text: str) -> bool:
    """Whether a wildcard stands in the text."""
    return any(s.any for s in signs(text))


def unescaped(text: str) -> str:
    return "".join(s.char for s in signs(text))


def _plain(s: Sign) -> str:
    """What a sign without a wildcard's meaning matches: a backslash before a common character stays one."""
    return "\\" + s.char if s.held and s.char not in "*_\\" else s.char


def glob_to_regex(text: str, wildcard: str = ".") -> str:
    """A regular expression of a wildcard text, in which wildcard matches any one character."""

    each = {"run": wildcard + "*", "one": wildcard}
    return "".join(each[s.any] if s.any else re.escape(_plain(s)) for s in signs(text))


def glob_to_like(text: str) -> str:
    """A LIKE pattern of a wildcard text, with a backslash before signs that stand for themselves."""

    def literal(chars: str) -> str:
        return "".join("\\" + c if c in "%_\\" else c for c in chars)

    each = {"run": "%", "one": "_"}
    return "".join(each[s.any] if s.any else literal(_plain(s)) for s in signs(text))


# --- accents and normal forms ----------------------------------------------------------------------------------------


def strip_accents(text: str) -> str:
    """Compatibility decomposition without marks; the letters of PLAIN_LETTERS become plain ones."""
    return "".join(PLAIN_LETTERS.get(c, c) for c in unicodedata.normalize("NFKD", text) if not unicodedata.category(c).startswith("M"))


@cache
def plain_sql(column: str) -> str:
    """The same as SQL: DuckDB takes off accents, compatibility forms of one character are exchanged before by a table."""
    forms = {}
    for ch in map(chr, (*range(0xA0, 0xD800), *range(0xF900, 0x10000))):
        plain = strip_accents(ch)
        if len(plain) == 1 and plain != ch and (ch in PLAIN_LETTERS or unicodedata.normalize("NFD", ch) == ch):
            forms[ch] = plain
    out = f"translate({column}, '{''.join(forms)}', '{''.join(forms.values()).replace(chr(39), chr(39) * 2)}')"
    for letter, plain in PLAIN_LETTERS.items():
        if len(plain) > 1:
            out = f"replace({out}, '{letter}', '{plain}')"
    return f"strip_accents({out})"


def _mapped(series: pd.Series, fn) -> pd.Series:  # noqa: ANN001
    return series.map(fn, na_action="ignore")


@F.pandas_udf(T.StringType())
def without_accents(s: pd.Series) -> pd.Series:
    return _mapped(s, strip_accents)


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return _mapped(s, lambda x: unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def unescape_entities(s: pd.Series) -> pd.Series:
    return _mapped(s, lambda x: html.unescape(x).replace(" ", " ") if "&" in x else x.replace(" ", " "))


# --- markup ----------------------------------------------------------------------------------------------------------


def decode_entities(c: Column) -> Column:
    """Entities become characters, hard blanks blanks; Python is called only for texts with an ampersand."""
    return F.when(F.contains(c, F.lit("&")), unescape_entities(c)).otherwise(F.replace(c, F.lit(" "), F.lit(" ")))


def strip_tags(c: Column) -> Column:
    """Without comments, styles, scripts and tags, in that order; entities stay."""
    return F.regexp_replace(F.regexp_replace(c, _COMMENT_STYLE_SCRIPT, ""), _ANY_TAG, "")


def strip_html(c: Column) -> Column:
    return decode_entities(strip_tags(c))


def strip_html_keep_media(c: Column) -> Column:
    """As strip_html, but media tags leave their file name between blanks."""
    return strip_html(F.regexp_replace(c, MEDIA_TAG, " $1$2$3 "))


def plain_keep_media(text: str) -> str:
    """The same for one text on the driver."""
    text = re.sub(MEDIA_TAG, lambda m: f" {m.group(1) or m.group(2) or m.group(3) or ''} ", text)
    return html.unescape(re.sub(_ANY_TAG, "", re.sub(_COMMENT_STYLE_SCRIPT, "", text))).replace("\u00a0", " ")


def to_text_line(c: Column, keep_media: bool = False) -> Column:
    """One line of text: breaks become blanks, type-in and sound marks go, as does markup."""
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|<div>|\n", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)\[\[type:[^\]]+\]\]", ""), SOUND_TAG, " $1 " if keep_media else "")
    return F.trim(strip_html_keep_media(c) if keep_media else strip_html(c))


def strip_for_speech(c: Column) -> Column:
    """Markup becomes one blank each, runs of blanks one."""
    c = F.regexp_replace(F.regexp_replace(c, _COMMENT_STYLE_SCRIPT, " "), _ANY_TAG, " ")
    return F.trim(F.regexp_replace(decode_entities(c), r"\s+", " "))


def strip_av_tags(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, SOUND_TAG, ""), r"(?is)\[\w+:tts .*?\].*?\[/\w+:tts\]", "")


def strip_clozes(c: Column) -> Column:
    return F.regexp_replace(c, CLOZE, "$1")


def media_refs(c: Column) -> Column:
    """File names that a text refers to: those of tags, then those of sounds, without web addresses."""
    tags = F.transform(F.regexp_extract_all(c, F.lit(MEDIA_TAG), F.lit(0)), lambda t: F.coalesce(*[F.nullif(F.regexp_extract(t, MEDIA_TAG, i), F.lit("")) for i in (1, 2, 3)], F.lit("")))
    sounds = F.regexp_extract_all(c, F.lit(SOUND_TAG), F.lit(1))
    return F.filter(F.concat(tags, sounds), lambda n: (n != "") & ~n.rlike("(?i)^(?:https?|ftp)://"))


def underscored_refs(c: Column) -> Column:
    """Names of files that begin with an underscore, from style imports and attributes; these are kept by media checks."""
    css = r"""(?i)(?:@import\s+(?:"(_[^"]*\.css)"|'(_[^']*\.css)')|url\(\s*["']?(_[^"')]+)["']?\s*\))"""
    attr = r"""(?i)(?:src|data|href)\s*=\s*(?:"(_[^"]+)"|'(_[^']+)')"""

    def found(pattern: str, groups: int) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda t: F.coalesce(*[F.nullif(F.regexp_extract(t, pattern, i + 1), F.lit("")) for i in range(groups)], F.lit("")))

    return F.array_distinct(F.concat(found(css, 3), found(attr, 2)))


_LOCAL = re.compile(r"""(?is)(<(?:img|audio|video|object|source)\b[^>]*?\b(?:src|data)\s*=\s*)("[^">]*"|'[^'>]*'|[^\s>"']+)""")


def _paths(text: str, change) -> str:  # noqa: ANN001
    def one(m: re.Match[str]) -> str:
        mark = m.group(2)[0] if m.group(2)[0] in "\"'" else ""
        name = m.group(2).strip("\"'")
        return m.group() if re.match(r"(?i)(?:https?|ftp)://", name) else f"{m.group(1)}{mark}{change(name)}{mark}"

    return _LOCAL.sub(one, text)


@F.pandas_udf(T.StringType())
def encode_paths(s: pd.Series) -> pd.Series:
    """Local file names in media tags with signs that a web address can't hold as percent codes."""
    return _mapped(s, lambda x: _paths(x, lambda n: quote(html.unescape(n), safe="/!$&()*+,;=:@~-._'?[]{}|\\^%")))


@F.pandas_udf(T.StringType())
def decode_paths(s: pd.Series) -> pd.Series:
    """Percent codes of local file names in media tags as the signs that they stand for."""
    return _mapped(s, lambda x: _paths(x, lambda n: html.escape(unquote(html.unescape(n)), quote=True) if "%" in n else n))


@F.pandas_udf(T.StringType())
def process_text(s: pd.Series, flags: pd.Series) -> pd.Series:
    """Text by flags: 2 strips clozes, 1 accents, in this order."""

    def one(text: str, bits: int) -> str:
        if bits & 2:
            text = re.sub(CLOZE, lambda m: m.group(1), text)
        return strip_accents(text) if bits & 1 else text

    return pd.Series([one(t, int(b)) if isinstance(t, str) else None for t, b in zip(s, flags, strict=True)])


def latex_parts(c: Column) -> Column:
    """Formulas between [latex], [$] and [$$] marks."""
    pattern = r"(?is)\[latex\](.+?)\[/latex\]|\[\$\](.+?)\[/\$\]|\[\$\$\](.+?)\[/\$\$\]"
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda t: F.coalesce(*[F.nullif(F.regexp_extract(t, pattern, i), F.lit("")) for i in (1, 2, 3)]))


# --- note fields -----------------------------------------------------------------------------------------------------


def fields_of(flds: Column) -> Column:
    return F.split(flds, FIELD_SEPARATOR)


def field_at(flds: Column, index: int | Column) -> Column:
    """A field by its place from 0; '' where there is none."""
    at = (F.lit(index) if isinstance(index, int) else index) + 1
    return F.coalesce(F.try_element_at(fields_of(flds), at), F.lit(""))


def field_checksum(text: Column) -> Column:
    """The first four bytes of the SHA-1 of the text, as a number."""
    return F.conv(F.substring(F.sha1(F.encode(text, "utf-8")), 1, 8), 16, 10).cast("bigint")


def normalized_field(c: Column) -> Column:
    """Without control characters but tab and line break, composed."""
    return nfc(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))


def tag_list(tags: Column) -> Column:
    """The tags of a note as an array; they are separated by blanks, also wide ones."""
    return F.filter(F.split(tags, "[ 　]"), lambda t: t != "")


def joined_tags(tags: Column) -> Column:
    """Tags as they are stored, with blanks around; '' for none."""
    return F.when(F.size(tags) > 0, F.concat(F.lit(" "), F.array_join(tags, " "), F.lit(" "))).otherwise(F.lit(""))


# --- hashing ---------------------------------------------------------------------------------------------------------

_FNV_OFFSET, _FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(*values: int) -> int:
    """FNV-1a of 64-bit integers, byte by byte from the low end, as a signed number."""
    h = _FNV_OFFSET
    for v in values:
        for b in (v & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little"):
            h = ((h ^ b) * _FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


@F.pandas_udf(T.LongType())
def fnv_hash(a: pd.Series, b: pd.Series) -> pd.Series:
    """FNV-1a of two integers for whole batches; multiplication wraps around."""
    import numpy as np

    h = np.full(len(a), _FNV_OFFSET, np.uint64)
    with np.errstate(over="ignore"):
        for s in (a, b):
            v = s.fillna(0).to_numpy().astype(np.int64).view(np.uint64)
            for shift in range(0, 64, 8):
                h = (h ^ ((v >> np.uint64(shift)) & np.uint64(0xFF))) * np.uint64(_FNV_PRIME)
    return pd.Series(h.view(np.int64))


def fnv_sql(*values: str) -> str:
    """The same as SQL with 128-bit integers, for values of SQL that are not negative."""
    h = f"{_FNV_OFFSET}::HUGEINT"
    for v in values:
        for shift in range(0, 64, 8):
            h = f"((xor(CAST({h} AS UBIGINT), CAST((CAST({v} AS BIGINT) >> {shift}) & 255 AS UBIGINT))::HUGEINT * {_FNV_PRIME}) % {1 << 64})"
    return f"(({h} + {1 << 63}) % {1 << 64} - {1 << 63})"
