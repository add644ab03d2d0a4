"""Problem 5: several values packed in one field, split by a parsing expression grammar."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values. Signs that separate in every field, and line breaks in every form.
SIGNS = ",;|，；｜、､،؛"
BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
HTML_BREAK = r"<(?:br\s*/?|/?(?:div|p|li)(?:\s[^<>]*)?)>"

#: Error flags of a value.
QUOTE_UNCLOSED, QUOTE_TRAILING, BRACKET_UNCLOSED = "quote_unclosed", "quote_trailing", "bracket_unclosed"


@dataclass
class Alternative:
    """One choice of a value: a pattern, what to make of its match, and the flags to set when it is tried but fails."""

    name: str
    opens: str
    pattern: re.Pattern[str]
    value: Callable[[str], str]
    failed: Callable[[str, int], str] = field(default=lambda text, at: "")


class Grammar:
    """field <- blank* value (blank* separator blank* value)* blank*; value <- quoted / bracketed / bare / nothing.

    The choice is ordered. An alternative must end at a separator or at the end of the field; if it does not, the parser
    goes back to where the value began and tries the next one, so a malformed quote becomes part of a bare value. All
    patterns are possessive: parsing takes time in proportion to the text, save that an unclosed quote or bracket is read
    to the end once more.
    """

    def __init__(self, *, blanks_separate: bool, brackets: str = "", signs: str = SIGNS) -> None:
        marks = re.escape(signs + BREAKS) + ("" if blanks_separate else "\t")
        separator = rf"(?:[{marks}]|{HTML_BREAK})" if not blanks_separate else rf"(?:[{marks}\s]|{HTML_BREAK})"
        # In a list field plain blanks are part of a value; around it they are dropped.
        blank = rf"(?:(?![{marks}])\s)*+" if not blanks_separate else ""
        self.blank = re.compile(blank)
        self.separator = re.compile(separator, re.I)
        end = rf"(?={blank}(?:[{marks}]|{HTML_BREAK}|\Z))" if not blanks_separate else rf"(?={separator}|\Z)"
        self.alternatives = [Alternative("quoted", '"', re.compile(rf'"(?:[^"]|"")*+"{end}', re.I), lambda m: m[1:-1].replace('""', '"'), self._quote)]
        for left, right in zip(brackets[::2], brackets[1::2], strict=True):
            inner = rf"[^{re.escape(left + right)}]*+"
            self.alternatives.append(Alternative("bracketed", left, re.compile(rf"{re.escape(left)}{inner}{re.escape(right)}{end}", re.I), lambda m: m[1:-1], lambda text, at: BRACKET_UNCLOSED))
        stop = marks + (r"\s" if blanks_separate else "")
        self.bare = re.compile(rf"(?:[^{stop}<]|(?!{HTML_BREAK})<)*+", re.I)

    @staticmethod
    def _quote(text: str, at: int) -> str:
        rest = text.find('"', at + 1)
        return QUOTE_UNCLOSED if rest < 0 else QUOTE_TRAILING

    def parse(self, text: str) -> Iterator[tuple[int, str, str, str]]:
        """(position from 1, value, alternative, error flag or '') of each non-empty value."""
        at, pos, n = 0, 0, len(text)
        while True:
            at = self.blank.match(text, at).end()
            kind, value, flag = "bare", None, ""
            for choice in self.alternatives:
                if text.startswith(choice.opens, at):
                    m = choice.pattern.match(text, at)
                    if m:
                        kind, value, at = choice.name, choice.value(m.group()), m.end()
                        break
                    flag = flag or choice.failed(text, at)
            if value is None:
                m = self.bare.match(text, at)
                value, at = m.group(), m.end()
            value = value.strip()
            if value:
                pos += 1
                yield pos, value, kind, flag
            at = self.blank.match(text, at).end()
            if at >= n:
                return
            m = self.separator.match(text, at)
            at = m.end() if m else at + 1  # always a separator here; a step keeps the parser from standing still


TAGS = Grammar(blanks_separate=True)
LIST_FIELD = Grammar(blanks_separate=False)
GRAMMARS = {"tags": TAGS, "flds": LIST_FIELD}
#: The same with square brackets, inside which nothing separates.
BRACKETED = {"tags": Grammar(blanks_separate=True, brackets="[]"), "flds": Grammar(blanks_separate=False, brackets="[]")}

OUT = pa.schema([("id", pa.int64()), ("fld", pa.string()), ("pos", pa.int32()), ("val", pa.string()), ("kind", pa.string()), ("error", pa.string())])
#: Rows of one result batch, so that very long fields do not make very large batches.
BATCH_ROWS = 20_000


def _splitter(grammars: dict[str, Grammar]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in OUT]

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(c, t.type) for c, t in zip(cols, OUT, strict=True)], schema=OUT)
            for c in cols:
                c.clear()
            return out

        for batch in batches:
            for id_, fld, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for pos, val, kind, flag in grammars[fld].parse(text):
                    for c, x in zip(cols, (id_, fld, pos, val, kind, flag or None), strict=True):
                        c.append(x)
                    if len(cols[0]) >= BATCH_ROWS:
                        yield flush()
        if cols[0]:
            yield flush()

    return run


def split_values(packed: DataFrame, grammars: dict[str, Grammar] = GRAMMARS) -> DataFrame:
    """(id, fld, pos, val, kind, error) of each value in packed (id, fld, text); fld names the grammar, 'tags' or 'flds'.

    pos counts from 1 within (id, fld); empty values have none; values that occur twice keep both. White space around a
    value is dropped. A run in double quotes is one value, two double quotes inside stand for one. kind is the
    alternative that matched; error is set where a quote was opened but malformed, and the value is then taken bare.

    Defined cases: null and empty texts give no rows; a repeated row counts once; a null id is kept as null.
    """
    rows = packed.select("id", "fld", "text").where(F.col("text").isNotNull() & (F.col("text") != "")).distinct()
    return rows.mapInArrow(_splitter(grammars), "id bigint, fld string, pos int, val string, kind string, error string")


def packed_fields(notes: DataFrame, fields: DataFrame) -> DataFrame:
    """(id, fld, text): the tags of each note, and the list fields of notes whose note type has one.

    fields is the dimension (ntid, ord, is_list). Ords outside the note's fields and note types that do not exist give
    nothing.
    """
    tags = notes.select("id", F.lit("tags").alias("fld"), F.col("tags").alias("text"))
    lists = fields.where(F.col("is_list")).select(F.col("ntid").alias("mid"), F.col("ord").cast("int").alias("ord_")).distinct()
    cells = notes.select("id", "mid", "flds").join(lists, "mid")
    cells = cells.select("id", F.lit("flds").alias("fld"), F.try_element_at(F.split("flds", "\x1f"), F.col("ord_") + 1).alias("text"))
    return tags.unionByName(cells)
