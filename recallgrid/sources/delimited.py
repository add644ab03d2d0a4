"""Notes in delimited text: header lines, delimiter, columns; reading and writing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.functions import text as tx

#: Delimiters in the order in which they are looked for.
DELIMITERS = {"tab": "\t", "pipe": "|", "semicolon": ";", "colon": ":", "comma": ",", "space": " "}
#: Lines and characters at the start of a file that are looked at.
HEAD_LINES, HEAD_CHARS = 200, 8_192


@dataclass
class Metadata:
    delimiter: str | None = None
    is_html: bool | None = None
    global_tags: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    notetype: str | None = None
    deck: str | None = None
    #: Numbers of columns from 1; 0: none.
    tags_column: int = 0
    deck_column: int = 0
    notetype_column: int = 0
    guid_column: int = 0
    match_scope: str | None = None
    if_matches: str | None = None


def detect_delimiter(text: str) -> str:
    """The first delimiter, in their order, that occurs at all; else a blank."""
    return next((d for d in DELIMITERS.values() if d in text), " ")


def _column(value: str) -> int:
    return int(value) if value.strip().isdigit() else 0


def read_metadata(lines: list[str]) -> tuple[Metadata, int]:
    """The metadata in the header lines and how many lines these are. Unknown keys are passed over."""
    meta, used = Metadata(), 0
    for n, raw in enumerate(lines):
        line = raw.removeprefix("﻿") if n == 0 else raw
        if n == 0 and line.startswith("tags:"):
            meta.global_tags = line[5:].split()
            used = 1
            continue
        if not line.startswith("#"):
            break
        used = n + 1
        key, colon, value = line[1:].partition(":")
        if not colon:
            continue
        key = key.strip().lower()
        if key == "separator":
            name = value.strip().lower()
            meta.delimiter = DELIMITERS.get(name) or next((d for d in DELIMITERS.values() if value.lower() == d), meta.delimiter)
        elif key == "html":
            meta.is_html = {"true": True, "false": False}.get(value.strip().lower(), meta.is_html)
        elif key == "tags":
            meta.global_tags = value.split()
        elif key == "columns":
            meta.columns = value.split(meta.delimiter or detect_delimiter(value))
        elif key in ("notetype", "deck"):
            setattr(meta, key, value.strip())
        elif key in ("tags column", "deck column", "notetype column", "guid column"):
            setattr(meta, key.replace(" ", "_"), _column(value))
        elif key in ("match scope", "if matches"):
            setattr(meta, key.replace(" ", "_"), value.strip())
    return meta, used


def sniff(spark: SparkSession, path: str) -> Metadata:
    """The metadata of a file; the delimiter is that of the header or the first one found after it."""
    head = [r[0] for r in spark.read.text(path).take(HEAD_LINES)]
    meta, used = read_metadata(head)
    if meta.delimiter is None:
        meta = replace(meta, delimiter=detect_delimiter("\n".join(head[used:])[:HEAD_CHARS]))
    if meta.is_html is None:
        meta = replace(meta, is_html=bool(re.search(r"<[a-zA-Z/][^>]*>", "\n".join(head[used:])[:HEAD_CHARS])))
    return meta


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def read_notes(spark: SparkSession, path: str, meta: Metadata | None = None, *, n_columns: int | None = None, multiline: bool = False) -> DataFrame:
    """(fields, tags, deck, notetype, guid) of the rows of a file.

    Lines that begin with # are comments. Columns that hold tags, deck, note type or guid are no fields. Text that is not
    HTML is escaped; line breaks inside a field become <br>. multiline allows quoted line breaks, but such a file can't be
    split over tasks. n_columns is the width; without it that of the columns line or of the widest of the first lines.
    """
    meta = meta or sniff(spark, path)
    if n_columns is None:
        import csv

        head = [r[0] for r in spark.read.text(path).take(HEAD_LINES)]
        widths = [len(next(csv.reader([x], delimiter=meta.delimiter))) for x in head if x and not x.startswith("#")]
        n_columns = len(meta.columns) or max(widths, default=1)
    schema = ", ".join(f"c{i} string" for i in range(1, n_columns + 1))
    rows = spark.read.csv(path, schema=schema, sep=meta.delimiter, comment="#", quote='"', escape='"', multiLine=multiline, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue="\0", emptyValue="")
    special = {meta.tags_column, meta.deck_column, meta.notetype_column, meta.guid_column}

    def cell(i: int) -> Column:
        text = F.coalesce(F.col(f"c{i}"), F.lit(""))
        text = text if meta.is_html else escape_html(text)
        return F.regexp_replace(F.trim(text), r"\r\n|\n", "<br>")

    def named(i: int, default: str | None) -> Column:
        return F.coalesce(F.nullif(F.trim(F.col(f"c{i}")), F.lit("")), F.lit(default)) if 0 < i <= n_columns else F.lit(default)

    own = tx.tag_list(F.coalesce(F.col(f"c{meta.tags_column}"), F.lit(""))) if 0 < meta.tags_column <= n_columns else F.array().cast("array<string>")
    tags = F.array_distinct(F.concat(own, F.array(*[F.lit(t) for t in meta.global_tags]).cast("array<string>")))
    fields = F.array(*[cell(i) for i in range(1, n_columns + 1) if i not in special]).cast("array<string>")
    return rows.select(fields.alias("fields"), tags.alias("tags"), named(meta.deck_column, meta.deck).alias("deck"), named(meta.notetype_column, meta.notetype).alias("notetype"), named(meta.guid_column, None).alias("guid"))


def quoted(c: Column) -> Column:
    """A cell that can be read back: in quotes if it holds a delimiter, a quote, a line break or a leading #."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike(r'["\t\n\r]|^#'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def widest(notes: DataFrame) -> int:
    """Fields of the widest note."""
    return notes.agg(F.coalesce(F.max(F.size(tx.fields_of(F.col("flds")))), F.lit(1))).collect()[0][0]


def note_line(width: int, *, with_html: bool = True, with_tags: bool = True, extra: dict[str, Column] | None = None) -> Column:
    """A note as a line of tab-separated text, its fields padded to a width; extra are leading cells."""
    cells = [*(extra or {}).values(), *[tx.field_at(F.col("flds"), i) if with_html else tx.to_text_line(tx.field_at(F.col("flds"), i), keep_media=True) for i in range(width)]]
    if with_tags:
        cells.append(F.array_join(tx.tag_list(F.col("tags")), " "))
    return F.concat_ws("\t", *[quoted(x) for x in cells])


def write_notes(notes: DataFrame, path: str, *, with_html: bool = True, with_tags: bool = True, extra: dict[str, Column] | None = None, width: int | None = None) -> None:
    """Notes as tab-separated text, fields padded to the widest note; extra are leading columns such as guid or deck.

    Every part file begins with the header lines, so each is a file to import by itself.
    """
    width, extra = width or widest(notes), extra or {}
    head = ["#separator:tab", f"#html:{'true' if with_html else 'false'}"]
    head += [f"#{name} column:{i}" for i, name in enumerate(extra, 1)]
    if with_tags:
        head.append(f"#tags column:{len(extra) + width + 1}")
    lines = notes.select(note_line(width, with_html=with_html, with_tags=with_tags, extra=extra).alias("value"))

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array(head, pa.string())], names=["value"])
        for batch in batches:
            yield pa.record_batch([batch.column(0)], names=["value"])

    lines.mapInArrow(headed, "value string").write.mode("overwrite").text(path)


def write_cards(rendered: DataFrame, path: str) -> None:
    """(id, question, answer) of rendered cards as tab-separated text, in order of ids; the answer without its repeated front."""
    answer = F.regexp_replace("answer", r"(?s)^.*<hr id=answer>\s*", "")
    lines = rendered.select("id", F.concat_ws("\t", quoted(tx.to_text_line(F.col("question"))), quoted(tx.to_text_line(answer))).alias("value"))
    lines.orderBy("id").select("value").write.mode("overwrite").text(path)
