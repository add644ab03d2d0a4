"""Comparison of a typed answer with the right one."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

GOOD, BAD, MISSING = "typeGood", "typeBad", "typeMissed"


def plain(text: str) -> str:
    """The right answer as one line of text."""
    text = re.sub(r"(?is)\[sound:.*?\]", "", text)
    text = re.sub(r"(?is)\n|<br\s*/?>|</?div>", " ", text)
    return html.unescape(re.sub(r"(?s)<.*?>", "", text)).replace(" ", " ").strip()


def tokens(typed: str, right: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(kind, text) of the typed and of the right answer; missing parts are dashes in the typed one."""
    a, b = (unicodedata.normalize("NFC", x) for x in (typed, right))
    mine: list[tuple[str, str]] = []
    theirs: list[tuple[str, str]] = []
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            mine.append((GOOD, a[i1:i2]))
            theirs.append((GOOD, b[j1:j2]))
        elif op == "insert":
            mine.append((MISSING, "-" * (j2 - j1)))
            theirs.append((MISSING, b[j1:j2]))
        else:
            mine.append((BAD, a[i1:i2]))
            if op == "replace":
                theirs.append((MISSING, b[j1:j2]))
    return mine, theirs


def _spans(parts: list[tuple[str, str]]) -> str:
    """A leading mark gets a blank of its own, so that it does not join the part before."""
    lead = lambda t: " " + t if t and unicodedata.category(t[0]).startswith("M") else t
    return "".join(f"<span class={kind}>{html.escape(lead(t), quote=False)}</span>" for kind, t in parts)


def compare(right: str, typed: str, marks: bool = True) -> str:
    """The comparison as markup. marks False: combining marks are ignored."""
    wanted = plain(right)
    if not typed:
        return f"<code id=typeans>{html.escape(wanted, quote=False)}</code>"
    if not marks:
        drop = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.category(c).startswith("M"))
        typed, bare = drop(typed), drop(wanted)
        if typed == bare:
            return f"<code id=typeans><span class={GOOD}>{html.escape(wanted, quote=False)}</span></code>"
        wanted = bare
    if unicodedata.normalize("NFC", typed) == unicodedata.normalize("NFC", wanted):
        return f"<code id=typeans><span class={GOOD}>{html.escape(wanted, quote=False)}</span></code>"
    mine, theirs = tokens(typed, wanted)
    return f"<code id=typeans>{_spans(mine)}<br><span id=typearrow>&darr;</span><br>{_spans(theirs)}</code>"


@F.pandas_udf(T.StringType())
def compare_answers(right: pd.Series, typed: pd.Series) -> pd.Series:
    return pd.Series([compare(r, t) if isinstance(r, str) and isinstance(t, str) else None for r, t in zip(right, typed, strict=True)])
