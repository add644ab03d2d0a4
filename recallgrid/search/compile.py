"""From a tree to Catalyst: a predicate over cards c and notes n, and what it needs."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.functions import memory as mem
from recallgrid.functions import text as tx
from recallgrid.model import DAY, CardType, Catalog, Queue, Timing
from recallgrid.search.ast import All, Any, Group, Node, Not, Term
from recallgrid.search.parser import parse

LEARN_AHEAD = 1_200


@dataclass
class Collection:
    """What a search runs over: the frames of cards, notes and reviews, the catalogue of names, and the clock."""

    cards: DataFrame
    notes: DataFrame
    revlog: DataFrame
    catalog: Catalog
    clock: Timing
    learn_ahead: int = LEARN_AHEAD
    ignore_accents: bool = False


@dataclass
class Predicate:
    column: Column
    cards: bool
    notes: bool
    #: Sets of card ids from the review log, joined as marker columns.
    markers: dict[str, DataFrame] = field(default_factory=dict)


def compare(op: str, a: Column, b: Column | float | int | str) -> Column:
    b = b if isinstance(b, Column) else F.lit(b)
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def regex(pattern: str) -> str:
    """Without regard to case, in all scripts."""
    return "(?iu)" + pattern


class Compiler:
    def __init__(self, col: Collection) -> None:
        self.col, self.need_cards, self.need_notes, self.markers = col, False, False, {}

    def run(self, node: Node) -> Predicate:
        column = self.node(node)
        return Predicate(column, self.need_cards, self.need_notes, self.markers)

    def node(self, x: Node) -> Column:
        if isinstance(x, Term):
            return getattr(self, "t_" + x.kind)(*x.args)
        if isinstance(x, Group):
            return self.node(x.item)
        if isinstance(x, Not):
            return ~self.node(x.item)
        parts = [self.node(i) for i in x.items]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(x, All) else out | p
        return out

    def card(self, name: str) -> Column:
        self.need_cards = True
        return F.col(f"c.{name}")

    def note(self, name: str) -> Column:
        self.need_notes = True
        return F.col(f"n.{name}")

    # Texts of notes.

    def _contains(self, text: str, accents: bool, change: Callable[[Column], Column] = lambda c: c) -> Column:
        pattern = tx.glob_to_like(text)
        pattern = "%" + (pattern if accents else tx.strip_accents(pattern)) + "%"
        plain = change if accents else (lambda c: tx.without_accents(change(c)))
        excluded = {nt.id: nt for nt in self.col.catalog.notetypes if nt.excluded}
        whole = self._like(plain(self.note("sfld")), pattern) | self._like(plain(self.note("flds")), pattern)
        if not excluded:
            return whole
        clauses = []
        for nt in self.col.catalog.notetypes:
            keep = [i for i in range(len(nt.fields)) if i not in nt.excluded]
            hits = [self._like(plain(tx.field_at(self.note("flds"), i)), pattern) for i in keep]
            if 0 in keep:
                hits.append(self._like(plain(self.note("sfld")), pattern))
            clauses.append((self.note("mid") == nt.id) & self._any(hits))
        return self._any(clauses)

    @staticmethod
    def _like(c: Column, pattern: str) -> Column:
        return F.ilike(c, F.lit(pattern))

    @staticmethod
    def _any(hits: list[Column]) -> Column:
        out = F.lit(False)
        for h in hits:
            out = out | h
        return out

    def t_text(self, text: str) -> Column:
        return self._contains(text, not self.col.ignore_accents)

    def t_nc(self, text: str) -> Column:
        return self._contains(text, False)

    def t_sc(self, text: str) -> Column:
        cloze = self.note("mid").isin([nt.id for nt in self.col.catalog.notetypes if nt.cloze])
        return cloze & self._contains(text, not self.col.ignore_accents, tx.strip_clozes)

    def t_re(self, pattern: str) -> Column:
        if not any(nt.excluded for nt in self.col.catalog.notetypes):
            return self.note("flds").rlike(regex(pattern))
        return self._any([(self.note("mid") == nt.id) & self._any([tx.field_at(self.note("flds"), i).rlike(regex(pattern)) for i in range(len(nt.fields)) if i not in nt.excluded]) for nt in self.col.catalog.notetypes])

    def t_w(self, word: str) -> Column:
        return self.t_re(r"(?U)\b" + tx.glob_to_regex(word) + r"\b")

    def t_field(self, name: str, text: str, mode: str) -> Column:
        flds = self.note("flds")
        if name in ("*", "_*", "*_"):
            pattern = regex(text) if mode == "regex" else "(?ius)^" + tx.glob_to_regex(text) + "$"
            return F.exists(tx.fields_of(flds), lambda f: f.rlike(pattern))
        wanted = tx.glob_to_regex(name)
        match = re.compile(f"^(?:{wanted})$", re.I)
        clauses = []
        for nt in self.col.catalog.notetypes:
            ords = [i for i, f in enumerate(nt.fields) if (match.match(f) if tx.is_glob(name) else f.lower() == tx.unescaped(name).lower())]
            if not ords:
                continue
            if mode == "regex":
                hits = [tx.field_at(flds, i).rlike(regex(text)) for i in ords]
            elif mode == "nc":
                hits = [self._like(tx.without_accents(tx.field_at(flds, i)), tx.strip_accents(tx.glob_to_like(text))) for i in ords]
            else:
                hits = [self._like(tx.field_at(flds, i), tx.glob_to_like(text)) for i in ords]
            clauses.append((self.note("mid") == nt.id) & self._any(hits))
        return self._any(clauses)

    def t_tag(self, tag: str, mode: str) -> Column:
        tags = self.note("tags")
        if mode == "regex":
            return F.exists(tx.tag_list(tags), lambda t: t.rlike(regex(tag)))
        if tag == "none":
            return tags == ""
        if tag == "*":
            return F.lit(True)
        if " " in tag:
            return F.lit(False)
        plain = tags if mode == "normal" else tx.without_accents(tags)
        wanted = tx.glob_to_regex(tag if mode == "normal" else tx.strip_accents(tag), r"\S")
        return plain.rlike(regex(f".* {wanted}(::| ).*"))

    def t_dupe(self, mid: int, text: str) -> Column:
        plain = tx.plain_keep_media(text)
        csum = int(hashlib.sha1(plain.encode()).hexdigest()[:8], 16)
        first = tx.strip_html_keep_media(tx.field_at(self.note("flds"), 0))
        return (self.note("mid") == mid) & (self.note("csum") == csum) & (first == plain)

    # Notes.

    def t_mid(self, mid: int) -> Column:
        return self.note("mid") == mid

    def t_note(self, name: str) -> Column:
        return self.note("mid").isin([nt.id for nt in self.col.catalog.notetypes if self._named(name, nt.name)])

    @staticmethod
    def _named(wanted: str, name: str) -> bool:
        if tx.is_glob(wanted):
            return re.match(f"^(?:{tx.glob_to_regex(wanted)})$", name, re.I) is not None
        return tx.unescaped(wanted).lower() == name.lower()

    def t_nid(self, *ids: int) -> Column:
        return (self.note("id") if not self.need_cards else self.card("nid")).isin(list(ids))

    def t_edited(self, days: int) -> Column:
        return self.note("mod") > self.col.clock.next_day_at - DAY * days

    # Cards.

    def t_template(self, which: int | str) -> Column:
        if isinstance(which, int):
            return self.card("ord") == which
        hits = [(self.note("mid") == nt.id) & (self.card("ord") == i) for nt in self.col.catalog.notetypes for i, t in enumerate(nt.templates) if self._named(which, t)]
        return self._any(hits)

    def _in_decks(self, ids: list[int]) -> Column:
        return self.card("did").isin(ids) | ((self.card("odid") != 0) & self.card("odid").isin(ids))

    def t_deck(self, name: str) -> Column:
        if name == "*":
            return F.lit(True)
        if name == "filtered":
            return self.card("odid") != 0
        wanted = re.escape(self.col.catalog.current_deck) if name == "current" else tx.glob_to_regex(name).replace("::", "\x1f")
        match = re.compile(f"^{wanted}($|\x1f)", re.I)
        return self._in_decks([d.id for d in self.col.catalog.decks if match.match(d.name)])

    def t_did(self, *ids: int) -> Column:
        return self._in_decks(list(ids))

    def t_did_tree(self, did: int) -> Column:
        top = next((d.name for d in self.col.catalog.decks if d.id == did), None)
        if top is None:
            return F.lit(False)
        return self.card("did").isin([d.id for d in self.col.catalog.decks if d.name == top or d.name.startswith(top + "\x1f")])

    def t_preset(self, name: str) -> Column:
        match = {i for i, p in self.col.catalog.presets.items() if self._named(name, p)}
        return self._in_decks([d.id for d in self.col.catalog.decks if d.config_id in match])

    def t_cid(self, *ids: int) -> Column:
        return self.card("id").isin(list(ids))

    def t_flag(self, n: int) -> Column:
        return self.card("flags").bitwiseAND(7) == n

    def t_is(self, state: str) -> Column:
        kind, queue = self.card("type"), self.card("queue")
        if state == "new":
            return kind == CardType.NEW
        if state == "review":
            return kind.isin([CardType.REVIEW, CardType.RELEARN])
        if state == "learn":
            return kind.isin([CardType.LEARN, CardType.RELEARN])
        if state == "suspended":
            return queue == Queue.SUSPENDED
        if state == "due":
            days = queue.isin([Queue.REVIEW, Queue.DAY_LEARN]) & (self.card("due") <= self.col.clock.days_elapsed)
            return days | (queue.isin([Queue.LEARN, Queue.PREVIEW]) & (self.card("due") <= self.col.clock.now + self.col.learn_ahead))
        buried = {"buried": [Queue.SCHED_BURIED, Queue.USER_BURIED], "buried-manually": [Queue.USER_BURIED], "buried-sibling": [Queue.SCHED_BURIED]}
        return queue.isin(buried[state])

    def t_added(self, days: int) -> Column:
        return self.card("id") > (self.col.clock.next_day_at - DAY * days) * 1000

    def _marker(self, reviews: DataFrame) -> Column:
        """Whether the card is among the cards of reviews: a left join of distinct ids, so that it combines with OR and NOT."""
        name = f"m{len(self.markers)}"
        self.markers[name] = reviews.select(F.col("cid").alias(f"{name}_id")).where(F.col(f"{name}_id").isNotNull()).distinct().withColumn(name, F.lit(True))
        self.need_cards = True
        return F.coalesce(F.col(name), F.lit(False))

    def t_introduced(self, days: int) -> Column:
        first = self.col.revlog.where(F.col("ease") != 0).groupBy("cid").agg(F.min("id").alias("first_"))
        return self._marker(first.where(F.col("first_") > (self.col.clock.next_day_at - DAY * days) * 1000))

    def _rated(self, op: str, days: int, button: int | str) -> Column:
        end = (self.col.clock.next_day_at + DAY * days) * 1000
        start = end - DAY * 1000
        id_, ease = F.col("id"), F.col("ease")
        day = id_.between(start, end - 1)
        when = {">": id_ >= end, ">=": id_ >= start, "<": id_ < start, "<=": id_ < end, "=": day, "!=": ~day}[op]
        how = ease > 0 if button == "any" else ease == 0 if button == "manual" else ease == button
        return self._marker(self.col.revlog.where(when & how))

    def t_rated(self, days: int, button: int | str) -> Column:
        return self._rated(">", -days, button)

    def t_prop(self, name: str, op: str, value, button: int | str = "any") -> Column:  # noqa: ANN001
        t = self.col.clock
        if name == "rated":
            return self._rated(op, value, button)
        due = F.when(self.card("odue") != 0, self.card("odue")).otherwise(self.card("due"))
        queue, data = self.card("queue"), self.card("data")
        if name == "due":
            days = queue.isin([Queue.REVIEW, Queue.DAY_LEARN]) & compare(op, due, value + t.days_elapsed)
            return days | (queue.isin([Queue.LEARN, Queue.PREVIEW]) & compare(op, self._div(due - t.next_day_at, DAY), value))
        if name in ("ivl", "reps", "lapses"):
            return compare(op, self.card(name), value)
        if name == "ease":
            return compare(op, self.card("factor"), max(0, math.trunc(value * 1000)))
        if name == "pos":
            return (self.card("type") == CardType.NEW) & compare(op, due, value)
        if name == "s":
            return compare(op, mem.number(data, "s"), value)
        if name == "d":
            return compare(op, mem.number(data, "d"), value * 9 + 1)
        if name == "r":
            r = mem.retrievability(data, due, self.card("ivl"), t)
            return F.when(self.card("type") == CardType.NEW, F.lit(False)).otherwise(compare(op, r, value))
        kind, key = name.split(":")
        got = mem.custom_data(data, key)
        return compare(op, got.try_cast("double") if kind == "cdn" else got, value)

    @staticmethod
    def _div(a: Column, b: int) -> Column:
        """Integer division that rounds towards zero."""
        q = a / F.lit(b)
        return F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q))

    def t_cd(self, key: str) -> Column:
        return mem.custom_data(self.card("data"), key).isNotNull()

    def t_all(self) -> Column:
        return F.lit(True)


def compile_search(col: Collection, search: str | Node) -> Predicate:
    """The predicate of a search; names of decks, note types and fields are resolved on the driver."""
    tree = parse(search) if isinstance(search, str) else search
    # A first pass shows whether cards are needed at all, so that nid: can use the card's column.
    probe = Compiler(col)
    probe.run(tree)
    real = Compiler(col)
    real.need_cards = probe.need_cards
    return real.run(tree)


def _frame(col: Collection, p: Predicate, cards: bool, notes: bool) -> DataFrame:
    c, n = col.cards.alias("c"), col.notes.alias("n")
    df = c.join(n, F.col("c.nid") == F.col("n.id")) if cards and notes else c if cards else n
    for name, ids in p.markers.items():
        df = df.join(ids, F.col("c.id") == F.col(f"{name}_id"), "left")
    return df.where(p.column)


def search_cards(col: Collection, search: str | Node, with_notes: bool = False) -> DataFrame:
    """Rows of the cards found, under alias c; notes are joined only where the search or the caller needs them."""
    p = compile_search(col, search)
    return _frame(col, p, True, p.notes or with_notes)


def find_cards(col: Collection, search: str | Node) -> DataFrame:
    """(id) of the cards found."""
    return search_cards(col, search).select(F.col("c.id").alias("id"))


def find_notes(col: Collection, search: str | Node) -> DataFrame:
    """(id) of the notes found; cards are joined only where the search needs them."""
    p = compile_search(col, search)
    if not p.cards:
        return _frame(col, p, False, True).select(F.col("n.id").alias("id"))
    df = _frame(col, p, True, p.notes)
    return df.select((F.col("n.id") if p.notes else F.col("c.nid")).alias("id")).distinct()
