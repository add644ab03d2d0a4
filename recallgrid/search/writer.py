"""From a tree to search text, and combinators that build trees."""

from __future__ import annotations

import re

from recallgrid.search.ast import WHOLE, All, Any, Group, Node, Not, Term, replace_terms
from recallgrid.search.parser import parse

_NEEDS_QUOTES = re.compile(r"^and$|^or$|^-.| |　|\(|\)", re.I)
_MODES = {"normal": "", "regex": "re:", "nc": "nc:"}


def _quote(text: str) -> str:
    out = text.replace('"', '\\"')
    return f'"{out}"' if _NEEDS_QUOTES.search(text) else out


def _num(x: float | int) -> str:
    return str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)


def _field(name: str, text: str, mode: str) -> str:
    if mode == "normal" and text.startswith(("re:", "nc:")):
        text = text.replace(":", "\\:", 1)
    escaped = name.replace(":", "\\:")
    return _quote(f"{escaped}:{_MODES[mode]}{text}")


def _rating(prefix: str, button: int | str) -> str:
    return prefix if button in ("any", "manual") else f"{prefix}:{button}"


def _term(t: Term) -> str:
    k, a = t.kind, t.args
    if k == "all":
        return "deck:*"
    if k == "text":
        return _quote(a[0].replace(":", "\\:"))
    if k == "field":
        return _field(*a)
    if k == "tag":
        return _field("tag", *a)
    if k in ("did", "nid", "cid"):
        return f"{k}:{','.join(map(str, a))}"
    if k == "rated":
        return f"resched:{a[0]}" if a[1] == "manual" else _rating(f"rated:{a[0]}", a[1])
    if k == "template":
        return f"card:{a[0] + 1}" if isinstance(a[0], int) else _quote(f"card:{a[0]}")
    if k == "dupe":
        escaped = a[1].replace("\\", "\\\\")
        return _quote(f"dupe:{a[0]},{escaped}")
    if k == "did_tree":
        return ""
    if k == "prop":
        name, op, val = a[:3]
        if name == "rated":
            return f"prop:resched{op}{val}" if a[3] == "manual" else _rating(f"prop:rated{op}{val}", a[3])
        text = f"prop:{name}{op}{val if isinstance(val, str) else _num(val)}"
        return _quote(text) if name.startswith("cds:") else text
    if k in ("added", "edited", "introduced", "mid", "flag", "is"):
        return f"{k}:{a[0]}"
    return _quote(f"{'has-cd' if k == 'cd' else k}:{a[0]}")


def write(node: Node) -> str:
    if isinstance(node, Term):
        return _term(node)
    if isinstance(node, Not):
        return "-" + write(node.item)
    if isinstance(node, Group):
        return f"({write(node.item)})"
    return (" OR " if isinstance(node, Any) else " ").join(write(x) for x in node.items)


def normalize(text: str) -> str:
    return write(parse(text))


def replace_term(text: str, new: str) -> str:
    """text with every term of the kind of new, a single term, replaced by it."""
    node = parse(new)
    if not isinstance(node, Term):
        raise ValueError("the replacement must be one term")
    return write(replace_terms(parse(text), node))


def _wrapped(node: Node, kind: type) -> Node:
    return Group(node) if isinstance(node, All | Any) and not isinstance(node, kind) else node


def all_of(*nodes: Node) -> Node:
    flat = [y for x in nodes for y in (x.items if isinstance(x, All) else (_wrapped(x, All),))]
    return WHOLE if not flat else flat[0] if len(flat) == 1 else All(tuple(flat))


def any_of(*nodes: Node) -> Node:
    flat = [y for x in nodes for y in (x.items if isinstance(x, Any) else (_wrapped(x, Any),))]
    return WHOLE if not flat else flat[0] if len(flat) == 1 else Any(tuple(flat))


def negated(node: Node) -> Node:
    return Not(Group(node) if isinstance(node, All | Any) else node)


def escape_wildcards(text: str) -> str:
    return re.sub(r"[\\*_]", r"\\\g<0>", text)


def literal(text: str) -> Term:
    """A search for the text itself."""
    return Term("text", (escape_wildcards(text),))


def due_in_days(n: int) -> Term:
    return Term("prop", ("due", "<=", n))


def due_on_day(n: int) -> Term:
    return Term("prop", ("due", "=", n))


def flagged(colour: int | None) -> Node:
    """Cards of a flag colour; None: of any."""
    return Not(Term("flag", (0,))) if colour is None else Term("flag", (colour,))


def deck(name: str) -> Term:
    return Term("deck", (escape_wildcards(name),))


def forgot(deck_name: str, days: int) -> Node:
    """Custom study: cards answered 'again' lately."""
    return all_of(Term("rated", (days, 1)), deck(deck_name))


def ahead(deck_name: str, days: int) -> Node:
    return all_of(Term("is", ("review",)), due_in_days(days), deck(deck_name))


def preview(deck_name: str, days: int) -> Node:
    return all_of(Term("is", ("new",)), Term("added", (days,)), deck(deck_name))


def cram(deck_name: str, state: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Node:
    """Custom study by tags: all, new, due or review cards of a deck that have one of the tags and none of the others."""
    states = {"all": [], "new": [Term("is", ("new",))], "due": [Term("is", ("due",))], "review": [negated(Term("is", ("new",)))]}[state]
    tags = [any_of(*[Term("tag", (escape_wildcards(t), "normal")) for t in include])] if include else []
    return all_of(*states, *tags, *[negated(Term("tag", (escape_wildcards(t), "normal"))) for t in exclude], deck(deck_name))
