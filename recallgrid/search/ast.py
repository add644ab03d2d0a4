"""The tree of a search."""

from __future__ import annotations

from dataclasses import dataclass


class SearchError(ValueError):
    """A search that can't be read; kind names what is wrong."""

    def __init__(self, kind: str, detail: str = "") -> None:
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind, self.detail = kind, detail


@dataclass(frozen=True)
class Term:
    """A leaf: its kind and arguments, such as ('flag', 3) or ('field', 'Front', 'dog', 'normal')."""

    kind: str
    args: tuple = ()


@dataclass(frozen=True)
class Not:
    item: Node


@dataclass(frozen=True)
class Group:
    item: Node


@dataclass(frozen=True)
class All:
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Any:
    items: tuple[Node, ...]


Node = Term | Not | Group | All | Any

WHOLE = Term("all")
STATES = ("new", "review", "learn", "due", "buried", "buried-manually", "buried-sibling", "suspended")
OPERATORS = ("<=", ">=", "!=", "=", "<", ">")


def terms(node: Node) -> list[Term]:
    if isinstance(node, Term):
        return [node]
    if isinstance(node, Not | Group):
        return terms(node.item)
    return [t for x in node.items for t in terms(x)]


def replace_terms(node: Node, new: Term) -> Node:
    """Every term of new's kind is replaced by new."""
    if isinstance(node, Term):
        return new if node.kind == new.kind else node
    if isinstance(node, Not | Group):
        return type(node)(replace_terms(node.item, new))
    return type(node)(tuple(replace_terms(x, new) for x in node.items))
