"""Card templates: fields in double braces with filters, conditionals, comments."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from recallgrid.functions import cloze


class TemplateError(ValueError):
    def __init__(self, kind: str, detail: str) -> None:
        super().__init__(f"{kind}: {detail}")
        self.kind, self.detail = kind, detail


@dataclass
class Replace:
    key: str
    filters: list[str]


@dataclass
class If:
    key: str
    wanted: bool
    children: list = field(default_factory=list)


@dataclass
class Comment:
    text: str


Part = str | Replace | If | Comment
ALTERNATE = "{{=<% %>=}}"
_TOKEN = re.compile(r"<!--.*?-->|\{\{", re.S)
_ALT_TOKEN = re.compile(r"<!--.*?-->|\{\{|<%", re.S)


def parse(text: str) -> list[Part]:
    """The parts of a template; a leading line in the old syntax also allows <% %>."""
    token, body = _TOKEN, text
    if text.lstrip().startswith(ALTERNATE):
        token, body = _ALT_TOKEN, text.lstrip()[len(ALTERNATE) :]
    top: list[Part] = []
    stack: list[tuple[str | None, list[Part]]] = [(None, top)]
    at = 0
    while True:
        m = token.search(body, at)
        if m is None:
            if body[at:]:
                stack[-1][1].append(body[at:])
            break
        if m.start() > at:
            stack[-1][1].append(body[at : m.start()])
        if m.group().startswith("<!--"):
            stack[-1][1].append(Comment(m.group()))
            at = m.end()
            continue
        close = "%>" if m.group() == "<%" else "}}"
        end = body.find(close, m.end())
        if end < 0:
            raise TemplateError("NoClosingBrackets", body[m.start() : m.start() + 40])
        inside = body[m.end() : end].strip().lstrip("{").strip()
        at = end + 2
        key = inside[1:].strip()
        if inside[:1] in ("#", "^"):
            node = If(key, inside[0] == "#")
            stack[-1][1].append(node)
            stack.append((key, node.children))
        elif inside[:1] == "/":
            if stack[-1][0] != key:
                raise TemplateError("ConditionalNotOpen", f"{key}, open: {stack[-1][0]}")
            stack.pop()
        else:
            parts = inside.split(":")
            stack[-1][1].append(Replace(parts[-1], parts[-2::-1]))
    if stack[-1][0] is not None:
        raise TemplateError("ConditionalNotClosed", stack[-1][0])
    return top


def is_empty_field(text: str) -> bool:
    """Blank, or nothing but breaks and empty divisions."""
    return re.fullmatch(r"(?is)(?:\s|</?(?:br|div)\s*/?>)*", text) is not None


def renders(parts: list[Part], filled: set[str]) -> bool:
    """Whether anything but text shows with the fields that are not empty."""
    for p in parts:
        if isinstance(p, Replace) and p.key in filled:
            return True
        if isinstance(p, If) and (p.key in filled) == p.wanted and renders(p.children, filled):
            return True
    return False


_RUBY = re.compile(r" ?([^ >]+?)\[(.+?)\]")


def _ruby(text: str, make: Callable[[str, str], str]) -> str:
    return _RUBY.sub(lambda m: m.group() if m.group(2).startswith("sound:") else make(m.group(1), m.group(2)), text.replace("&nbsp;", " "))


def _strip(text: str) -> str:
    return html.unescape(re.sub(r"(?s)<.*?>", "", re.sub(r"(?is)<!--.*?-->|<style.*?>.*?</style>|<script.*?>.*?</script>", "", text))).replace(" ", " ")


def _hint(text: str, name: str) -> str:
    if not text.strip():
        return text
    id_ = hashlib.blake2b((text + name).encode(), digest_size=8).hexdigest()
    return f'<details class=hint id="hint{id_}"><summary>{name}</summary>{text}</details>'


def apply_filter(name: str, text: str, field_name: str, ord_: int = 0, question: bool = True) -> str | None:
    """The text after a filter; None for one that is unknown."""
    simple: dict[str, Callable[[], str]] = {
        "": lambda: text, "text": lambda: _strip(text), "furigana": lambda: _ruby(text, lambda a, b: f"<ruby><rb>{a}</rb><rt>{b}</rt></ruby>"), "kanji": lambda: _ruby(text, lambda a, b: a), "kana": lambda: _ruby(text, lambda a, b: b),
        "type": lambda: f"[[type:{field_name}]]", "type-cloze": lambda: f"[[type:cloze:{field_name}]]", "type-nc": lambda: f"[[type:nc:{field_name}]]", "hint": lambda: _hint(text, field_name),
        "cloze": lambda: cloze.reveal(text, ord_ + 1, question), "cloze-only": lambda: cloze.reveal_only(text, ord_ + 1, question),
    }
    if name in simple:
        return simple[name]()
    return f"[tts lang={name[4:]}]{text}[/tts]" if name.startswith("tts ") else None


def render(parts: list[Part], fields: dict[str, str], *, ord_: int = 0, question: bool = True, front: str | None = None) -> str:
    """The text of a side. FrontSide is the other side, without sounds; a field that does not exist is an error."""
    filled = {k for k, v in fields.items() if not is_empty_field(v)}
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(p)
        elif isinstance(p, Comment):
            out.append(p.text)
        elif isinstance(p, If):
            cloze_number = re.fullmatch(r"c(\d+)", p.key)
            if p.key not in fields and not cloze_number and p.key not in ("Tags", "Type", "Deck", "Subdeck", "Card", "CardFlag"):
                raise TemplateError("NoSuchConditional", p.key)
            there = int(cloze_number.group(1)) == ord_ + 1 if cloze_number and p.key not in fields else p.key in filled
            if there == p.wanted:
                out.append(render(p.children, fields, ord_=ord_, question=question, front=front))
        else:
            if p.key == "FrontSide":
                out.append(re.sub(r"(?is)\[sound:.*?\]", "", front or ""))
                continue
            if p.key not in fields:
                raise TemplateError("FieldNotFound", p.key)
            names = {("cloze", "type"): ["type-cloze"], ("nc", "type"): ["type-nc"]}.get(tuple(p.filters), ["type"] if p.filters[-1:] == ["type"] else p.filters)
            text = fields[p.key]
            for name in names:
                text = got if (got := apply_filter(name, text, p.key, ord_, question)) is not None else text
            out.append(text)
    return "".join(out)


def field_names(parts: list[Part]) -> list[str]:
    """Fields that a template names, in order."""
    out: list[str] = []
    for p in parts:
        if isinstance(p, Replace):
            out.append(p.key)
        elif isinstance(p, If):
            out += [p.key, *field_names(p.children)]
    return list(dict.fromkeys(out))


def renamed(parts: list[Part], names: dict[str, str | None]) -> str:
    """The template's text with fields renamed; None removes a replacement and unwraps a conditional."""
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(p)
        elif isinstance(p, Comment):
            out.append(p.text)
        elif isinstance(p, If):
            key, inner = names.get(p.key, p.key), renamed(p.children, names)
            out.append(inner if key is None else f"{{{{{'#' if p.wanted else '^'}{key}}}}}{inner}{{{{/{key}}}}}")
        else:
            key = names.get(p.key, p.key)
            if key is not None:
                out.append("{{" + ":".join([*reversed(p.filters), key]) + "}}")
    return "".join(out)


def requirement(parts: list[Part], fields: list[str]) -> tuple[str, list[int]]:
    """What a template needs to show anything: ('any', fields of which one is enough), ('all', fields) or ('none', [])."""
    anyof = [i for i, f in enumerate(fields) if renders(parts, {f})]
    if anyof:
        return "any", anyof
    if not renders(parts, set(fields)):
        return "none", []
    return "all", [i for i, f in enumerate(fields) if not renders(parts, set(fields) - {f})]
