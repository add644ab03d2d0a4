"""Enumerations, time model and the catalogue of small tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import DataFrame

DAY = 86_400


class CardType(IntEnum):
    NEW, LEARN, REVIEW, RELEARN = range(4)


class Queue(IntEnum):
    USER_BURIED, SCHED_BURIED, SUSPENDED, NEW, LEARN, REVIEW, DAY_LEARN, PREVIEW = range(-3, 5)


class Kind(IntEnum):
    """Kinds of review log entries."""

    LEARNING, REVIEW, RELEARNING, FILTERED, MANUAL, RESCHEDULED = range(6)


@dataclass(frozen=True)
class Timing:
    """The clock of a query, fixed on the driver: seconds now, day number today, and the next rollover in seconds."""

    now: int
    days_elapsed: int
    next_day_at: int

    @property
    def today_ms(self) -> int:
        return (self.next_day_at - DAY) * 1000


def timing(now: int, created: int, rollover_hour: int = 4, offset_minutes: int = 0, created_offset_minutes: int | None = None) -> Timing:
    """The time model: the next rollover after now, and the calendar days between the days of creation and now.

    The offset is in minutes east of UTC. Before the rollover hour the day is still the one before; never below 0.
    """
    shift = offset_minutes * 60
    local = now + shift
    midnight = local - local % DAY
    rollover = midnight + rollover_hour * 3600
    next_day = rollover if local < rollover else rollover + DAY
    shift_created = (offset_minutes if created_offset_minutes is None else created_offset_minutes) * 60
    days = local // DAY - (created + shift_created) // DAY - (1 if local < rollover else 0)
    return Timing(now, max(days, 0), next_day - shift)


#: The clock of the registered queries. The tables hold reviews of July to October 2025.
CLOCK = Timing(now=1_759_370_000, days_elapsed=5_000, next_day_at=1_759_377_600)

#: Most rows of a dimension that is read to the driver.
MAX_DIMENSION = 100_000


def small_rows(df: DataFrame, limit: int = MAX_DIMENSION) -> list:
    """The rows of a small table; an error instead of a cut if it is larger than allowed."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a dimension has more than {limit} rows")
    return rows


@dataclass
class Deck:
    id: int
    name: str
    config_id: int | None
    filtered: bool

    @property
    def human(self) -> str:
        return self.name.replace("\x1f", "::")


@dataclass
class Notetype:
    id: int
    name: str
    cloze: bool
    fields: list[str] = field(default_factory=list)
    excluded: set[int] = field(default_factory=set)
    templates: list[str] = field(default_factory=list)


@dataclass
class Catalog:
    """Decks and note types, by which names in a search are resolved on the driver."""

    decks: list[Deck]
    notetypes: list[Notetype]
    presets: dict[int, str] = field(default_factory=dict)
    current_deck: str = "Default"


def deck_kind(text: str | None) -> tuple[int | None, bool]:
    """(preset id, filtered) of a deck's JSON; broken JSON gives (None, False)."""
    try:
        data = json.loads(text or "{}")
    except ValueError:
        return None, False
    if not isinstance(data, dict):
        return None, False
    normal = data.get("normal")
    return (normal.get("config_id") if isinstance(normal, dict) else None), "filtered" in data


def catalog(decks: DataFrame, notetypes: DataFrame, fields: DataFrame) -> Catalog:
    """The catalogue of the tables decks, notetypes and notetype_fields; templates are named 'Card 1' and so on."""
    ds = [Deck(r["id"], r["name"] or "", *deck_kind(r["kind"])) for r in small_rows(decks.select("id", "name", "kind"))]
    nts = {r["id"]: Notetype(r["id"], r["name"] or "", '"cloze"' in (r["config"] or "")) for r in small_rows(notetypes.select("id", "name", "config").distinct())}
    for r in sorted(small_rows(fields.select("ntid", "ord", "name").distinct()), key=lambda r: (r["ntid"], r["ord"])):
        if r["ntid"] in nts:
            nts[r["ntid"]].fields.append(r["name"])
    for nt in nts.values():
        nt.templates = ["Cloze"] if nt.cloze else ["Card 1", "Card 2"] if "reversed" in nt.name else ["Card 1"]
    presets = {d.config_id: f"Preset {d.config_id}" for d in ds if d.config_id is not None}
    return Catalog(sorted(ds, key=lambda d: d.id), sorted(nts.values(), key=lambda n: n.id), presets)
