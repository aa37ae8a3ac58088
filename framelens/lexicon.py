"""Lexicons as data: signals, overrides, markers and ordered rules.

A lexicon is small by nature (hundreds of rows), and its patterns are inlined
into the plan as literals so that the compiled regex is reused by every row of
a task. ``from_table`` therefore checks the size instead of assuming it.

Patterns are written in lower case and matched against lower-cased text, which
keeps them independent of case-folding differences between regex engines.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from framelens.operators.scale import collect_bounded

MAX_LEXICON_ROWS = 5_000


@dataclass(frozen=True)
class Signal:
    """One weighted pattern that speaks for one pole."""

    pattern: str
    pole: str
    weight: float
    kind: str = ""

    def __post_init__(self) -> None:
        if not self.pattern:
            raise ValueError("a signal needs a pattern")
        if self.weight <= 0:
            raise ValueError(f"weight must be positive: {self.pattern!r}")


@dataclass(frozen=True)
class Override:
    """A designation that belongs to pole A although part of it scores for pole B."""

    names: tuple[str, ...]
    amount: float = 1.5


@dataclass(frozen=True)
class DomainRule:
    """A domain with the value it maps to; rules are tried in list order."""

    domain: str
    value: str
    note: str = ""


@dataclass(frozen=True)
class TextRule:
    """``label`` applies when any of ``any_of`` occurs, all of ``also`` occur
    and none of ``none_of`` does."""

    label: str
    any_of: tuple[str, ...]
    also: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()


@dataclass(frozen=True)
class GroupPattern:
    """One pattern of a named group (for example a narrative trope)."""

    group: str
    pattern: str


@dataclass(frozen=True)
class Lexicon:
    signals: tuple[Signal, ...]
    pole_a: str = "a"
    pole_b: str = "b"
    overrides: tuple[Override, ...] = ()
    attribution: tuple[str, ...] = ()
    structured: tuple[str, ...] = ()
    news_domains: tuple[str, ...] = ()
    topic_terms: tuple[str, ...] = ()
    tiers: tuple[DomainRule, ...] = field(default=())
    default_tier: str = "independent"

    def __post_init__(self) -> None:
        if len(self.signals) > MAX_LEXICON_ROWS:
            raise ValueError(f"lexicon has more than {MAX_LEXICON_ROWS} signals")
        poles = {self.pole_a, self.pole_b}
        bad = sorted({s.pole for s in self.signals} - poles)
        if bad:
            raise ValueError(f"signals with unknown pole: {bad}")

    def of_pole(self, pole: str) -> tuple[Signal, ...]:
        return tuple(s for s in self.signals if s.pole == pole)

    @staticmethod
    def signals_from_table(df: DataFrame) -> tuple[Signal, ...]:
        """Read (pattern, pole, weight, kind) rows; raises beyond the size bound."""
        rows = collect_bounded(df.select("pattern", "pole", "weight", "kind"), MAX_LEXICON_ROWS)
        return tuple(Signal(r["pattern"], r["pole"], float(r["weight"]), r["kind"] or "") for r in rows)

    @classmethod
    def from_table(cls, df: DataFrame, **parts) -> "Lexicon":
        return cls(signals=cls.signals_from_table(df), **parts)


def domain_rules_from_table(df: DataFrame) -> tuple[DomainRule, ...]:
    """Read (priority, domain, value, note) rows in priority order."""
    rows = collect_bounded(df.select("priority", "domain", "value", "note"), MAX_LEXICON_ROWS)
    return tuple(DomainRule(r["domain"], r["value"], r["note"] or "") for r in sorted(rows, key=lambda r: r["priority"]))


def group_names(patterns: Iterable[GroupPattern]) -> Sequence[str]:
    """Group names in first-seen order."""
    return list(dict.fromkeys(p.group for p in patterns))
