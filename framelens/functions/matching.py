"""Pattern primitives shared by all text functions.

Patterns are literals of the plan: Spark compiles such a regex once per task,
whereas a pattern that comes from a column is compiled again and again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from os.path import commonprefix

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = frozenset("\\.[]{}()*+?^$|")


def is_literal(pattern: str) -> bool:
    """True when the pattern has no regex metacharacter."""
    return not any(ch in _META for ch in pattern)


def quote(text: str) -> str:
    """Escape ``text`` so that it is a regex for itself in Java and RE2 syntax."""
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", text)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def matches(text: Column, pattern: str) -> Column:
    """Does ``pattern`` occur; a plain byte search when it is a literal."""
    if is_literal(pattern):
        return F.contains(text, F.lit(pattern))
    return F.regexp_like(text, F.lit(pattern))


def count_matches(text: Column, pattern: str) -> Column:
    """Number of non-overlapping leftmost matches (measured faster than replace-and-compare for literals too)."""
    return F.regexp_count(text, F.lit(pattern))


def overlaps_itself(word: str) -> bool:
    """Can an occurrence of the word begin within another one: does it end as it begins."""
    return any(word.startswith(word[k:]) for k in range(1, len(word)))


def any_word(words: Iterable[str]) -> str:
    """A regex for the longest of the plain words that stand at a place, by their common beginnings."""

    def rest(tails: list[str]) -> str:
        first: dict[str, list[str]] = {}
        for x in tails:
            if x:
                first.setdefault(x[0], []).append(x)
        starts = {commonprefix(group): group for group in first.values()}
        ways = "|".join(quote(p) + rest([x[len(p):] for x in group]) for p, group in starts.items())
        return f"(?:{ways})" + ("?" if "" in tails else "") if ways else ""

    return rest(sorted(set(words)))


def any_match(text: Column, patterns: Sequence[str]) -> Column:
    """Does any pattern occur. Literals are tried first, each as a plain search."""
    ordered = sorted(patterns, key=lambda p: not is_literal(p))
    return any_true(matches(text, p) for p in ordered)


def any_contains(text: Column, words: Sequence[str]) -> Column:
    """Does any of the plain words occur as a substring."""
    return any_true(F.contains(text, F.lit(w)) for w in words)


def any_true(conditions: Iterable[Column]) -> Column:
    return _balanced(list(conditions), lambda a, b: a | b, F.lit(False))


def all_true(conditions: Iterable[Column]) -> Column:
    return _balanced(list(conditions), lambda a, b: a & b, F.lit(True))


def total(terms: Iterable[Column], zero: Column) -> Column:
    return _balanced(list(terms), lambda a, b: a + b, zero)


def _balanced(items: list[Column], op, empty: Column) -> Column:
    # A balanced tree keeps expression depth logarithmic in the lexicon size.
    if not items:
        return empty
    while len(items) > 1:
        items = [op(items[i], items[i + 1]) if i + 1 < len(items) else items[i] for i in range(0, len(items), 2)]
    return items[0]


def first_case(pairs: Iterable[tuple[Column, object]], default=None) -> Column:
    """Ordered CASE: the first true condition decides."""
    out = None
    for cond, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    fallback = default if isinstance(default, Column) else F.lit(default)
    return fallback if out is None else out.otherwise(fallback)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda of a higher-order function evaluates the outer expressions it
    names again for every element; a bound variable is computed only once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_to_null(c: Column) -> Column:
    """Missing text is written as an empty string in the source records."""
    return F.nullif(F.trim(c), F.lit(""))


def text_rule(text: Column, rule) -> Column:
    """Condition of one :class:`framelens.lexicon.TextRule` on lower-cased text."""
    cond = any_contains(text, rule.any_of)
    for w in rule.also:
        cond = cond & F.contains(text, F.lit(w))
    for w in rule.none_of:
        cond = cond & ~F.contains(text, F.lit(w))
    return cond


def rules_case(text: Column, rules, default=None) -> Column:
    """Label of the first rule that applies."""
    return first_case(((text_rule(text, r), r.label) for r in rules), default)
