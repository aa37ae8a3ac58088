"""Answers of question sets: classes, correctness and scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelens.functions import fixed
from framelens.functions.matching import any_contains, rules_case
from framelens.lexicon import TextRule


def _word_map(table: Mapping[str, Sequence[str]]) -> Column:
    parts: list[Column] = []
    for lang, words in table.items():
        parts += [F.lit(lang), F.array(*[F.lit(w.lower()) for w in words])]
    return F.create_map(*parts)


def _starts_with_any(text: Column, lang: Column, table: Mapping[str, Sequence[str]], fallback: str) -> Column:
    words = F.coalesce(_word_map(table)[lang], F.array(*[F.lit(w.lower()) for w in table[fallback]]))
    return F.exists(words, lambda w: F.startswith(text, w))


def classify_answer(answer: Column, lang: Column, named: Column, entity_rules: Sequence[TextRule], head: int = 100,
                    keep_raw: int = 0, yes: Mapping[str, Sequence[str]] = fixed.YES_WORDS,
                    no: Mapping[str, Sequence[str]] = fixed.NO_WORDS, hedges: Sequence[str] = fixed.HEDGE_WORDS,
                    fallback: str = "en") -> Column:
    """Class of a forced-choice answer from its head.

    Yes or no word of the language first, then a hedge word, then for questions
    flagged ``named`` the entity named; ``keep_raw`` > 0 returns that many
    characters of the answer when a ``named`` question hits no entity.
    """
    trimmed = F.trim(F.coalesce(answer, F.lit("")), F.lit(" \n\r\t"))
    t = F.left(F.lower(trimmed), F.lit(head))
    miss = F.left(trimmed, F.lit(keep_raw)) if keep_raw else F.lit("other")
    return (
        F.when(_starts_with_any(t, lang, yes, fallback), F.lit("yes"))
        .when(_starts_with_any(t, lang, no, fallback), F.lit("no"))
        .when(any_contains(t, hedges), F.lit("disputed"))
        .when(named, F.coalesce(rules_case(t, entity_rules), miss))
        .otherwise(F.lit("other"))
    )


def has_any_word(text: Column, words: Column) -> Column:
    """Does any element of an array column occur in ``text``; null arrays count as empty."""
    return F.coalesce(F.exists(words, lambda w: F.contains(text, w)), F.lit(False))


def classify_open(answer: Column, expected: Column, wrong: Column, a_phrases: Sequence[str] = (),
                  b_phrases: Sequence[str] = (), hedges: Sequence[str] = fixed.OPEN_HEDGES, a: str = "a",
                  b: str = "b") -> Column:
    """Struct (label, hedged, has_a, has_b) of an open answer."""
    t = F.lower(F.coalesce(answer, F.lit("")))
    has_a = has_any_word(t, expected) | any_contains(t, a_phrases)
    has_b = has_any_word(t, wrong) | any_contains(t, b_phrases)
    lab = (
        F.when(has_a & ~has_b, F.lit(a))
        .when(has_b & ~has_a, F.lit(b))
        .when(has_a & has_b, F.lit("disputed"))
        .otherwise(F.lit("no_signal"))
    )
    return F.struct(
        lab.alias("label"), any_contains(t, hedges).alias("hedged"), has_a.alias("has_a"), has_b.alias("has_b")
    )


def is_correct(classified: Column, expected: Column) -> Column:
    return F.lower(classified) == F.lower(expected)


def score_forced(classified: Column, expected: Column, correct: Column) -> Column:
    """1 or 0 for a decided answer, one half for a hedge, null to exclude."""
    c = F.coalesce(classified, F.lit(""))
    return (
        F.when(c.isin("other", ""), F.lit(None).cast("double"))
        .when(c == "disputed", F.lit(0.5))
        .when(correct.isNotNull(), correct.cast("int").cast("double"))
        .otherwise((c == F.coalesce(expected, F.lit(""))).cast("int").cast("double"))
    )


def score_open(label: Column, has_a: Column, has_b: Column, a: str = "a", b: str = "b") -> Column:
    ha, hb = F.coalesce(has_a, F.lit(False)), F.coalesce(has_b, F.lit(False))
    return (
        F.when(label == a, F.lit(1.0))
        .when(label == b, F.lit(0.0))
        .when((label == "disputed") & ha & ~hb, F.lit(0.75))
        .when((label == "disputed") & hb & ~ha, F.lit(0.25))
        .when(label == "disputed", F.lit(0.5))
    )


def salvage_json(text: Column, schema: str) -> Column:
    """Parse the JSON object inside fenced or padded text; null when there is none."""
    body = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(F.nullif(body, F.lit(""))).isNotNull(), F.from_json(body, schema))


def strip_reasoning(content: Column, reasoning: Column) -> Column:
    """Answer without hidden-reasoning blocks; the reasoning when nothing else is left."""
    ws = F.lit(" \n\r\t")
    visible = F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"(?s)<think>.*?</think>\s*", ""), ws)
    return F.coalesce(F.nullif(visible, F.lit("")), F.trim(reasoning, ws), F.lit(""))


def probe_hits(response: Column, markers: Column, regex: bool = False) -> Column:
    """Markers (plain text, or patterns with ``regex``) that occur in the response."""
    t = F.lower(F.coalesce(response, F.lit("")))
    test = F.regexp_like if regex else F.contains
    return F.filter(F.coalesce(markers, F.array().cast("array<string>")), lambda m: test(t, F.lower(m)))


def probe_report(response: Column, urls: Column, markers: Column, anti: Column, phrases: Column, proxies: Sequence[str],
                 regex: bool = False) -> Column:
    """What a contamination probe finds in a response.

    Struct of the claim markers, anti-markers and source phrases found, the
    cited URLs of listed proxy sites, and whether any claim marker was found.
    """
    found = probe_hits(response, markers, regex)
    cited = F.filter(
        F.coalesce(urls, F.array().cast("array<string>")), lambda u: any_contains(F.lower(u), [p.lower() for p in proxies])
    )
    return F.struct(
        found.alias("markers"),
        probe_hits(response, anti, regex).alias("anti_markers"),
        probe_hits(response, phrases, regex).alias("source_phrases"),
        cited.alias("proxy_cited"),
        (F.size(found) > 0).alias("is_hit"),
    )
