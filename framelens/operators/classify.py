"""Classification of whole document tables.

The lower-cased text is one projection below the score, so it is computed once
per document; everything is a narrow stage without a shuffle or a Python worker.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.functions import scoring, urls
from framelens.functions.matching import any_contains
from framelens.lexicon import GroupPattern, Lexicon
from framelens.operators.scale import compute_once


def with_scores(df: DataFrame, lex: Lexicon, text: str = "text", mode: str = "presence", partitions: int | None = None) -> DataFrame:
    """Add ``score_a`` and ``score_b``.

    ``presence`` counts every signal once, ``occurrence`` every match. A file of one row group is scored by one task;
    ``partitions`` deals its rows to so many first. Files of several row groups need none.
    """
    df = df if partitions is None else df.repartition(partitions)
    if mode not in ("presence", "occurrence"):
        raise ValueError(f"unknown mode {mode!r}")
    scorer = scoring.presence_score if mode == "presence" else scoring.occurrence_score
    low = df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    c = F.col("_low")
    return compute_once(
        low, {"score_a": scorer(c, lex.of_pole(lex.pole_a)), "score_b": scorer(c, lex.of_pole(lex.pole_b))}
    ).drop("_low")


def apply_overrides(df: DataFrame, lex: Lexicon, text: str = "text") -> DataFrame:
    """Move the override weight from pole B to pole A; pole B is floored at zero."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    shifted = df.withColumn("_shift", scoring.override_shift(low, lex.overrides))
    return shifted.withColumns(
        {
            "score_a": F.col("score_a") + F.col("_shift"),
            "score_b": F.greatest(F.lit(0.0), F.col("score_b") - F.col("_shift")),
        }
    ).drop("_shift")


def classify(df: DataFrame, lex: Lexicon, text: str = "text", url: str | None = "url", mode: str = "presence",
             preview_chars: int = 300, match: str = "boundary", keep_text: bool = False, partitions: int | None = None) -> DataFrame:
    """Score, override, label, sub-type, source tier and preview of every document.

    The text column is dropped unless ``keep_text``: it dominates the width of
    the rows and nothing after the label needs it. ``partitions``: see :func:`with_scores`.
    """
    df = df if partitions is None else df.repartition(partitions)
    base = df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    low = F.col("_low")
    scorer = scoring.presence_score if mode == "presence" else scoring.occurrence_score
    shift = scoring.override_shift(low, lex.overrides)
    link = F.coalesce(F.col(url), F.lit("")) if url else F.lit("")
    scored = compute_once(
        base, {"_a": scorer(low, lex.of_pole(lex.pole_a)), "_b": scorer(low, lex.of_pole(lex.pole_b)), "_shift": shift}
    ).withColumns(
        {
            "score_a": F.col("_a") + F.col("_shift"),
            "score_b": F.greatest(F.lit(0.0), F.col("_b") - F.col("_shift")),
        }
    )
    labelled = scored.withColumns(
        {
            "label": scoring.label(F.col("score_a"), F.col("score_b"), lex),
            "confidence": scoring.confidence(F.col("score_a"), F.col("score_b")),
            "source_type": urls.source_tier(link, lex.tiers, match, lex.default_tier),
        }
    )
    is_b = F.col("label") == lex.pole_b
    # The marker patterns run on pole-B documents only: CASE evaluates lazily.
    typed = labelled.withColumns(
        {
            "_news": F.when(is_b, urls.is_news(link, lex.news_domains)).otherwise(F.lit(False)),
            "_attr": F.when(is_b, scoring.is_attributed(low, lex)).otherwise(F.lit(False)),
            "_struct": F.when(is_b, scoring.is_structured(low, lex)).otherwise(F.lit(False)),
        }
    ).withColumns(
        {
            "is_quoted": F.col("_attr") | F.col("_news"),
            "framing_type": F.when(
                is_b, scoring.framing_type(F.col("_news"), F.col("_attr"), F.col("_struct"))
            ).otherwise(F.lit("")),
            "text_preview": F.when(is_b, scoring.preview(F.col(text), preview_chars)),
        }
    )
    drop = ["_low", "_a", "_b", "_shift", "_news", "_attr", "_struct"] + ([] if keep_text else [text])
    return typed.drop(*drop)


def gated_label(df: DataFrame, lex: Lexicon, topic: Column, text: str = "text", mode: str = "occurrence") -> DataFrame:
    """Label with the topic gate: documents that miss the topic get ``no_topic_ref`` and zero scores."""
    scored = with_scores(df.withColumn("_gate", topic), lex, text, mode)
    return scored.withColumns(
        {
            "score_a": F.when(F.col("_gate"), F.col("score_a")).otherwise(F.lit(0.0)),
            "score_b": F.when(F.col("_gate"), F.col("score_b")).otherwise(F.lit(0.0)),
        }
    ).withColumn(
        "label",
        F.when(F.col("_gate"), scoring.label(F.col("score_a"), F.col("score_b"), lex)).otherwise(
            F.lit(scoring.NO_TOPIC)
        ),
    ).drop("_gate")


def detect_groups(df: DataFrame, patterns: Sequence[GroupPattern], text: str = "text") -> DataFrame:
    """Keep documents that hit at least one group; add ``groups`` (sorted names) and ``hits`` (map of counts).

    Groups are named by presence, which stops at the first pattern that
    occurs; the counts are only computed when ``hits`` is used.
    """
    low = df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    c = F.col("_low")
    return (
        compute_once(low, {"groups": scoring.groups_present(c, patterns)})
        .where(F.size("groups") > 0)
        .withColumn("hits", scoring.group_hits(c, patterns))
        .drop("_low")
    )


def contradictions(df: DataFrame, a_fields: Sequence[str], b_fields: Sequence[str], a_words: Sequence[str],
                   b_words: Sequence[str], a_exact: Sequence[str] = (), b_exact: Sequence[str] = ()) -> DataFrame:
    """Count record fields that speak for each pole; contradictions are the smaller count."""

    def count(fields, words, exact):
        return sum(
            (F.when(scoring.field_side(F.col(f), words, exact), 1).otherwise(0) for f in fields), F.lit(0)
        )

    return df.withColumns(
        {"n_a": count(a_fields, a_words, a_exact), "n_b": count(b_fields, b_words, b_exact)}
    ).withColumn("contradictions", F.least("n_a", "n_b"))


def topic_condition(text: Column, terms: Sequence[str]) -> Column:
    return any_contains(F.lower(F.coalesce(text, F.lit(""))), terms)
