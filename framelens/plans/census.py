"""The composed analyses: corpus census, article framing and answer audit.

Each is one lazy plan over its input tables; the only stage boundaries are the
keyed steps and the final aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.functions import answers as an
from framelens.functions import fixed, urls, values
from framelens.lexicon import DomainRule, Lexicon, TextRule
from framelens.operators import aggregates as ag
from framelens.operators import classify as cl
from framelens.operators import filters, joins, sets, windows


def corpus_census(docs: DataFrame, lex: Lexicon, tiers: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Topic filter (when the lexicon has terms), classification and census."""
    relevant = filters.topic_filter(docs, lex.topic_terms) if lex.topic_terms else docs
    return ag.census(cl.classify(relevant, lex), lex.pole_a, lex.pole_b, tiers, by)


def site_categories(classified: DataFrame, directory: DataFrame, lex: Lexicon, sanctions: Sequence[DomainRule],
                    platforms: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Origin, site type and sanction of the pole-B documents.

    ``directory`` has one row per ``domain`` with its ``type``.
    """
    b = classified.where(F.col("label") == lex.pole_b).withColumn("host", urls.host(F.col("url")))
    u, h = F.col("url"), F.col("host")
    known = joins.lookup_host(b, directory, ["type"])
    listed = urls.sanction(u, sanctions)
    return known.select(
        "url",
        urls.origin(h, u).alias("origin"),
        urls.site_type(urls.institution(u), listed, urls.platform_class(u, h, platforms), F.col("type")).alias("site_type"),
        listed.alias("sanction"),
    )


def evidence(docs: DataFrame, text: str = "text", url: str = "url") -> DataFrame:
    """Documents with academic evidence: DOI, academic host, citation count, preview."""
    from framelens.functions.scoring import preview

    return filters.academic_gate(docs, text, url).select(
        url,
        values.find_doi(F.col(text)).alias("doi"),
        urls.academic_domain(F.col(url)).alias("academic_domain"),
        values.citation_count(F.col(text)).alias("citation_count"),
        preview(F.col(text), 500, "byte").alias("text_preview"),
    )


def article_framing(sources: Mapping[str, DataFrame], lex: Lexicon, topic: str, order: Sequence[str], html: str | None = "html") -> DataFrame:
    """Union, first-seen dedup by title and URL, topic gate, labels.

    A source with an ``html`` column gets its text from the page.
    """
    ready = {}
    for name, df in sources.items():
        if html is not None and html in df.columns:
            from framelens.functions.pages import html_to_text

            df = df.withColumn("text", html_to_text(F.col(html))).drop(html)
        ready[name] = df
    every = sets.union_sources(ready)
    first = windows.dedup_first(every, values.dedup_key(F.col("title"), F.col("url")), [F.col(c) for c in order])
    return cl.classify(filters.topic_gate(first, topic), lex, mode="occurrence")


def answer_scores(forced: DataFrame, free: DataFrame | None, tier_of: Mapping[str, str], named: Column, entities: Sequence[TextRule],
                  schemes: Mapping[str, Mapping[str, float]] = fixed.WEIGHT_SCHEMES) -> DataFrame:
    """Answers to composite scores: classes, tier means per cell, schemes and weight-free metrics per model.

    Two shuffles: cells, then models. ``free`` holds open answers with their
    label and flags and becomes tier R.
    """
    tier = urls.literal_map(tier_of)[F.col("question_id")]
    cls = an.classify_answer(F.col("raw_answer"), F.col("language"), named, entities)
    f = forced.withColumn("classified", cls).select(
        "model", "language", tier.alias("tier"),
        an.score_forced(F.col("classified"), F.col("expected"), an.is_correct(F.col("classified"), F.col("expected"))).alias("x"),
    ).where(F.col("tier").isNotNull())
    if free is not None:
        f = f.unionByName(
            free.select("model", "language", F.lit("R").alias("tier"), an.score_open(F.col("label"), F.col("has_a"), F.col("has_b")).alias("x"))
        )
    cells = ag.tier_means(f, ["model", "language"])
    return ag.scheme_scores(cells, "model", schemes).join(ag.robust_scores(cells, "model"), "model", "left")
