"""Row filters and record normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.functions import fixed, urls
from framelens.functions.matching import any_contains, any_true
from framelens.functions.values import rebuild_text
from framelens.operators.scale import lookup_join
from framelens.operators.sets import union_dedup


def topic_filter(df: DataFrame, terms: Sequence[str], col: str = "text", whole_words: bool = False) -> DataFrame:
    """Documents that mention any term (bare substrings unless ``whole_words``)."""
    low = F.lower(F.coalesce(F.col(col), F.lit("")))
    if not whole_words:
        return df.where(any_contains(low, terms))
    edge = r"(?:^|[^\p{L}\p{N}_])(?:%s)(?:$|[^\p{L}\p{N}_])"
    return df.where(F.regexp_like(low, F.lit(edge % "|".join(terms))))


def topic_gate(df: DataFrame, pattern: str, col: str = "text") -> DataFrame:
    """Documents whose lower-cased text matches the topic pattern."""
    return df.where(F.regexp_like(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit(pattern)))


def has_evidence(text: Column, url: Column, doi: str = fixed.DOI_PATTERN,
                 citations: Sequence[str] = fixed.CITATION_PATTERNS) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (
        F.regexp_like(t, F.lit(doi))
        | urls.academic_domain(url).isNotNull()
        | any_true(F.regexp_like(t, F.lit(p)) for p in citations)
    )


def academic_gate(df: DataFrame, text: str = "text", url: str = "url") -> DataFrame:
    """Documents with a DOI, an academic host or a citation format."""
    return df.where(has_evidence(F.col(text), F.col(url)))


def with_signal(df: DataFrame, label: str = "label", none: Sequence[str] = ("no_signal", "no_topic_ref")) -> DataFrame:
    return df.where(~F.col(label).isin(*none))


def between_years(df: DataFrame, year: str, first: int, last: int, keep_missing: bool = True) -> DataFrame:
    """Rows of a year range; a missing or zero year passes unless ``keep_missing`` is off."""
    y = F.col(year)
    inside = y.between(first, last)
    return df.where(inside | (F.coalesce(y, F.lit(0)) == 0)) if keep_missing else df.where(inside)


def row_contains(df: DataFrame, keywords: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """Rows in which any column contains any keyword."""
    joined = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in (cols or df.columns)]))
    return df.where(any_contains(joined, keywords))


def tier_filter(df: DataFrame, tier_table: DataFrame, key: str, tiers: Sequence[str], limit: int | None = None,
                order: Sequence[str] = ()) -> DataFrame:
    """Rows whose joined tier (default ``unknown``) is wanted; ``limit`` keeps the first rows in ``order``."""
    kept = lookup_join(df.withColumn(key, F.trim(F.coalesce(F.col(key), F.lit("")))), tier_table, key).withColumn(
        "quartile", F.coalesce("quartile", F.lit("unknown"))
    ).where(F.col("quartile").isin(*tiers))
    return kept if limit is None else kept.orderBy(*order).limit(limit)


def current_claims(df: DataFrame, claims: str = "claims") -> DataFrame:
    """Keep claims that are not deprecated and have no end date.

    Claims are an array of structs with ``rank`` and ``end``; preferred ones
    displace the others when there are any.
    """
    live = F.filter(
        F.col(claims), lambda c: (c["rank"] != "deprecated") & (F.coalesce(c["end"], F.lit("")) == "")
    )
    out = df.withColumn("_live", live)
    preferred = F.filter(F.col("_live"), lambda c: c["rank"] == "preferred")
    return out.withColumn(claims, F.when(F.size(preferred) > 0, preferred).otherwise(F.col("_live"))).drop("_live")


def current_claim_rows(df: DataFrame, entity: str) -> DataFrame:
    """:func:`current_claims` for one claim per row (``rank``, ``end``).

    Whether an entity has a preferred claim is one aggregated flag per entity,
    so a frequent entity is never gathered in one place.
    """
    live = df.where((F.col("rank") != "deprecated") & (F.coalesce(F.col("end").cast("string"), F.lit("")) == ""))
    flags = live.where(F.col("rank") == "preferred").select(entity).distinct().withColumn("_preferred", F.lit(True))
    marked = lookup_join(live, flags, entity)
    return marked.where(F.col("_preferred").isNull() | (F.col("rank") == "preferred")).drop("_preferred")


def works_a_columns(cap: int = 500) -> list[Column]:
    """Unified columns of a work with an inverted-index abstract."""
    doi = F.coalesce("doi", F.lit(""))
    return [
        F.coalesce("title", F.lit("")).alias("title"),
        F.when(doi != "", doi).otherwise(F.coalesce("id", F.lit(""))).alias("url"),
        doi.alias("doi"),
        F.coalesce("publication_year", F.lit(0)).alias("year"),
        F.coalesce(F.col("primary_location.source.display_name"), F.lit("")).alias("journal"),
        F.left(rebuild_text(F.col("abstract_inverted_index")), F.lit(cap)).alias("abstract"),
        F.lit("index").alias("source_api"),
    ]


def works_b_columns(cap: int = 500) -> list[Column]:
    """Unified columns of a work with array-valued titles and date parts."""
    doi = F.coalesce("DOI", F.lit(""))
    return [
        F.coalesce(F.get(F.col("title"), F.lit(0)), F.lit("")).alias("title"),
        F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise(F.coalesce("URL", F.lit(""))).alias("url"),
        doi.alias("doi"),
        F.coalesce(F.get(F.get(F.col("published.date-parts"), F.lit(0)), F.lit(0)), F.lit(0)).alias("year"),
        F.coalesce(F.get(F.col("container-title"), F.lit(0)), F.lit("")).alias("journal"),
        F.left(F.coalesce("abstract", F.lit("")), F.lit(cap)).alias("abstract"),
        F.lit("registry").alias("source_api"),
    ]


def normalize_works(df: DataFrame, source: str, cap: int = 500) -> DataFrame:
    """Works of API ``a`` or ``b`` in the unified schema."""
    return df.select(*(works_a_columns(cap) if source == "a" else works_b_columns(cap)))


def foreign_violators(df: DataFrame, pole_b: str, home: str, label: str = "label", country: str = "country",
                      keep_unknown: bool = False) -> DataFrame:
    """Pole-B documents from outside the home country; unknown countries on request."""
    c = F.coalesce(F.col(country), F.lit(""))
    outside = (c != home) if keep_unknown else ~c.isin(home, "")
    return df.where((F.col(label) == pole_b) & outside)


def search_places(results: Sequence[DataFrame], places: Sequence[str], ident: str = "id", name: str = "name", city: str = "city",
                  order: Sequence[str] = ()) -> DataFrame:
    """Results of several searches: the first row of each identifier, then :func:`place_filter`.

    Searches come in their order; ``order`` decides between equal identifiers of one search. Rows without an identifier go.
    """
    return place_filter(union_dedup(results, ident, order), places, name, city).drop("branch")


def place_filter(df: DataFrame, places: Sequence[str], name: str = "name", city: str = "city") -> DataFrame:
    """Registry rows whose name or city contains a listed place."""
    wanted = [p.lower() for p in places]
    n, c = F.lower(F.coalesce(F.col(name), F.lit(""))), F.lower(F.coalesce(F.col(city), F.lit("")))
    return df.where(any_contains(n, wanted) | any_contains(c, wanted))
