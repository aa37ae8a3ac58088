"""Tallies, censuses and summaries.

Every grouping is a partial aggregate before its shuffle, so a key that holds
a large share of the rows costs one row per task. Sets of values per group are
expressed as conditional aggregates, never as collected lists.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.functions import fixed
from framelens.functions.values import percent
from framelens.operators.scale import lookup_join, top_per_key



def n_if(cond: Column) -> Column:
    return F.count_if(cond)


def label_counts(df: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    return df.groupBy(*by, label).agg(F.count("*").alias("n"))


def label_matrix(df: DataFrame, by: Sequence[str], labels: Sequence[str], label: str = "label") -> DataFrame:
    """One row per group, one count column per label."""
    return df.groupBy(*by).agg(*[n_if(F.col(label) == v).alias(f"n_{v}") for v in labels], F.count("*").alias("n"))


CLASSES = ("yes", "no", "disputed")


def tallies(df: DataFrame, target: str, classes: Sequence[str] = CLASSES, question: str = "question_id",
            city: str = "city", lang: str = "language", correct: str = "correct", cls: str = "classified") -> DataFrame:
    """Six simultaneous tallies in one pass over the answers.

    ``tally`` is q, c, l, qc, ql or cl; cl covers the ``target`` question only.
    Blank cities and languages are left out of their tallies.
    """
    low = F.lower(F.coalesce(F.col(cls), F.lit("")))
    base = df.select(
        F.col(question).alias("q"), F.coalesce(F.col(city), F.lit("")).alias("c"),
        F.coalesce(F.col(lang), F.lit("")).alias("l"), F.col(correct).alias("_ok"), low.alias("_cls"),
    )
    q, c, l = F.col("q"), F.col("c"), F.col("l")
    sets = base.groupingSets([[q], [c], [l], [q, c], [q, l], [q, c, l]], q, c, l).agg(
        F.grouping_id().alias("_gid"),
        F.count("*").alias("total"),
        n_if(F.col("_ok")).alias("correct"),
        *[n_if(F.col("_cls") == v).alias(f"n_{v}") for v in classes],
        n_if(~F.col("_cls").isin(*classes)).alias("n_other"),
    )
    # grouping_id has a set bit for every column that is rolled up, q being the highest.
    name = F.create_map(*[F.lit(x) for kv in {3: "q", 5: "c", 6: "l", 1: "qc", 2: "ql", 0: "cl"}.items() for x in kv])
    named = sets.withColumn("tally", name[F.col("_gid").cast("int")])
    keep = (F.col("tally") != "cl") | (q == target)
    return (
        named.where(keep & (F.coalesce(c, F.lit("-")) != "") & (F.coalesce(l, F.lit("-")) != ""))
        .withColumn("q", F.when(F.col("tally") != "cl", q))
        .withColumn("pct", percent(F.col("correct"), F.col("total")))
        .drop("_gid")
    )


def group_contrast(df: DataFrame, groups: DataFrame, by: Sequence[str], high: str, low: str, city: str = "city",
                   correct: str = "correct") -> DataFrame:
    """Accuracy of named entity groups and the gap high − low in points.

    The gap is the difference of the already rounded percentages.
    """
    # Answers are counted by entity first, so the join meets a row for each entity and no answer.
    counted = df.groupBy(*dict.fromkeys([*by, city])).agg(n_if(F.col(correct)).alias("_correct"), F.count(F.lit(1)).alias("_total"))
    named = lookup_join(counted, groups, city, "inner")
    names = [high, low]
    aggs = []
    for g in names:
        for part in ("correct", "total"):
            aggs.append(F.sum(F.when(F.col("grp") == g, F.col(f"_{part}")).otherwise(F.lit(0))).alias(f"{part}_{g}"))
    out = named.groupBy(*by).agg(*aggs)
    for g in names:
        out = out.withColumn(f"pct_{g}", percent(F.col(f"correct_{g}"), F.col(f"total_{g}")))
    return out.withColumn("gap", F.round(F.col(f"pct_{high}") - F.col(f"pct_{low}"), 1))


def accuracy_matrix(df: DataFrame, rows: str, col: str, values: Sequence[str], correct: str = "correct") -> DataFrame:
    """Accuracy per row key and column value; null where there is no answer."""
    aggs = []
    for v in values:
        inside = F.col(col) == v
        aggs.append(
            F.round(F.lit(100.0) * n_if(inside & F.col(correct)) / F.nullif(n_if(inside), F.lit(0)), 1).alias(f"pct_{v}")
        )
    return df.groupBy(rows).agg(*aggs)


def accuracy_long(df: DataFrame, rows: str, col: str, correct: str = "correct") -> DataFrame:
    """Accuracy per row key and column value as rows, for every value that occurs."""
    return df.groupBy(rows, col).agg(F.count("*").alias("n"), F.round(F.lit(100.0) * n_if(F.col(correct)) / F.count("*"), 1).alias("pct"))


SUB_TYPES = ("assertive_pure", "assertive_structured", "reportage_news", "reportage_attribution")


def census(df: DataFrame, pole_a: str, pole_b: str, tiers: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Totals by label, sub-type and source tier in one aggregate; shares are of pole B."""
    b = F.col("label") == pole_b
    aggs = [
        F.count("*").alias("total"),
        n_if(F.col("label") == pole_a).alias("n_a"),
        n_if(b).alias("n_b"),
        n_if(F.col("label") == "disputed").alias("n_disputed"),
        n_if(F.col("label") == "no_signal").alias("n_no_signal"),
        *[n_if(b & (F.col("framing_type") == t)).alias(t) for t in SUB_TYPES],
        *[n_if(b & (F.col("source_type") == t)).alias(f"tier_{t}") for t in tiers],
    ]
    out = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    assertive = F.col("assertive_pure") + F.col("assertive_structured")
    whole = F.nullif(F.col("n_b"), F.lit(0))
    return out.withColumns(
        {
            "assertive_pct": F.round(F.lit(100.0) * assertive / whole, 4),
            "reportage_pct": F.round(F.lit(100.0) * (F.col("n_b") - assertive) / whole, 4),
        }
    )


def crosstab(df: DataFrame, a: str, b: str, top: int | None = None) -> DataFrame:
    """Cell counts with percent of all rows; ``top`` keeps the largest cells."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    # The total adds the cells up: Spark reuses their exchange, so the input is computed once.
    whole = cells.agg(F.sum("n")).scalar()
    out = cells.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / whole, 4))
    return out if top is None else out.orderBy(F.col("n").desc(), a, b).limit(top)


def coverage(df: DataFrame, col: str, none: str = "uncategorized") -> DataFrame:
    """Categorised and uncategorised rows."""
    known = n_if(F.col(col) != none)
    return df.agg(F.count("*").alias("total"), known.alias("categorized")).withColumn(
        "uncategorized", F.col("total") - F.col("categorized")
    )


def group_breakdown(df: DataFrame, year: str, venue: str, stage1: str, groups: str = "groups") -> DataFrame:
    """Documents per group alone and by year, venue and first-stage label, in one pass.

    The outer explode keeps Spark from inferring a "not empty" filter, which
    would evaluate the group patterns a second time.
    """
    opened = df.select(F.explode_outer(groups).alias("grp"), *[
        F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown")).alias(k)
        for c, k in ((year, "year"), (venue, "venue"), (stage1, "stage1"))
    ]).where(F.col("grp").isNotNull())
    g, y, v, s = (F.col(c) for c in ("grp", "year", "venue", "stage1"))
    out = opened.groupingSets([[g], [g, y], [g, v], [g, s]], g, y, v, s).agg(
        F.grouping_id().alias("_gid"), F.count("*").alias("n")
    )
    name = F.create_map(*[F.lit(x) for kv in {7: "all", 3: "year", 5: "venue", 6: "stage1"}.items() for x in kv])
    return out.select(
        name[F.col("_gid").cast("int")].alias("tally"), "grp", F.coalesce("year", "venue", "stage1").alias("value"), "n"
    )


def nested_counts(df: DataFrame, key: str, inner: str) -> DataFrame:
    """Counts of every (key, inner) pair in long form: the whole of what :func:`top_nested` cuts to its largest keys."""
    return df.groupBy(key, inner).agg(F.count("*").alias("n"))


def top_nested(df: DataFrame, key: str, inner: str, n: int) -> DataFrame:
    """The ``n`` keys with most rows, each with a map of its inner counts.

    Keys are ranked by their totals first; only the pairs of the chosen ones are nested. Both read the pairs' one exchange.
    ``inner`` is a label vocabulary: a map has one entry per label.
    """
    pairs = nested_counts(df, key, inner)
    top = pairs.groupBy(F.col(key).alias("_key")).agg(F.sum("n").alias("total")).orderBy(F.col("total").desc(), "_key").limit(n)
    # At most n narrow rows. The null-safe join adds no filter, which would make the two reads of the pairs differ.
    kept = pairs.join(F.broadcast(top), F.col(key).eqNullSafe(F.col("_key")))
    entries = F.array_sort(F.collect_list(F.struct(F.col(inner), F.col("n"))))
    nested = kept.groupBy(key).agg(F.max("total").alias("total"), F.map_from_entries(entries).alias("counts"))
    return nested.orderBy(F.col("total").desc(), key)


def cooccurrence(df: DataFrame, n: int, groups: str = "groups") -> DataFrame:
    """The most frequent sets of groups."""
    keyed = df.groupBy(F.array_join(F.array_sort(groups), "|").alias("groups")).agg(F.count("*").alias("n"))
    return keyed.orderBy(F.col("n").desc(), "groups").limit(n)


def tier_means(df: DataFrame, by: Sequence[str], tiers: Sequence[str] = ("D", "L", "I", "R"), tier: str = "tier",
               score: str = "x") -> DataFrame:
    """Mean score per tier as columns; excluded (null) scores do not count."""
    aggs = [F.avg(F.when(F.col(tier) == t, F.col(score))).alias(t) for t in tiers]
    return df.groupBy(*by).agg(*aggs, F.count(score).alias("n_scored"))


def composite(weights: Mapping[str, float]) -> Column:
    """Weighted mean over the tiers present, weights renormalised; null when they sum to zero."""
    num = sum((F.coalesce(F.col(t) * F.lit(w), F.lit(0.0)) for t, w in weights.items()), F.lit(0.0))
    den = sum((F.when(F.col(t).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for t, w in weights.items()), F.lit(0.0))
    return num / F.nullif(den, F.lit(0.0))


def composite_min(tiers: Sequence[str]) -> Column:
    return F.least(*[F.col(t) for t in tiers])


def composite_harmonic(tiers: Sequence[str]) -> Column:
    """Harmonic mean of the positive tiers; null with fewer than two."""
    pos = [F.when(F.col(t) > 1e-9, F.col(t)) for t in tiers]
    n = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in pos), F.lit(0))
    inv = sum((F.coalesce(F.lit(1.0) / p, F.lit(0.0)) for p in pos), F.lit(0.0))
    return F.when(n >= 2, n / inv)


def scheme_scores(cells: DataFrame, subject: str, schemes: Mapping[str, Mapping[str, float]] = fixed.WEIGHT_SCHEMES,
                  digits: int = 4) -> DataFrame:
    """Per subject the mean over its cells of every scheme; cells are rounded before they are averaged."""
    per_cell = cells.select(subject, *[F.round(composite(w), digits).alias(s) for s, w in schemes.items()])
    return per_cell.groupBy(subject).agg(
        *[_exact_mean(s, digits).alias(s) for s in schemes], F.count(next(iter(schemes))).alias("n_languages")
    )


def _exact_mean(value: str, digits: int) -> Column:
    """Rounded mean that does not hang on the order of its rows: a sum of doubles does, and a tie then falls to either side."""
    return F.round(F.avg(F.col(value).cast("decimal(25,15)")), digits).cast("double")


def robust_scores(cells: DataFrame, subject: str, tiers: Sequence[str] = ("D", "L", "I", "R"), digits: int = 4) -> DataFrame:
    """Per subject the mean over its cells of the weight-free composites."""
    per_cell = cells.select(
        subject, composite_min(tiers).alias("min"), composite_harmonic(tiers).alias("harmonic_mean")
    )
    return per_cell.groupBy(subject).agg(
        _exact_mean("min", digits).alias("min"), _exact_mean("harmonic_mean", digits).alias("harmonic_mean")
    )


def elicitation_gap(means: DataFrame, forced: str = "D", free: str = "R", digits: int = 4) -> DataFrame:
    """Difference of the rounded tier means; null when one is missing."""
    return means.withColumn("gap", F.round(F.round(F.col(forced), digits) - F.round(F.col(free), digits), digits))


def top_counts(df: DataFrame, col: str, n: int | None = None, blank: str | None = None) -> DataFrame:
    """Most common values; blanks are dropped or counted under the name ``blank``."""
    value = F.nullif(F.col(col), F.lit(""))
    named = df.select((F.coalesce(value, F.lit(blank)) if blank else value).alias(col)).where(F.col(col).isNotNull())
    out = named.groupBy(col).agg(F.count("*").alias("n"))
    return out if n is None else out.orderBy(F.col("n").desc(), col).limit(n)


def journal_report(df: DataFrame, verdicts: Sequence[str], tropes: Sequence[str], journal: str = "journal",
                   quartile: str = "quartile", verdict: str = "verdict") -> DataFrame:
    """Per journal its papers, verdicts and trope flags (columns named after the tropes)."""
    name = F.coalesce(F.nullif(F.col(journal), F.lit("")), F.lit("(unknown journal)"))
    return df.groupBy(name.alias("journal")).agg(
        F.max(F.coalesce(F.col(quartile), F.lit("unknown"))).alias("quartile"),
        F.count("*").alias("papers"),
        *[n_if(F.col(verdict) == v).alias(f"n_{v}") for v in verdicts],
        *[n_if(F.col(t)).alias(f"trope_{t}") for t in tropes],
    )


def person_facts(claims: DataFrame, a: str, b: str, old: Sequence[str] | Mapping[str, Sequence[str]], cut: str, person: str = "person") -> DataFrame:
    """One row per person from its dated claims, with flags instead of a collected list.

    ``old`` lists the codes of a former state, or maps names of several to theirs; each has a flag ``has_<name>``.
    """
    code = F.col("country")
    former = old if isinstance(old, Mapping) else {"old": old}
    return claims.groupBy(person).agg(
        F.max("death").alias("death"),
        F.coalesce(F.bool_or(code == a), F.lit(False)).alias("has_a"),
        F.coalesce(F.bool_or(code == b), F.lit(False)).alias("has_b"),
        *[F.coalesce(F.bool_or(code.isin(*codes)), F.lit(False)).alias(f"has_{name}") for name, codes in former.items()],
        F.count(code).alias("n_claims"),
        F.coalesce(F.bool_or((code == b) & (F.col("start") >= F.lit(cut).cast("date"))), F.lit(False)).alias("b_started"),
        F.coalesce(F.bool_or((code == a) & (F.col("end") >= F.lit(cut).cast("date"))), F.lit(False)).alias("a_ended"),
    )


def cohort_summary(people: DataFrame, cutoffs: Sequence[str], old: Sequence[str] = ("old",)) -> DataFrame:
    """Per death cohort the citizenship classes and transition flags.

    ``people`` comes from :func:`person_facts`; cohorts are before the first
    cut-off, between the two, after, and alive or unknown. ``old`` names the
    former states in the order in which they decide: one class for each.
    """
    first, second = (F.lit(c).cast("date") for c in cutoffs)
    cohort = (
        F.when(F.col("death").isNull(), "alive_or_unknown")
        .when(F.col("death") < first, "died_before")
        .when(F.col("death") < second, "died_between")
        .otherwise("died_after")
    )
    cls = (
        F.when(F.col("has_a") & F.col("has_b"), "both")
        .when(F.col("has_a"), "a_only")
        .when(F.col("has_b"), "b_only")
    )
    for name in old:
        cls = cls.when(F.col(f"has_{name}"), f"{name}_only")
    cls = cls.when(F.col("n_claims") == 0, "missing").otherwise("other")
    return (
        people.withColumn("cohort", cohort)
        .withColumn("cls", cls)
        .groupBy("cohort")
        .agg(
            F.count("*").alias("n"),
            *[n_if(F.col("cls") == c).alias(c) for c in ("a_only", "b_only", "both", *[f"{name}_only" for name in old], "missing", "other")],
            n_if(F.col("b_started")).alias("b_started"),
            n_if(F.col("a_ended")).alias("a_ended"),
            n_if(F.col("a_ended") & ~F.col("b_started")).alias("invisible_transition"),
        )
    )


def claim_coverage(entities: DataFrame, claims: DataFrame, key: str, a: str, b: str, value: str = "country") -> DataFrame:
    """Claims naming A, B or another value, and entities without any claim."""
    per = claims.groupBy(key).agg(
        n_if(F.col(value) == a).alias("_a"), n_if(F.col(value) == b).alias("_b"), F.count(value).alias("_n")
    )
    joined = lookup_join(entities.select(key), per, key)
    some = F.coalesce("_n", F.lit(0))
    return joined.agg(
        F.coalesce(F.sum("_a"), F.lit(0)).alias("claims_a"),
        F.coalesce(F.sum("_b"), F.lit(0)).alias("claims_b"),
        F.coalesce(F.sum(some - F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))), F.lit(0)).alias("claims_other"),
        n_if(F.col("_a") > 0).alias("entities_a"),
        n_if(F.col("_b") > 0).alias("entities_b"),
        n_if(some == 0).alias("entities_none"),
    )


def finding_summary(df: DataFrame) -> DataFrame:
    """Findings by status, by category and status, and by method, in one pass."""
    s, c, m = F.col("status"), F.col("category"), F.col("method")
    out = df.groupingSets([[s], [c, s], [m], []], s, c, m).agg(F.grouping_id().alias("_gid"), F.count("*").alias("n"))
    name = F.create_map(
        *[F.lit(x) for kv in {3: "status", 1: "category_status", 6: "method", 7: "total"}.items() for x in kv]
    )
    return out.select(name[F.col("_gid").cast("int")].alias("tally"), "category", "status", "method", "n")


def consensus(df: DataFrame, key: str | Sequence[str], cls: str, a: str, b: str) -> DataFrame:
    """Majority code per group; ``tied`` on equal counts, ``no_data`` without A and B."""
    out = df.groupBy(*([key] if isinstance(key, str) else key)).agg(
        n_if(F.col(cls) == a).alias("n_a"), n_if(F.col(cls) == b).alias("n_b"), F.count("*").alias("total")
    )
    return out.withColumn(
        "consensus",
        F.when((F.col("n_a") == 0) & (F.col("n_b") == 0), F.lit("no_data"))
        .when(F.col("n_a") > F.col("n_b"), F.lit(a))
        .when(F.col("n_b") > F.col("n_a"), F.lit(b))
        .otherwise(F.lit("tied")),
    )


def registry_summary(df: DataFrame, a: str, b: str, cut: str) -> DataFrame:
    """Indicator counts of a registry: country, creation date, abuse TLD, reassigned holders."""
    country = F.nullif(F.col("country"), F.lit(""))
    return df.agg(
        F.count("*").alias("total"),
        n_if(country == a).alias("country_a"),
        n_if(country == b).alias("country_b"),
        n_if(country.isNotNull() & ~country.isin(a, b)).alias("country_other"),
        n_if(F.col("created") >= F.lit(cut)).alias("created_after"),
        n_if(F.col("abuse_tld") == b.lower()).alias("abuse_b"),
        n_if(F.col("same_holder") == F.lit(False)).alias("reassigned"),
    )


def trailing_counts(events: DataFrame, key: str, ts: str, days: int, keys: Sequence[str] | None = None) -> DataFrame:
    """Events per key in the trailing window that ends at the latest event."""
    latest = events.agg(F.max(ts).alias("t")).scalar()
    recent = events.where(F.col(ts) >= latest - F.expr(f"INTERVAL {int(days)} DAYS"))
    if keys is not None:
        recent = recent.where(F.col(key).isin(*keys))
    return recent.groupBy(key).agg(F.count("*").alias("n"))


def citation_rates(df: DataFrame, by: Sequence[str], flagged: str = "n_flagged") -> DataFrame:
    """Responses with at least one flagged citation, by group."""
    return df.groupBy(*by).agg(
        F.count("*").alias("responses"), n_if(F.col(flagged) > 0).alias("with_flagged")
    ).withColumn("pct", percent(F.col("with_flagged"), F.col("responses")))


def consistency(df: DataFrame, key: str, place: str, cls: str) -> DataFrame:
    """Does a page show the same class from every place.

    Distinct places and classes come from one distinct count each; an
    ``unclear`` class vetoes ``varying``.
    """
    out = df.groupBy(key).agg(
        F.count_distinct(place).alias("places"),
        F.count_distinct(cls).alias("classes"),
        F.coalesce(F.bool_or(F.col(cls) == "unclear"), F.lit(False)).alias("_unclear"),
    )
    verdict = (
        F.when(F.col("places") < 2, F.lit("insufficient"))
        .when((F.col("classes") > 1) & ~F.col("_unclear"), F.lit("varying"))
        .when(F.col("classes") == 1, F.lit("consistent"))
        .otherwise(F.lit("unclear"))
    )
    return out.withColumn("verdict", verdict).drop("_unclear")


def rate_compare(a: DataFrame, b: DataFrame, hit: str, any_hit: str, cut: Column) -> DataFrame:
    """:func:`rate_split` of two corpora that lie in two tables."""
    part = lambda df, side: df.select(F.col(hit).alias("hit"), F.col(any_hit).alias("any"), cut.alias("cut"), F.lit(side).alias("side"))
    return rate_split(part(a, True).unionByName(part(b, False)), F.col("side"), "hit", "any", F.col("cut"))


def rate_split(df: DataFrame, first: Column, hit: str, any_hit: str, cut: Column) -> DataFrame:
    """Rates of the rows with ``first`` and of the others per 10,000, share among documents with any group, ratio, before/after counts.

    One conditional aggregate over one pass.
    """
    aggs = []
    for t, side in (("x", F.coalesce(first, F.lit(False))), ("y", ~F.coalesce(first, F.lit(False)))):
        aggs += [n_if(side).alias(f"docs_{t}"), n_if(side & F.col(hit)).alias(f"hits_{t}"), n_if(side & F.col(any_hit)).alias(f"any_{t}"),
                 n_if(side & F.col(hit) & cut).alias(f"before_{t}")]
    both = df.agg(*aggs)
    for t in ("x", "y"):
        docs, hits, some = F.col(f"docs_{t}"), F.col(f"hits_{t}"), F.col(f"any_{t}")
        both = both.withColumns(
            {
                f"per_10k_{t}": F.round(F.lit(1e4) * hits / F.nullif(docs, F.lit(0)), 2),
                f"share_{t}": F.round(F.lit(100.0) * hits / F.nullif(some, F.lit(0)), 1),
                f"after_{t}": hits - F.col(f"before_{t}"),
            }
        )
    return both.withColumn("ratio", F.round(F.col("per_10k_x") / F.nullif(F.col("per_10k_y"), F.lit(0.0)), 1))


def theme_summary(df: DataFrame, source: str, year: str, groups: str = "groups") -> DataFrame:
    """Themed sub-corpus by source, year and (overlapping) theme type, in long form, with shares of all documents.

    Every document also counts once under no tally, so that the total comes from the same pass.
    """
    def entry(tally: str | None, value: Column) -> Column:
        return F.struct(F.lit(tally).cast("string").alias("tally"), value.cast("string").alias("value"))

    whole, themed = entry(None, F.lit(None)), F.concat(
        F.array(entry("all", F.lit("all")), entry("source", F.col(source)), entry("year", F.col(year))),
        F.transform(groups, lambda g: entry("theme", g)))
    entries = F.concat(F.array(whole), F.when(F.size(groups) > 0, themed).otherwise(F.array().cast("array<struct<tally:string,value:string>>")))
    flat = df.select(F.explode_outer(entries).alias("t"))
    counted = flat.groupBy(F.col("t.tally").alias("tally"), F.col("t.value").alias("value")).agg(
        F.count("*").alias("n"), F.max(F.col("t.tally").isNull()).alias("_whole"))
    # Filters on aggregates are not pushed below them, so both reads of the counts share their exchange.
    docs = counted.agg(F.max(F.when(F.col("_whole"), F.col("n")))).scalar()
    shares = counted.withColumn("share_pct", F.round(F.lit(100.0) * F.col("n") / docs, 1))
    return shares.where(~F.col("_whole")).drop("_whole")


def birthplace_labels(df: DataFrame, remarks: str, rules: Sequence[tuple[str, str]], default: str = "Other") -> DataFrame:
    """Counts of labelled places of birth found in free-text remarks."""
    pob = F.trim(F.regexp_extract(F.coalesce(F.col(remarks), F.lit("")), r"POB\s+(.*?)(?:;|$)", 1))
    low = F.lower(pob)
    lab = None
    for word, name in rules:
        lab = F.when(F.contains(low, F.lit(word)), F.lit(name)) if lab is None else lab.when(F.contains(low, F.lit(word)), F.lit(name))
    return (
        df.withColumn("pob", pob).where(F.col("pob") != "").groupBy(lab.otherwise(F.lit(default)).alias("pob_label"))
        .agg(F.count("*").alias("n"))
    )


def series_summary(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """Mean, peak and time of the peak (the first one on ties)."""
    return df.groupBy(key).agg(
        F.avg(value).alias("mean"), F.max(value).alias("peak"),
        F.min_by(t, F.struct(-F.col(value), F.col(t))).alias("peak_at"),
    )


def verification_summary(df: DataFrame, verdict: str = "verdict", by: Sequence[str] = ()) -> DataFrame:
    """Verdict counts and precision = endorses / verified."""
    v = F.col(verdict)
    aggs = [
        n_if(v == "endorses").alias("endorses"), n_if(v.isin("reports", "analyzes")).alias("reports"),
        n_if(v == "unclear").alias("unclear"), n_if(v == "fetch_failed").alias("fetch_failed"),
        n_if(v == "error").alias("errors"),
    ]
    out = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return out.withColumn("verified", F.col("endorses") + F.col("reports") + F.col("unclear")).withColumn(
        "precision_pct", percent(F.col("endorses"), F.col("verified"))
    )


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct trimmed values without blanks."""
    return df.select(F.trim(F.col(col)).alias(col)).where(F.coalesce(F.col(col), F.lit("")) != "").distinct()


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows that survive each stage (every stage implies those before), in one pass."""
    aggs, cond = [F.count("*").alias("collected")], F.lit(True)
    for name, c in stages:
        cond = cond & F.coalesce(c, F.lit(False))
        aggs.append(n_if(cond).alias(name))
    return df.agg(*aggs)


def funnel_of_firsts(df: DataFrame, key: str, order: Sequence[str], stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """:func:`funnel` whose first stage, ``deduped``, keeps the first row of each key, in one pass.

    A key's first row is a partial aggregate of the stages' conditions, so copies neither travel nor meet.
    """
    marks = F.struct(*[F.coalesce(c, F.lit(False)).alias(name) for name, c in stages])
    firsts = df.groupBy(key).agg(F.count("*").alias("_n"), F.min_by(marks, F.struct(*order)).alias("_s"))
    aggs, cond = [F.coalesce(F.sum("_n"), F.lit(0)).alias("collected"), F.count("*").alias("deduped")], F.lit(True)
    for name, _ in stages:
        cond = cond & F.col(f"_s.{name}")
        aggs.append(n_if(cond).alias(name))
    return firsts.agg(*aggs)


def summary_long(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Counts of every value of each dimension as rows (dim, k, n), with the total under ``(total)``, in one pass."""
    base = df.select(*[F.coalesce(F.col(d).cast("string"), F.lit("(none)")).alias(d) for d in dims])
    cols = [F.col(d) for d in dims]
    sets = base.groupingSets([*[[c] for c in cols], []], *cols).agg(F.grouping_id().alias("_gid"), F.count("*").alias("n"))
    full = (1 << len(dims)) - 1
    names = {full ^ (1 << (len(dims) - 1 - i)): d for i, d in enumerate(dims)} | {full: "(total)"}
    dim = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("_gid").cast("int")]
    return sets.select(dim.alias("dim"), F.coalesce(*cols, F.lit("")).alias("k"), "n")


def summary_row(df: DataFrame, dims: Sequence[str], top: int = 1_000) -> DataFrame:
    """One row with the total and a nested map of counts per dimension, in one pass.

    Maps hold the ``top`` most frequent values of each dimension, ranked before anything is nested; further ones add up under
    ``(other)``. One row cannot hold an unbounded dimension: :func:`summary_long` has every value.
    """
    kept = top_per_key(summary_long(df, dims), ["dim"], [F.col("n").desc(), F.col("k")], top)
    aggs = [F.coalesce(F.max(F.when(F.col("dim") == "(total)", F.col("n"))), F.lit(0)).alias("total")]
    for i, d in enumerate(dims):
        own = F.col("dim") == d
        aggs.append(F.array_sort(F.collect_list(F.when(own, F.struct("k", "n")))).alias(f"_e{i}"))
        aggs.append(F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias(f"_s{i}"))
    out = kept.agg(*aggs)
    maps = []
    for i, d in enumerate(dims):
        rest = F.col("total") - F.col(f"_s{i}")
        other = F.array(F.struct(F.lit("(other)").alias("k"), rest.alias("n")))
        maps.append(F.map_from_entries(F.when(rest > 0, F.concat(f"_e{i}", other)).otherwise(F.col(f"_e{i}"))).alias(d))
    return out.select("total", *maps)
