"""Enrichment joins.

Dictionaries go through :func:`framelens.operators.scale.lookup_join`, which
broadcasts what its plan says is small and salts hot keys otherwise. Nothing
runs while a plan is built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.functions import urls, values
from framelens.operators.scale import lookup_join, top_per_key


def lookup_host(df: DataFrame, directory: DataFrame, value_cols: Sequence[str], host: str = "host") -> DataFrame:
    """Directory entry of the host, else of its parent domain.

    ``directory`` has one row per ``domain``. Only hosts without an entry of
    their own take the value of the parent.
    """
    entry = F.struct(*value_cols)
    d = directory.select(F.col("domain"), entry.alias("_entry"))
    with_parent = df.withColumn("_parent", urls.parent(F.col(host)))
    exact = lookup_join(with_parent, d.select(F.col("domain").alias(host), F.col("_entry").alias("_e1")), host)
    near = lookup_join(exact, d.select(F.col("domain").alias("_parent"), F.col("_entry").alias("_e2")), "_parent")
    picked = near.withColumn("_entry", F.coalesce("_e1", "_e2"))
    return picked.select(*df.columns, *[F.col(f"_entry.{c}").alias(c) for c in value_cols])


def lookup_index(df: DataFrame, index: DataFrame, whitelist: Sequence[str], url: str = "url",
                 fields: Sequence[str] | None = None) -> DataFrame:
    """Index entry of a cited URL with a whitelist veto at each level.

    ``index`` has ``domain`` and ``entries`` (array of structs, such as of
    ``entity_name``, ``datasets`` and ``country``); the first entry counts and
    gives all its fields, or the named ones. Host veto, host hit, parent veto,
    parent hit, in this order.
    """
    fields = fields or index.schema["entries"].dataType.elementType.names
    entry = F.get(F.col("entries"), F.lit(0))
    idx = index.select("domain", F.struct(*[entry[f].alias(f) for f in fields]).alias("_entry"))
    base = df.withColumn("_h", urls.netloc(F.col(url))).withColumn("_p", urls.parent(F.col("_h")))
    hit = lookup_join(base, idx.select(F.col("domain").alias("_h"), F.col("_entry").alias("_n1")), "_h")
    hit = lookup_join(hit, idx.select(F.col("domain").alias("_p"), F.col("_entry").alias("_n2")), "_p")
    ok_h, ok_p = ~F.col("_h").isin(*whitelist), ~F.col("_p").isin(*whitelist)
    by_host = ok_h & F.col("_n1").isNotNull()
    by_parent = ok_h & ok_p & F.col("_n2").isNotNull()
    return hit.withColumns(
        {
            "hit_domain": F.when(by_host, F.col("_h")).when(by_parent, F.col("_p")),
            "_hit": F.when(by_host, F.col("_n1")).when(by_parent, F.col("_n2")),
        }
    ).select(*df.columns, "hit_domain", *[F.col(f"_hit.{f}").alias(f) for f in fields])


def merge_labels(df: DataFrame, labels: DataFrame, order: Sequence[str], key: str = "url",
                 drop_unmatched: bool = False) -> DataFrame:
    """Attach classifier output; the last row per key counts, rows without one get ``no_signal``."""
    last = top_per_key(labels, [key], [F.col(c).desc() for c in order]).drop(*order)
    out = lookup_join(df, last, key).withColumn("label", F.coalesce("label", F.lit("no_signal")))
    return out.where(F.col("label") != "no_signal") if drop_unmatched else out


def attach_last(df: DataFrame, big: DataFrame, key: str, cols: Sequence[str], order: Sequence[str],
                defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Per key the last non-empty value of each column of ``big``, joined to ``df``."""
    pos = F.struct(*order)
    aggs = [F.max_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", pos)).alias(c) for c in cols]
    latest = big.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(*aggs)
    out = lookup_join(df, latest, key)
    for c, v in (defaults or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def attach_tier(df: DataFrame, tiers: DataFrame, key: str = "journal", default: str = "unknown") -> DataFrame:
    """Tier of the trimmed name; names without one get the default."""
    trimmed = df.withColumn(key, F.trim(F.coalesce(F.col(key), F.lit(""))))
    out = lookup_join(trimmed, tiers, key)
    for c in tiers.columns:
        if c != key:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(default)))
    return out


def best_source(df: DataFrame, sources: DataFrame, ident: str, keys: str, source_key: str, metric: str,
                cols: Sequence[str]) -> DataFrame:
    """Per record the source with the highest metric over an array of keys; the first key wins ties.

    Only the identifier and the exploded key are shuffled; the pick is a
    partial aggregate.
    """
    exploded = df.select(ident, F.posexplode(keys).alias("_pos", source_key))
    payload = F.struct(F.lit(1).alias("_hit"), *cols)
    found = lookup_join(exploded, sources.select(source_key, metric, payload.alias("_src")), source_key, "inner")
    score = F.struct(F.coalesce(F.col(metric), F.lit(0)), -F.col("_pos"))
    best = found.groupBy(ident).agg(F.max_by("_src", score).alias("_src"))
    joined = df.join(best, ident, "left")
    return joined.select(*df.columns, *[F.col(f"_src.{c}").alias(c) for c in cols])


def flag_exists(df: DataFrame, keys: DataFrame, key: str, name: str = "verified") -> DataFrame:
    """Flag rows whose key occurs in ``keys``."""
    known = keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    return lookup_join(df, known, key).withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def pending(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work that is not done yet, by composite key; a null key is never done."""
    return lookup_join(df, done.select(*keys), list(keys), "left_anti").select(*df.columns)


def worklist(subjects: DataFrame, items: DataFrame, entities: Sequence[str], langs: Sequence[str]) -> DataFrame:
    """Every subject × item × (entity when the item is a template) × language.

    The product is the feature; nothing is collected, and neither table is bounded.
    """
    slots = F.when(F.col("is_template"), F.array(*[F.lit(e) for e in entities])).otherwise(F.array(F.lit("")))
    opened = subjects.crossJoin(items.withColumn("entity", F.explode(slots)))
    return opened.withColumn("lang", F.explode(F.array(*[F.lit(x) for x in langs])))


def worklist_size(subjects: DataFrame, items: DataFrame, n_entities: int, n_langs: int) -> DataFrame:
    """Expected size of :func:`worklist` without building it."""
    per_subject = items.agg(
        F.sum(F.when(F.col("is_template"), F.lit(n_entities)).otherwise(F.lit(1)) * F.lit(n_langs)).alias("n")
    ).scalar()
    return subjects.agg((F.count(F.lit(1)) * per_subject).alias("expected"))


def fallback_publisher(df: DataFrame, primary: str, doi: str, name: str = "publisher", **kw) -> DataFrame:
    """Publisher given, else by DOI prefix."""
    return df.withColumn(name, values.publisher(F.col(primary), F.col(doi), **kw))


def doi_overlap(corpus: DataFrame, biblio: DataFrame, text: str = "text", label: str = "label", doi: str = "doi") -> DataFrame:
    """Label counts of the corpus documents whose DOI is in the bibliography."""
    found = corpus.select(F.lower(values.find_doi(F.col(text))).alias("_doi"), label).where(F.col("_doi").isNotNull())
    known = biblio.select(F.lower(values.bare_doi(F.col(doi))).alias("_doi")).where(F.col("_doi").isNotNull()).distinct()
    return lookup_join(found, known, "_doi", "left_semi").groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def coalesce_sources(keys: DataFrame, sources: Sequence[tuple[str, DataFrame]], key: str, value: str,
                     missing: str = "unreachable") -> DataFrame:
    """Value of the first source that has one, with the name of that source."""
    out = keys
    for i, (_, df) in enumerate(sources):
        out = lookup_join(out, df.select(key, F.col(value).alias(f"_v{i}")), key)
    cols = [F.col(f"_v{i}") for i in range(len(sources))]
    origin = None
    for c, (name, _) in zip(cols, sources):
        origin = F.when(c.isNotNull(), F.lit(name)) if origin is None else origin.when(c.isNotNull(), F.lit(name))
    return out.select(
        *keys.columns, F.coalesce(*cols, F.lit(None)).alias(value), origin.otherwise(F.lit(missing)).alias("origin")
    )


def cross_validate(a: DataFrame, b: DataFrame, key: str, cls: str) -> DataFrame:
    """Classes of two providers side by side for the keys both answered."""
    other = b.select(key, F.col(cls).alias("other"))
    return lookup_join(a, other, key, "inner").withColumn("agrees", F.col(cls).eqNullSafe(F.col("other")))


def compare_status(df: DataFrame, prior: str = "prior", now: str = "now", alias_of: Mapping[str, str] | None = None) -> DataFrame:
    """Agreement of the new status with the earlier one; ``alias_of`` names equal statuses."""
    same = F.col(prior).eqNullSafe(F.col(now))
    for old, new in (alias_of or {}).items():
        same = same | ((F.col(prior) == old) & (F.col(now) == new))
    return df.withColumn("agrees", F.coalesce(same, F.lit(False)))


def watchlist_sum(df: DataFrame, watchlist: Sequence[str], key: str, count: str) -> DataFrame:
    """Rows and summed count of the watched keys (zero when none occurs)."""
    hit = df.where(F.lower(F.coalesce(F.col(key), F.lit(""))).isin(*watchlist))
    return hit.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(count), F.lit(0)).alias("total")
    )
