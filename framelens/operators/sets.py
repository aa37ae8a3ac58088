"""Unions and set comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.operators.scale import top_per_key


def union_sources(sources: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """Collections with different columns as one table; the name of the source is kept."""
    parts = [df.withColumn(tag, F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def set_asymmetry(a: DataFrame, b: DataFrame, c: DataFrame, key: str) -> DataFrame:
    """Per key the region of three sets: ``a_only``, ``b_only``, ``both`` or ``c_only``.

    One aggregation over flagged rows instead of several set operations, so a
    key that is frequent in one input is reduced before the shuffle.
    """
    flags = [
        df.select(key, F.lit(i == 0).alias("in_a"), F.lit(i == 1).alias("in_b"), F.lit(i == 2).alias("in_c"))
        for i, df in enumerate((a, b, c))
    ]
    return (
        reduce(DataFrame.unionByName, flags)
        .groupBy(key)
        .agg(F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b"), F.bool_or("in_c").alias("in_c"))
        .withColumn(
            "region",
            F.when(F.col("in_a") & F.col("in_b"), F.lit("both"))
            .when(F.col("in_a"), F.lit("a_only"))
            .when(F.col("in_b"), F.lit("b_only"))
            .otherwise(F.lit("c_only")),
        )
    )


def union_dedup(branches: Sequence[DataFrame], key: str, order: Sequence[str] = ()) -> DataFrame:
    """Union of overlapping results; per key the row of the earliest branch stays."""
    parts = [df.withColumn("branch", F.lit(i)) for i, df in enumerate(branches)]
    both = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    usable = both.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return top_per_key(usable, [key], [F.col("branch"), *[F.col(c) for c in order]])


def union_with_defaults(parts: Sequence[DataFrame], columns: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Union to a fixed column list; missing metrics become zero."""
    both = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    have = set(both.columns)
    out = []
    for c in columns:
        value = F.col(c) if c in have else F.lit(None)
        out.append((F.coalesce(value.cast("long"), F.lit(0)) if c in numbers else value).alias(c))
    return both.select(*out)


def master_summary(manifests: Mapping[str, DataFrame | None], metric: str = "findings") -> DataFrame:
    """One row per manifest with its availability, rows and summed metric, and the totals of all under ``(all)``.

    An absent manifest is None; it and an empty one count nothing. A manifest without the metric adds zero.
    """
    spark = next(df for df in manifests.values() if df is not None).sparkSession
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(df is not None).alias("available")) for n, df in manifests.items()])
    names = spark.range(1).select(F.inline(listed))
    some = {n: df.select(F.col(metric).cast("long").alias("m") if metric in df.columns else F.lit(0).cast("long").alias("m")) for n, df in manifests.items() if df is not None}
    per = union_sources(some, "name").groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce("m", F.lit(0))).alias("total"))
    each = names.join(per, "name", "left")
    name = F.col("name")
    out = each.groupingSets([[name], []], name).agg(
        F.bool_and("available").alias("available"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.count_if("available").alias("n_available"), F.grouping_id().alias("_all"))
    return out.withColumn("name", F.when(F.col("_all") == 1, "(all)").otherwise(name)).drop("_all")
