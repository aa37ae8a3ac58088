"""Keyed first/last, samples, orderings and top-k.

Spark rows have no order, so every operator takes one explicitly; make it
unique to make the result unique.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelens.operators.scale import number_few, number_rows, top_per_key


def dedup_first(df: DataFrame, key: Sequence[str] | Column, order: Sequence[Column], keep_blank: bool = False) -> DataFrame:
    """First row per key. With ``keep_blank`` rows with an empty key are all kept.

    Rows with a blank key are spread by all their columns, so they never meet in one task; ``df`` is computed once.
    """
    if isinstance(key, Column):
        keyed, names = df.withColumn("_key", key), ["_key"]
    else:
        keyed, names = df, list(key)
    if not keep_blank:
        return top_per_key(keyed, names, order).drop("_key")
    blank = F.coalesce(F.col(names[0]).cast("string"), F.lit("")) == ""
    spread = F.when(blank, F.struct(*keyed.columns))
    # Blank rows meet only equal rows, with which they tie: the rank keeps all, and is limited per task as a row number is.
    by = Window.partitionBy(*names, "_spread").orderBy(*order)
    first = keyed.withColumn("_spread", spread).withColumn("_rank", F.rank().over(by)).where("_rank <= 1")
    return first.withColumn("_rn", F.row_number().over(by)).where((F.col("_rn") == 1) | blank).drop("_key", "_spread", "_rank", "_rn")


def upsert_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key: a later row replaces an earlier one."""
    return top_per_key(df, keys, [F.col(c).desc() for c in order])


def sample_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, where: Column | None = None) -> DataFrame:
    """First ``n`` rows per group, optionally among the rows that satisfy ``where``."""
    return top_per_key(df if where is None else df.where(where), keys, order, n)


def rank_of(col: Column, order: Sequence[str], other: int = 9) -> Column:
    """Position of a value in a custom order; unlisted values come last."""
    out = None
    for i, v in enumerate(order):
        out = F.when(col == v, F.lit(i)) if out is None else out.when(col == v, F.lit(i))
    return out.otherwise(F.lit(other))


def top_k(df: DataFrame, by: str, k: int, tie: Sequence[str]) -> DataFrame:
    """Global top-k with a deterministic tie-break (a per-task top-k, then one merge)."""
    return df.orderBy(F.col(by).desc(), *tie).limit(k)


def ranked(df: DataFrame, by: str, tie: str, name: str = "position", descending: bool = True, few: bool = False) -> DataFrame:
    """Position of every row by ``by``, nulls last. ``few`` says that the table is small by nature: one sort, nothing written."""
    first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return (number_few if few else number_rows)(df, [first, F.col(tie).asc()], name)


def every_nth(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """Systematic sample: rows 1, n+1, 2n+1, … in ``order``."""
    return number_rows(df, order, "_pos").where((F.col("_pos") - 1) % n == 0).drop("_pos")


def fold_key_values(df: DataFrame, entity: str, key: str, value: str, order: Sequence[str], last: Mapping[str, str],
                    first: Mapping[str, str]) -> DataFrame:
    """Key-value records to one row per entity: ``last``/``first`` map output column to key.

    Partial aggregates keep one value per entity and key, so repeated keys do
    not travel.
    """
    ord_ = F.struct(*order)
    aggs = [F.max_by(value, F.when(F.col(key) == k, ord_)).alias(out) for out, k in last.items()]
    aggs += [F.min_by(value, F.when(F.col(key) == k, ord_)).alias(out) for out, k in first.items()]
    return df.groupBy(entity).agg(*aggs)


def pick_name(names: Column, flag: str) -> Column:
    """Value of the first name whose ``types`` contain ``flag``, else of the first name."""
    flagged = F.filter(names, lambda n: F.array_contains(n["types"], flag))
    return F.coalesce(
        F.nullif(F.get(flagged, F.lit(0))["value"], F.lit("")), F.get(names, F.lit(0))["value"], F.lit("")
    )


def last_element(items: Column) -> Column:
    """Last array element, null for an empty array."""
    return F.try_element_at(items, F.lit(-1))


def order_languages(df: DataFrame, lang: str, correct: Column, worst_first: bool = True, split: int | None = None) -> DataFrame:
    """Accuracy per language with its position; ``split`` marks the first block of a wide matrix."""
    per = df.groupBy(lang).agg(
        F.sum(F.when(correct, 1).otherwise(0)).alias("correct"), F.count(F.lit(1)).alias("total")
    ).withColumn("pct", F.round(F.lit(100.0) * F.col("correct") / F.col("total"), 1))
    first = F.col("pct").asc() if worst_first else F.col("pct").desc()
    out = number_few(per, [first, F.col(lang).asc()], "position")  # a row for each language
    return out if split is None else out.withColumn("block", F.when(F.col("position") <= split, 1).otherwise(2))
