"""Sharding by sampled splitters.

A size-weighted sample of keys (priority sampling) gives quantile boundaries, which range-partition the rows finely; ranges
that turn out overfull, such as one of many equal texts, are subdivided by row. Ranges in order carry exact sums of bytes
and rows, so every row has its exact place on the byte axis of the whole table, and shards are equal parts of that axis.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelens.operators.scale import materialize


def splitters(rows: DataFrame, ranges: int, per_range: int = 8) -> np.ndarray:
    """Upper boundaries of the ranges: weighted quantiles of a sample of ``ranges * per_range`` keys (the documented bound).

    A row's priority is its size over a uniform hash of it; the rows of largest priority are a sample without replacement
    whose weights are the size or the smallest priority, whichever is more.
    """
    uniform = (F.pmod(F.xxhash64(F.lit(3), F.col("key"), F.col("row")), F.lit(1 << 52)) + 1) / float(1 << 52)
    top = rows.select("key", "size", (F.col("size") / uniform).alias("p")).orderBy(F.desc("p"), "key").limit(ranges * per_range).collect()
    if not top:
        return np.empty(0, np.int64)
    floor = min(r["p"] for r in top)
    key = np.array([r["key"] for r in top], np.int64)
    weight = np.array([max(r["size"], floor) for r in top], float)
    order = np.argsort(key, kind="stable")
    share = np.cumsum(weight[order]) / weight.sum()
    cut = np.searchsorted(share, np.arange(1, ranges) / ranges)
    return np.unique(key[order][np.minimum(cut, len(key) - 1)])


def shard_rows(docs: DataFrame, shards: int = 24, ranges_per_shard: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): shards of near equal bytes (UTF-8 bytes of the text plus 8 per row).

    Keys are text hashes, so equal texts are neighbours; a group of them that overfills a range is cut by row. Slots count
    from 0 within a shard. Null texts have no bytes and the checksum of no bytes; null ids and repeated rows are rows like
    any other; an empty table gives no row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"))
    # Written once: row numbers and everything after them stay the same when tasks are repeated.
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    bounds = splitters(rows, shards * ranges_per_shard)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="left").astype(np.int32))

    ranged = materialize(rows.withColumn("range", range_of("key")), "shard-ranges")
    fill = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    even = F.sum("bytes").over(Window.partitionBy(F.lit(0))) / F.lit(shards * ranges_per_shard)
    # One row per range: a fixed number, so this table may be broadcast.
    parts = fill.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("bytes") / (2 * even))).cast("long")).select("range", "parts")
    fine = ranged.join(F.broadcast(parts), "range").withColumn("part", F.pmod(F.xxhash64(F.lit(5), F.col("row")), F.col("parts"))).drop("parts")
    sums = fine.groupBy("range", "part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("range", "part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.sum("b").over(Window.partitionBy(F.lit(0))).alias("total"))
    # At most three parts for each range.
    placed = fine.join(F.broadcast(offsets), ["range", "part"])
    inside = Window.partitionBy("range", "part").orderBy("key", "id", "row")
    at = F.col("b0") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(at * shards / F.col("total"))).cast("int")).withColumn("place", F.col("n0") + F.row_number().over(inside) - 1)
    placed = materialize(placed.select("id", "size", "text_crc32", "shard", "place"), "shard-places")
    # A table of `shards` rows.
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    out = placed.join(F.broadcast(firsts), "shard")
    return out.select("id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, **options) -> None:
    """Write the documents as one folder of Parquet files per shard, rows in the order of their slots. Ids must be unique."""
    plan = shard_rows(docs, shards, **options).select("id", "shard", "slot")
    id_col = options.get("id_col", "doc_id")
    joined = docs.join(plan.withColumnRenamed("id", id_col), id_col)
    joined.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
