"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

Documents of a source are put into blocks by a hash. A source's target in words is a number of whole passes over its blocks
and a part of one more pass, in a permuted block order; that fixes its quota, an exact number of block draws. The tree splits
the quotas of all sources among the output shards: a node with k shards gives its left child the share of its draws that its
shards make up, chosen without replacement, so the numbers per source follow the multivariate hypergeometric law. At the
leaves each shard owns a run of every source's permuted draws, so shards never share a draw, and a shard's rows are ordered
by a hash.

Sizes: one row per source, and at most ``MAX_BLOCKS`` blocks beyond one per 64 documents of small sources, whatever the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelens.llm.common import WORD
from framelens.operators.scale import materialize

MAX_BLOCKS = 1 << 16
BROADCAST_ROWS = 100_000


def word_count(text_col: str) -> Column:
    """Words of a text (runs without ASCII white space); 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def measured(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast only if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def targets(stats: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Add ``target`` to (source, source_size, ...): ``share`` of all sizes dealt by weight, no source above ``cap`` sizes.

    Sources take the weights in turn, by code point with null last. What a cap cuts off goes to the others by weight: with
    sources in the order of cap / weight, the level of the first one that stays under its cap holds for all after it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy(F.lit(0))
    rows = stats.withColumn("_w", w).withColumn("_cap", F.lit(float(cap)) * F.col("source_size")).withColumn("_at", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", left / weight)
    level = F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_at", "source", "_level"))).over(every)["_level"]
    return rows.withColumn("target", F.least(F.col("_w") * F.coalesce(level, F.lit(float("inf"))), F.col("_cap"))).drop("_w", "_cap", "_at", "_level")


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, q) to (source, shard, q): level by level, each node splits its draws among its two halves of shards."""
    nodes = quotas.select("source", "q", F.lit(0).alias("lo"), F.lit(shards).alias("width"))
    level, widest = 0, shards
    while widest > 1:
        ticket = nodes.select("source", "lo", "width", F.explode(F.sequence(F.lit(1).cast("long"), F.col("q"))).alias("ticket"))
        key = F.xxhash64(F.lit(seed), F.lit(level), F.col("lo"), F.col("source"), F.col("ticket"))
        node = Window.partitionBy("lo")
        rank = F.row_number().over(node.orderBy(key, F.col("source").asc_nulls_last(), "ticket"))
        half = (F.col("width") + 1).cast("int") / 2
        half = F.floor(half).cast("int")
        goal = F.floor((F.count("*").over(node) * half + F.floor(F.col("width") / 2)) / F.col("width"))
        ticket = ticket.withColumn("_left", rank <= goal)
        nodes = ticket.groupBy(
            "source", F.when(F.col("_left"), F.col("lo")).otherwise(F.col("lo") + half).alias("lo"),
            F.when(F.col("_left"), half).otherwise(F.col("width") - half).alias("width"),
        ).agg(F.count("*").alias("q"))
        level, widest = level + 1, -(-widest // 2)
    return nodes.select("source", F.col("lo").alias("shard"), "q")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, shards: int = 16, seed: int = 20,
                docs_per_block: int = 4096, keep_rows: bool = False, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken and ``draws``.

    ``draws`` lists (pass, shard, words, place): a copy that the mix takes, its shard, how many of its leading words belong to
    the mix (all, except at the edge of a target), and its order within the shard. With ``keep_rows`` the input row follows
    as the struct ``row``. Null sources are one source; null and empty texts have size 0 and are never drawn; repeated rows
    are drawn one by one; an empty table gives no row. Reruns agree: order and draws come from hashes of ids.
    """
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    fields = [F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"), h.alias("h"), word_count(text_col).alias("size")]
    digest = materialize(docs.select(*fields), "mix-digest")
    stats = digest.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    per_block = F.greatest(F.lit(docs_per_block), F.ceil(F.sum("n").over(Window.partitionBy(F.lit(0))) / MAX_BLOCKS))
    blocks = F.greatest(F.least(F.col("n"), F.lit(64)), F.ceil(F.col("n") / per_block)).cast("long")
    stats = measured(materialize(targets(stats, weights, share, cap).withColumn("blocks", blocks).drop("n"), "mix-sources"))

    def placed(rows: DataFrame) -> DataFrame:
        other = stats.withColumnRenamed("source", "_source")
        return rows.join(other, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("block", F.pmod("h", "blocks")).drop("blocks")

    per = placed(digest).groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    passes = F.floor(F.col("target") / F.col("source_size"))
    per = per.where("words > 0").withColumn("full", passes).withColumn("rest", F.round(F.col("target") - F.col("full") * F.col("source_size")).cast("long"))
    per = per.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
    order = Window.partitionBy("source").orderBy("pass", F.xxhash64(F.lit(seed), F.col("source"), F.col("block"), F.col("pass")), "block")
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source", "pass").orderBy(F.xxhash64(F.lit(seed), F.col("source"), F.col("block"), F.col("pass")), "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = F.when(F.col("pass") < F.col("full"), F.col("words")).otherwise(F.least(F.col("words"), F.col("rest") - before))
    drawn = per.withColumn("cut", cut).where("cut > 0").withColumn("slot", F.row_number().over(order).cast("long"))
    drawn = materialize(drawn.select("source", "block", "pass", "cut", "slot"), "mix-draws")
    leaf = split_quotas(drawn.groupBy("source").agg(F.count("*").alias("q")), shards, seed)
    upto = F.sum("q").over(Window.partitionBy("source").orderBy("shard"))
    owner = leaf.withColumn("_to", upto).select("source", "shard", F.explode(F.sequence(F.col("_to") - F.col("q") + 1, F.col("_to"))).alias("slot"))
    owner = owner.withColumnRenamed("source", "_source").withColumnRenamed("slot", "_slot")
    drawn = drawn.join(owner, F.col("source").eqNullSafe(F.col("_source")) & (F.col("slot") == F.col("_slot")))
    drawn = drawn.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "cut"))).alias("slots"))
    drawn = measured(materialize(drawn.withColumnsRenamed({"source": "_source", "block": "_block"}), "mix-blocks"))

    rows = docs.select(*fields, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) if keep_rows else digest
    out = placed(rows).join(drawn, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")), "left")
    inside = Window.partitionBy("source", "block").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))

    def draw(s: Column) -> Column:
        words = F.greatest(F.lit(0), F.least(F.col("size"), s["cut"] - F.col("_before")))
        return F.struct(s["pass"].alias("pass"), s["shard"].alias("shard"), words.alias("words"), F.xxhash64(F.lit(seed), s["shard"], s["pass"], F.col("h")).alias("place"))

    taken = F.filter(F.transform(F.coalesce(F.col("slots"), F.array()), draw), lambda d: d["words"] > 0)
    out = out.withColumn("draws", taken)
    total = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    cols = ["id", "source", "size", "source_size", "target", total.alias("taken"), "draws"]
    return out.select(*cols, *(["row"] if keep_rows else []))


def mixed_rows(docs: DataFrame, shards: int = 16, **options) -> DataFrame:
    """The mix itself: input rows, once for every copy drawn, shard by shard in each shard's own random order.

    A document at the edge of a target is taken whole. Columns are those of ``docs``. Tasks take ranges of the shards' orders:
    as many as the session deals, so a shard may be written by several.
    """
    got = mix_sources(docs, shards=shards, keep_rows=True, **options)
    copies = got.select("row", F.explode("draws").alias("d"))
    local = copies.repartitionByRange(F.col("d.shard"), F.col("d.place")).sortWithinPartitions("d.shard", "d.place")
    return local.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
