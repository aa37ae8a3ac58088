"""A Merkle manifest of a dataset, with a proof for every row by octopus multiproofs.

Rows are leaves; the leaves of a group, in order, form a binary tree whose last node may stand alone, and the roots of the
groups form the upper tree. A digest is lower-case hex sha256; inputs are concatenated as text.

* Leaf digests are computed beside the scan and written once; only they are ordered (range partitions, exact positions).
* A leaf partition is an aligned block of ``1 << bits`` positions of a group. It derives its node, and the minimal union of
  the nodes that the proofs of all its leaves need and that it cannot derive itself (``missing``).
* Nodes above the leaf partitions are derived the same way, a block of nodes in each task, until one is left in each group.
* Each leaf partition fetches its missing nodes once, by one join, derives its shared interior nodes and expands the single
  proofs. No task holds more than a block of leaves and one path of nodes, and no digest goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelens.operators.scale import materialize

BLOCK_BITS = 12
RANGE_ROWS = 200_000
Known = dict[tuple[int, int], str]


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def width(size: int, level: int) -> int:
    """Nodes of a level of a tree over ``size`` leaves."""
    return -(-size >> level)


def height(size: int) -> int:
    return max(0, size - 1).bit_length()


def missing(places: Iterable[int], size: int, level: int = 0) -> list[tuple[int, int]]:
    """(level, place) of the fewest nodes that, with the nodes at ``places`` of ``level``, give all their proofs and the root."""
    known, need = set(places), []
    while width(size, level) > 1:
        need += [(level, p) for p in sorted({p ^ 1 for p in known} - known) if p < width(size, level)]
        known = {p >> 1 for p in known}
        level += 1
    return need


def derive(row: dict[int, str], level: int, size: int, top: int) -> Known:
    """The given nodes of a level and all above them, up to level ``top``, whose children are all known."""
    nodes = {(level, p): d for p, d in row.items()}
    while level < min(top, height(size)):
        up = {}
        for p, d in row.items():
            if not p & 1:
                if p + 1 >= width(size, level):
                    up[p >> 1] = digest(d)
                elif p + 1 in row:
                    up[p >> 1] = digest(d, row[p + 1])
        level, row = level + 1, up
        nodes.update({(level, p): d for p, d in row.items()})
    return nodes


def path(nodes: Known, place: int, size: int) -> list[dict]:
    """The siblings of a leaf level by level, each with whether it stands left; an empty one where the node is alone."""
    out = []
    for level in range(height(size)):
        other = place ^ 1
        out.append({"node": nodes[level, other] if other < width(size, level) else "", "left": bool(place & 1)})
        place >>= 1
    return out


def field(value: str | Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*fields), 256)


def positions(leaves: DataFrame, rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """Add ``pos`` (from 0) and ``size`` within each group ``g``, in the order of ``o`` and then ``leaf``.

    ``leaves`` must be a written table: equal rows take their order from their place in it, which a repeated task finds
    again and which lets a cut go through many equal rows. The result reads a written table too.
    """
    ranges = max(1, -(-leaves.count() // rows_per_range))
    order = [F.col("g"), F.asc_nulls_first("o"), F.col("leaf"), F.col("tie")]
    ranged = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    ordered = materialize(ranged.drop("tie").withColumn("row", F.monotonically_increasing_id()), "merkle-order").withColumn("range", F.shiftright("row", 33))
    # One row for each range and group: a window sorts at most one row for each range of a group.
    parts = ordered.groupBy("g", "range").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy("g").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("g").agg(F.sum("n").alias("size"))
    shift = (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")
    parts = materialize(parts.select("g", "range", shift).join(sizes, "g"), "merkle-ranges")
    return ordered.join(parts, ["g", "range"]).withColumn("pos", F.col("row") + F.col("shift")).drop("row", "range", "shift")


def _root_level() -> Column:
    return F.when(F.col("size") <= 1, F.lit(0)).otherwise(F.length(F.bin(F.col("size") - 1)))


def block_nodes(placed: DataFrame, bits: int) -> DataFrame:
    """(g, size, block, digest, need): the node of each leaf partition, and the nodes that it misses."""

    def block(part: pd.DataFrame) -> pd.DataFrame:
        size, at = int(part["size"].iloc[0]), int(part["pos"].iloc[0]) >> bits
        nodes = derive(dict(zip(part["pos"].tolist(), part["leaf"], strict=True)), 0, size, bits)
        need = [{"level": lv, "place": p} for lv, p in missing(part["pos"].tolist(), size)]
        return pd.DataFrame({"g": [part["g"].iloc[0]], "size": [size], "block": [at], "digest": [nodes[min(bits, height(size)), at]], "need": [need]})

    return placed.select("g", "size", "pos", "leaf").groupBy("g", F.shiftright("pos", bits)).applyInPandas(
        block, "g string, size long, block long, digest string, need array<struct<level:int,place:long>>")


def _climb(level: int, bits: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def climb(part: pd.DataFrame) -> pd.DataFrame:
        size = int(part["size"].iloc[0])
        nodes = derive(dict(zip(part["place"].tolist(), part["digest"], strict=True)), level, size, level + bits)
        above = [(part["g"].iloc[0], size, lv, p, d) for (lv, p), d in nodes.items() if lv > level]
        return pd.DataFrame(above, columns=["g", "size", "level", "place", "digest"])

    return climb


def upper_nodes(blocks: DataFrame, bits: int) -> DataFrame:
    """(g, size, level, place, digest) of all nodes from those of the leaf partitions to the roots."""
    schema = "g string, size long, level int, place long, digest string"
    largest = blocks.agg(F.max("size")).first()[0] or 0
    out = [blocks.select("g", "size", F.least(F.lit(bits), _root_level()).alias("level"), F.col("block").alias("place"), "digest")]
    level = bits
    while height(largest) > level:

        at = out[-1].where((F.col("level") == level) & (_root_level() > level))
        out.append(materialize(at.groupBy("g", F.shiftright("place", bits)).applyInPandas(_climb(level, bits), schema), "merkle-nodes"))
        level += bits
    return reduce(DataFrame.unionByName, out)


def forest(leaves: DataFrame, bits: int, above: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The columns of ``leaves`` with subroot, root and siblings array<struct<node, left>> of each leaf.

    ``leaves`` has g (string, never null), o (the order in g) and leaf (hex). ``above`` makes, of the roots of all groups
    (g, subroot), the rest of each group's proofs (g, upper, root); without it, the root is that of the group.
    """
    placed = positions(materialize(leaves, "merkle-leaves"))
    blocks = materialize(block_nodes(placed, bits), "merkle-blocks")
    nodes = upper_nodes(blocks, bits)
    roots = nodes.where(F.col("level") == _root_level()).select("g", F.col("digest").alias("subroot"))
    none = F.expr("cast(array() as array<struct<node:string,left:boolean>>)")
    # One row for each group, written so that its size is known: Spark broadcasts it only below its threshold.
    upper = materialize(above(roots) if above else roots.select("g", none.alias("upper"), F.col("subroot").alias("root")), "merkle-upper")
    ask = blocks.select("g", "block", F.explode("need").alias("n")).select("g", "block", "n.level", "n.place")
    got = ask.join(nodes.drop("size"), ["g", "level", "place"]).groupBy("g", "block").agg(F.collect_list(F.struct("level", "place", "digest")).alias("nodes"))
    fetched = blocks.select("g", "block").join(got, ["g", "block"], "left").join(upper, "g")

    def expand(part: pd.DataFrame, fetch: pd.DataFrame) -> pd.DataFrame:
        size, at, have = int(part["size"].iloc[0]), int(part["block"].iloc[0]), fetch.iloc[0]
        places = part["pos"].tolist()
        nodes = derive(dict(zip(places, part["leaf"], strict=True)), 0, size, bits)
        nodes |= {(n["level"], n["place"]): n["digest"] for n in (have["nodes"] if have["nodes"] is not None else [])}
        for level in range(min(bits, height(size)), height(size)):
            nodes |= derive({p: nodes[level, p] for p in (at, at ^ 1) if (level, p) in nodes}, level, size, level + 1)
            at >>= 1
        upper = list(have["upper"])
        out = part.drop(columns=["block", "pos", "size"])
        out["siblings"] = [path(nodes, p, size) + upper for p in places]
        out["subroot"], out["root"] = nodes[height(size), 0], have["root"]
        return out

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema.fields)
    left = placed.select(*leaves.columns, "size", "pos", F.shiftright("pos", bits).alias("block"))
    return left.groupBy("g", "block").cogroup(fetched.groupBy("g", "block")).applyInPandas(
        expand, f"{given}, siblings array<struct<node:string,left:boolean>>, subroot string, root string")


def manifest(leaves: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(id, leaf and the other given columns, siblings, subroot, root) of every leaf of a two-step manifest.

    ``leaves`` has key (the group: null first, then by UTF-8 bytes), id (the order in a group, null first), leaf (hex) and any
    other columns but g, o, size, pos, block, row, range, tie, shift. Rows of equal id are ordered by leaf; equal rows are
    leaves of their own, in any order. An empty table has no roots and gives no rows.
    """
    # A key in text that is never null and keeps the order.
    named = leaves.select(F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit("")).alias("g"), F.col("id").alias("o"),
                          *[c for c in leaves.columns if c not in ("key", "id")])

    def above(roots: DataFrame) -> DataFrame:
        tops = forest(roots.select(F.lit("").alias("g"), F.col("g").alias("o"), F.col("subroot").alias("leaf")), bits)
        return tops.select(F.col("o").alias("g"), F.col("siblings").alias("upper"), "root")

    return forest(named, bits, above).withColumnRenamed("o", "id").drop("g")


def fold(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""

    def step(node: Column, s: Column) -> Column:
        return F.sha2(F.when(s["left"], F.concat(s["node"], node)).otherwise(F.concat(node, s["node"])), 256)

    return F.aggregate(siblings, leaf, step)


def proof_digest(siblings: Column) -> Column:
    return F.sha2(F.array_join(F.transform(siblings, lambda s: s["node"]), ""), 256)
