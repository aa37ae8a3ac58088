"""Membership in a transitive hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.operators.scale import discard, materialize

PLAIN_LEVELS = 8


def closure(edges: DataFrame, roots: DataFrame, child: str = "child", parent: str = "parent", max_depth: int | None = None,
            plain_levels: int = PLAIN_LEVELS) -> DataFrame:
    """All nodes below each root: columns ``root``, ``node``, ``depth`` (shortest), to the last level or ``max_depth``.

    The first ``plain_levels`` levels each join the pairs of the level before with the edges and are written out, so a lost
    executor never replays the chain. A hierarchy that goes on then is deep: nodes with a single parent are folded by pointer
    doubling (pairs joined with pairs, twice the distance each round), so a chain or tree costs the logarithm of its depth, and
    only the graph of nodes with several parents is walked. Rounds end with no new or shorter pair, so cycles are no danger.
    """
    steps = edges.select(F.col(parent).alias("node"), F.col(child).alias("_child")).where("node <> _child").distinct()
    steps = materialize(steps, "edges")
    fresh = materialize(roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth")).distinct(), "closure")
    levels, found, depth = [fresh], fresh, 0
    limit = plain_levels if max_depth is None else min(plain_levels, max_depth)
    while depth < limit and (depth == 0 or not fresh.isEmpty()):
        depth += 1
        reached = fresh.join(steps, "node").select("root", F.col("_child").alias("node")).distinct()
        new = reached.join(found.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth))
        fresh = materialize(new, "closure")
        levels.append(fresh)
        found = found.unionByName(fresh)
    if (max_depth is None or depth < max_depth) and not fresh.isEmpty():
        found = _below(steps, found, fresh, max_depth).groupBy("root", "node").agg(F.min("depth").alias("depth"))
    out = materialize(found.where(F.col("depth") > 0), "closure")
    discard(steps, *levels)
    return out


def _folded(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, head, dist): the inner nodes of trees, with the head they hang on and the distance from it.

    An inner node has one parent and is no start, so all ways to it pass its head, however many branches leave on the way. Every
    round doubles the distance that a pointer spans, and leaves one pointer for each node; a pointer that has met its head is
    not joined again. A ring of inner nodes is reached by no start; the number of rounds is bounded by the number of
    pointers, so it does not keep the rounds going.
    """
    inner = steps.groupBy("_child").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n = 1")
    inner = inner.join(starts, F.col("_child") == F.col("node"), "left_anti")
    at = materialize(inner.select(F.col("_child").alias("node"), "head", F.lit(1).cast("long").alias("dist"), F.lit(True).alias("moved")), "chains")
    bound = max(1, at.count()).bit_length() + 1
    for _ in range(bound):
        up = at.select(F.col("node").alias("head"), F.col("head").alias("_head"), F.col("dist").alias("_dist"))
        both = at.where("moved").join(up, "head", "left")
        moved = both.select("node", F.coalesce("_head", "head").alias("head"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"),
                            F.col("_head").isNotNull().alias("moved"))
        old, at = at, materialize(moved.unionByName(at.where("NOT moved")), "chains")
        discard(old)
        if at.where("moved").isEmpty():
            break
    return at.drop("moved")


def _below(steps: DataFrame, found: DataFrame, starts: DataFrame, max_depth: int | None) -> DataFrame:
    """``found`` (root, node, depth) and what lies below ``starts``, its last level, by the graph of heads."""
    chains = _folded(steps, starts.select("node").distinct())
    # An edge from an inner node starts at its head; one to an inner node is part of a tree.
    out = steps.join(chains.select(F.col("node").alias("_child")), "_child", "left_anti").join(chains, "node", "left")
    links = out.select(F.coalesce("head", "node").alias("node"), F.col("_child").alias("to"), (F.coalesce("dist", F.lit(0)) + 1).alias("w"))
    links = materialize(links.groupBy("node", "to").agg(F.min("w").alias("w")), "chains")
    best = found.select("root", "node", F.col("depth").cast("long").alias("depth"))
    fresh = starts.select("root", "node", F.col("depth").cast("long").alias("depth"))
    while not fresh.isEmpty():
        reached = fresh.join(links, "node").groupBy("root", F.col("to").alias("node")).agg(F.min(F.col("depth") + F.col("w")).alias("depth"))
        if max_depth is not None:
            reached = reached.where(F.col("depth") <= max_depth)
        known = best.select("root", "node", F.col("depth").alias("_known"))
        better = reached.join(known, ["root", "node"], "left").where("_known IS NULL OR depth < _known").drop("_known")
        fresh = materialize(better, "closure")
        best = materialize(best.unionByName(fresh).groupBy("root", "node").agg(F.min("depth").alias("depth")), "closure")
    members = best.join(chains.select(F.col("head").alias("node"), F.col("node").alias("_node"), "dist"), "node")
    below = members.select("root", F.col("_node").alias("node"), (F.col("depth") + F.col("dist")).alias("depth"))
    if max_depth is not None:
        below = below.where(F.col("depth") <= max_depth)
    return best.unionByName(below).select("root", "node", F.col("depth").cast("int").alias("depth"))
