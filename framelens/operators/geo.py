"""Point in polygon as an equi-join on a grid of several levels plus an even-odd test.

Bounding boxes lie in a few cells of a level that fits them and points carry their cell of each level, so the candidate step
is an equi-join (broadcast when the polygons are measured small, salted otherwise) and never a comparison of all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.operators.scale import lookup_join


def ring_crossings(ring: Column, x: Column, y: Column) -> Column:
    """Number of ring edges a ray from the point to the right crosses."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        here, before = F.element_at(ring, i), F.element_at(ring, F.when(i == 1, n).otherwise(i - 1))
        # A level edge never straddles the ray, so its null slope does not matter.
        slope = (before[0] - here[0]) / F.nullif(before[1] - here[1], F.lit(0.0))
        straddles = (here[1] > y) != (before[1] > y)
        return straddles & (x < here[0] + slope * (y - here[1]))

    edges = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(edges, crosses))


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    return ring_crossings(ring, x, y) % 2 == 1


def in_polygon(rings: Column, x: Column, y: Column) -> Column:
    """Inside the outer ring and inside no hole."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    outer = F.get(rings, F.lit(0))
    return F.coalesce(in_ring(outer, x, y), F.lit(False)) & ~F.exists(holes, lambda h: in_ring(h, x, y))


def polygon_parts(df: DataFrame, ident: str, geometry_type: str = "type", polygons: str = "polygons") -> DataFrame:
    """One row per polygon of a (multi-)polygon feature: ``rings`` is an array of rings of points.

    Other geometry types contribute nothing.
    """
    return df.where(F.col(geometry_type).isin("Polygon", "MultiPolygon")).select(
        ident, F.explode(polygons).alias("rings")
    )


def points_in_polygons(points: DataFrame, parts: DataFrame, point_id: str, polygon_id: str, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs (point, polygon) with the point inside; a multi-polygon counts once.

    The grid has a level for each axis: a polygon's cells are at least as wide and as high as its bounding box, in powers of
    four, so every box, thin or large, lies in a few cells. A point looks into one cell of each pair of levels that
    some polygon has. Only boxes take part in that join; the rings are joined to the pairs whose box holds the point.
    """
    boxes = parts.select(F.col(polygon_id).alias("_poly"), _box(F.get(F.col("rings"), F.lit(0))).alias("b")).where("b.x0 IS NOT NULL AND b.y0 IS NOT NULL")
    boxes = boxes.select("_poly", "b.*").distinct().withColumns({"lx": _level("x0", "x1"), "ly": _level("y0", "y1")})
    # At most one row for each pair of exponents of a double, however many polygons there are.
    levels = [(r["lx"], r["ly"]) for r in boxes.select("lx", "ly").distinct().collect()]
    gridded = boxes.withColumn("_cx", F.explode(F.sequence(_cell("x0", "lx"), _cell("x1", "lx")))).withColumn(
        "_cy", F.explode(F.sequence(_cell("y0", "ly"), _cell("y1", "ly"))))
    each = F.array(*[F.struct(F.lit(a).alias("lx"), F.lit(b).alias("ly")) for a, b in sorted(levels)]) if levels else F.expr("cast(array() as array<struct<lx:int,ly:int>>)")
    located = points.select(F.col(point_id), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.explode(each).alias("l")).select(
        point_id, "_x", "_y", "l.lx", "l.ly").withColumns({"_cx": _cell("_x", "lx"), "_cy": _cell("_y", "ly")})
    near = lookup_join(located, gridded, ["lx", "ly", "_cx", "_cy"], "inner")
    held = near.where("_x BETWEEN x0 AND x1 AND _y BETWEEN y0 AND y1").select(point_id, "_x", "_y", "_poly", "x0", "x1", "y0", "y1")
    rings = parts.select(F.col(polygon_id).alias("_poly"), "rings", _box(F.get(F.col("rings"), F.lit(0))).alias("b")).select("_poly", "rings", "b.*")
    tested = lookup_join(held, rings, ["_poly", "x0", "x1", "y0", "y1"], "inner").where(in_polygon(F.col("rings"), F.col("_x"), F.col("_y")))
    return tested.select(point_id, F.col("_poly").alias(polygon_id)).distinct()


def _box(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return F.struct(F.array_min(xs).cast("double").alias("x0"), F.array_max(xs).cast("double").alias("x1"),
                    F.array_min(ys).cast("double").alias("y0"), F.array_max(ys).cast("double").alias("y1"))


def _level(low: str, high: str) -> Column:
    """The smallest k for which 4^k is at least the span; a span of nothing, or one that its place rounds away, has the level of the place's precision."""
    span = F.greatest(F.col(high) - F.col(low), F.greatest(F.abs(F.col(low)), F.abs(F.col(high))) * F.lit(2.0**-40), F.lit(2.0**-100))
    return F.ceil(F.log2(span) / 2).cast("int")


def _cell(value: str, level: str) -> Column:
    return F.floor(F.col(value) / F.pow(F.lit(4.0), F.col(level))).cast("long")
