"""Joins, windows and numbering on skewed data, against brute force."""

import pytest
from pyspark.sql import functions as F

from framelens.operators import geo, graph, joins, scale, sets, windows


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows has one key, a tenth has none."""
    return spark.range(6000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("key"))


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(50)], "key string, v int")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(skewed, table, how):
    want = sorted(map(str, skewed.join(table, "key", how).collect()))
    got = scale.salted_join(skewed, table, "key", how, rows_per_salt=300)
    assert sorted(map(str, got.select(*skewed.join(table, "key", how).columns).collect())) == want


def test_salting_spreads_hot_and_null_keys(skewed, table, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = scale.salted_join(skewed, table, "key", rows_per_salt=100).groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 0.6 * 6000, "no task holds the hot key as a whole"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_composite_key(spark):
    left = spark.range(1000).select("id", (F.col("id") % 2).alias("a"), F.when(F.col("id") % 5 > 0, F.lit("h")).alias("b"))
    right = spark.createDataFrame([(0, "h")], "a long, b string")
    assert scale.salted_join(left, right, ["a", "b"], "inner").count() == left.join(right, ["a", "b"]).count() == 400
    assert scale.salted_join(left, right, ["a", "b"], "left_anti").count() == 600


def test_lookup_broadcasts_what_its_plan_says_is_small(skewed, table, spark, tmp_path):
    table.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert scale.plan_bytes(stored) < 100_000 < scale.BROADCAST_BYTES < scale.plan_bytes(skewed.join(skewed.withColumnRenamed("id", "i"), "key"))
    small = sorted(map(str, scale.lookup_join(skewed, stored, "key").select("key", "id", "v").collect()))
    large = scale.salted_join(skewed, stored, "key").select("key", "id", "v")
    assert sorted(map(str, large.collect())) == small


def test_collect_bounded_refuses_large_tables(table):
    with pytest.raises(ValueError):
        scale.collect_bounded(table, 5)


def test_number_rows_is_exact_with_ties(spark):
    d = spark.range(5000).select("id", (F.col("id") % 3).alias("x"))
    got = {r["id"]: r["rn"] for r in scale.number_rows(d, [F.col("x").desc(), F.col("id").asc()], partitions=7).collect()}
    want = {i: n for n, i in enumerate(sorted(range(5000), key=lambda i: (-(i % 3), i)), 1)}
    assert got == want


def test_first_row_per_key_is_limited_before_the_shuffle(skewed):
    d = windows.sample_per_group(skewed, ["key"], [F.col("id")], 2)
    plan = d._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert sorted(r["id"] for r in d.where("key = 'hot'").collect()) == [0, 3]


def test_dedup(frame):
    d = frame([(1, "x"), (2, "x"), (3, ""), (4, ""), (5, None)], "id int, doi string")
    once = windows.dedup_first(d, ["doi"], [F.col("id")], keep_blank=True)
    assert sorted(r["id"] for r in once.collect()) == [1, 3, 4, 5]
    assert sorted(r["id"] for r in windows.dedup_first(once, ["doi"], [F.col("id")], keep_blank=True).collect()) == [1, 3, 4, 5]
    assert sorted(r["id"] for r in windows.upsert_last(d, ["doi"], ["id"]).collect()) == [2, 4, 5]


def test_fold_and_pick(frame):
    kv = frame([(1, 1, "created", "a"), (1, 2, "created", "b"), (1, 3, "org", "x"), (1, 4, "org", "y"), (2, 1, "other", "z")], "e int, n int, k string, v string")
    got = {r["e"]: (r["created"], r["org"]) for r in windows.fold_key_values(kv, "e", "k", "v", ["n"], {"created": "created"}, {"org": "org"}).collect()}
    assert got == {1: ("b", "x"), 2: (None, None)}


def test_sets(frame):
    one = lambda xs: frame([(x,) for x in xs], "k string")
    got = {r["k"]: r["region"] for r in sets.set_asymmetry(one("abb"), one("bc"), one("abcd"), "k").collect()}
    assert got == {"a": "a_only", "b": "both", "c": "b_only", "d": "c_only"}
    u = sets.union_dedup([frame([("x", 1), ("", 2)], "k string, v int"), frame([("x", 3), ("y", 4)], "k string, v int")], "k")
    assert sorted((r["k"], r["v"]) for r in u.collect()) == [("x", 1), ("y", 4)]
    w = sets.union_with_defaults([frame([("a", 1)], "p string, w int"), frame([("b", 2)], "p string, m int")], ("p", "w", "m"), ("w", "m"))
    assert sorted(tuple(r) for r in w.collect()) == [("a", 1, 0), ("b", 0, 2)]


def test_joins_with_order(frame):
    df = frame([("u1",), ("u2",)], "url string")
    labels = frame([("u1", "a", 1), ("u1", "b", 2)], "url string, label string, pos int")
    assert {r["url"]: r["label"] for r in joins.merge_labels(df, labels, ["pos"]).collect()} == {"u1": "b", "u2": "no_signal"}
    assert joins.merge_labels(df, labels, ["pos"], drop_unmatched=True).count() == 1
    big = frame([("u1", "first", 1), ("u1", "", 2), ("", "x", 3)], "url string, abstract string, pos int")
    assert joins.attach_last(df, big, "url", ["abstract"], ["pos"]).where("url = 'u1'").first()["abstract"] == "first"
    p = frame([(1, ["i1", "i2"]), (2, ["i3"]), (3, [])], "id int, issn array<string>")
    src = frame([("i1", 5, "first"), ("i2", 5, "second"), ("i3", None, "third")], "issn_ string, h int, name string")
    got = {r["id"]: r["name"] for r in joins.best_source(p, src, "id", "issn", "issn_", "h", ["name"]).collect()}
    assert got == {1: "first", 2: "third", 3: None}, "the first key wins a tie"
    v = joins.coalesce_sources(frame([("a",), ("b",), ("c",)], "k string"), [("one", frame([("a", 1)], "k string, v int")), ("two", frame([("a", 2), ("b", 3)], "k string, v int"))], "k", "v")
    assert {r["k"]: (r["v"], r["origin"]) for r in v.collect()} == {"a": (1, "one"), "b": (3, "two"), "c": (None, "unreachable")}


SQUARE = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]]
HOLE = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0]]
TRI = [[10.0, 0.0], [12.0, 0.0], [11.0, 3.0], [10.0, 0.0]]


def test_points_in_polygons_against_brute_force(frame):
    polys = frame([(1, "Polygon", [[SQUARE, HOLE]]), (2, "MultiPolygon", [[TRI], [SQUARE]]), (3, "Point", None), (4, "Polygon", [[]])],
                  "pid int, type string, polygons array<array<array<array<double>>>>")
    pts = [(i, (i % 27) * 0.5 - 0.3, (i // 27) * 0.5 - 0.3) for i in range(27 * 10)]
    got = {(r["id"], r["pid"]) for r in geo.points_in_polygons(frame(pts, "id int, x double, y double"), geo.polygon_parts(polys, "pid"), "id", "pid").collect()}

    def inside(p, corners):
        """Convex corner lists: the point is on the same side of every edge."""
        turns = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for a, b in zip(corners, corners[1:] + corners[:1]) if a != b]
        return all(t > 0 for t in turns) or all(t < 0 for t in turns)

    square, hole, tri = ({i for i, *p in pts if inside(p, shape)} for shape in (SQUARE, HOLE, TRI))
    want = {(i, 1) for i in square - hole} | {(i, 2) for i in square | tri}
    assert got == want and len(want) > 50


def test_closure_with_a_cycle(frame):
    e = frame([("b", "a"), ("c", "b"), ("d", "b"), ("a", "c"), ("x", "y")], "child string, parent string")
    got = {(r["node"], r["depth"]) for r in graph.closure(e, frame([("a",)], "root string")).collect()}
    assert got == {("b", 1), ("c", 2), ("d", 2)}
