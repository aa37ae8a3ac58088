"""Cases that once gave wrong rows."""

from pyspark.sql import functions as F

from framelens.operators import graph, scale
from framelens.streaming import streams


def test_salted_join_compares_typed_keys(spark):
    left = spark.range(1000).selectExpr("CAST(1 AS int) AS a", "'x' AS b", "id AS v")
    for kind in ("double", "decimal(10,2)", "bigint"):
        right = spark.createDataFrame([(1.0, "x", 7), (2.0, "y", 8)], "a double, b string, w int").withColumn("a", F.col("a").cast(kind))
        for how, n in (("inner", 1000), ("left", 1000), ("left_semi", 1000), ("left_anti", 0)):
            assert scale.salted_join(left, right, ["a", "b"], how).count() == left.join(right, ["a", "b"], how).count() == n


def test_equal_rows_take_all_salts(spark):
    left = spark.range(6400).selectExpr("'k' AS k")
    right = spark.createDataFrame([("k", 1)], "k string, w int")
    assert scale.salted_join(left, right, "k").count() == 6400


def test_skip_seen_keeps_distinct_keys_and_old_output(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a, b", "c", 1), ("a", "b, c", 2), (None, "x", 3), ("null", "x", 4), (None, "x", 5)]
    spark.createDataFrame(rows, "a string, b string, n long").coalesce(1).write.json(src)
    for ckpt in ("one", "two"):
        stream = streams.file_stream(spark, src, spark.createDataFrame([], "a string, b string, n long").schema)
        streams.drain(lambda: streams.skip_seen(stream, ["a", "b"], out, str(tmp_path / ckpt), ["n"]))  # noqa: B023
    assert sorted(r["n"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


def test_closure_reaches_every_level(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(12)], "child long, parent long")
    got = graph.closure(edges, spark.createDataFrame([(0,)], "root long"))
    assert got.count() == 12 and got.agg(F.max("depth")).first()[0] == 12
