"""Queries that go through files: readers, writers and streams.

Inputs are written from the given tables into the shared checkpoint folder,
read back with the reader under test, and compared with the tables themselves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelens.operators import aggregates as ag
from framelens.operators import classify as cl
from framelens.operators.scale import checkpoint_root
from framelens.plans.registry import Tables, query, with_records
from framelens.plans.text_queries import CLS, LEX, W, classified
from framelens.sources import readers, writers
from framelens.streaming import streams


def folder(t: Tables, name: str) -> str:
    return f"{checkpoint_root(t.spark)}/{name}-{uuid.uuid4().hex}"


def shards(t: Tables) -> str:
    """Documents as gzipped JSON lines in four shard folders; French lines are cut, Spanish ones lack a text."""
    row = F.to_json(F.struct("text", F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("url"), F.col("doc_id").alias("timestamp")))
    line = F.when(F.col("lang") == "fr", F.concat(F.left(row, F.lit(20)))).when(F.col("lang") == "es", F.lit('{"url": "x"}')).otherwise(row)
    path = folder(t, "shards")
    t.documents.select(line.alias("value"), (F.col("doc_id") % 4).alias("shard")).write.partitionBy("shard").option("compression", "gzip").text(path)
    return path


def shard_files(t: Tables, **kw) -> DataFrame:
    return readers.read_corpus(t.spark, shards(t) + "/shard=*", with_file="path", **kw)


@query("src_01_read_corpus", "SELECT count(*) AS total, count(*) FILTER (lang IN ('fr', 'es')) AS errors FROM documents")
def _(t):
    return readers.corpus_counts(readers.read_corpus(t.spark, shards(t) + "/shard=*", keep_bad=True), by=[])


@query("src_02_with_file", "SELECT 'shard=' || (doc_id % 4) AS shard, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents WHERE lang NOT IN ('fr', 'es') GROUP BY 1")
def _(t):
    d = shard_files(t).withColumn("shard", F.regexp_extract("file", "(shard=[0-9]+)", 1))
    return d.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("src_03_select_shards", "SELECT 'range' AS mode, 'https://' || source || '.example.org/' || doc_id AS url FROM documents WHERE lang NOT IN ('fr', 'es') AND doc_id % 4 IN (1, 2) UNION ALL SELECT 'list', 'https://' || source || '.example.org/' || doc_id FROM documents WHERE lang NOT IN ('fr', 'es') AND doc_id % 4 IN (0, 3)")
def _(t):
    d = shard_files(t)
    a = readers.select_shards(d, 1, 3, pattern="shard=([0-9]+)").select(F.lit("range").alias("mode"), "url")
    return a.unionByName(readers.select_shards(d, ids=[0, 3], pattern="shard=([0-9]+)").select(F.lit("list").alias("mode"), "url"))


@query("src_04_count_errors", "SELECT doc_id % 4 AS shard, count(*) AS total, count(*) FILTER (lang IN ('fr', 'es')) AS errors FROM documents GROUP BY 1")
def _(t):
    d = shard_files(t, keep_bad=True).withColumn("shard", F.regexp_extract("file", "shard=([0-9]+)", 1).cast("long"))
    return readers.corpus_counts(d, by=["shard"])


@query("src_05_read_jsonl", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations WHERE role <> 'system'")
def _(t):
    row = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    path = folder(t, "jsonl")
    t.conversations.select(F.when(F.col("role") == "system", F.concat(F.lit("{bad "), row)).otherwise(row).alias("value")).write.text(path)
    d = readers.read_jsonl(t.spark, path, "conv_id long, turn long, role string, text string")
    return d.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("src_06_read_csv", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(t):
    path = folder(t, "csv")
    cols = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]
    writers.write_csv(t.customer, path, cols)
    return readers.read_csv(t.spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


@query("src_07_headerless_csv", "SELECT p_name AS name, p_type AS kind, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand || ', \"x\"' END AS remarks FROM part")
def _(t):
    path = folder(t, "registry")
    rows = t.part.select("p_name", "p_type", F.when(F.col("p_partkey") % 3 != 0, F.concat("p_brand", F.lit(', "x"'))).alias("r"))
    rows.write.option("header", False).option("escape", '"').csv(path)
    return readers.read_registry_csv(t.spark, path, 3).select(F.col("c0").alias("name"), F.col("c1").alias("kind"), "remarks")


@query("src_08_directory", "SELECT p_name AS domain, arg_max(p_brand, p_partkey) AS origin, arg_max(p_type, p_partkey) AS type, arg_max('a' || chr(9) || p_size, p_partkey) AS path FROM part GROUP BY p_name")
def _(t):
    path = folder(t, "directory")
    line = F.concat_ws("\t", "p_name", "p_brand", "p_type", F.lit("a"), F.col("p_size").cast("string"))
    t.part.orderBy("p_partkey").select(line.alias("value")).write.text(path)
    return readers.read_directory(t.spark, path)


@query("src_09_find_field", "SELECT 'tab' AS kind, p_partkey::VARCHAR AS field FROM part WHERE contains(p_name, 'bolt') UNION ALL SELECT 'pipe', p_brand FROM part WHERE p_size::VARCHAR LIKE '4%'")
def _(t):
    tab, pipe = folder(t, "tab"), folder(t, "pipe")
    t.part.select(F.concat_ws("\t", F.col("p_partkey").cast("string"), F.upper("p_name"), F.lit("z")).alias("value")).write.text(tab)
    t.part.select(F.concat_ws("|", F.col("p_size").cast("string"), "p_name", "p_brand").alias("value")).write.text(pipe)
    a = readers.find_field(t.spark, tab, "bolt", "\t").select(F.lit("tab").alias("kind"), "field")
    return a.unionByName(readers.find_field(t.spark, pipe, "4", "|", -1, prefix=True).select(F.lit("pipe").alias("kind"), "field"))


@query("src_10_manifests", "SELECT 'orders' AS name, true AS available, (SELECT count(*) FROM orders) AS n UNION ALL SELECT 'parts', true, (SELECT count(*) FROM part) UNION ALL SELECT 'absent', false, NULL")
def _(t):
    paths = {"absent": folder(t, "absent") + "/manifest.json"}
    for name, df in (("orders", t.orders), ("parts", t.part)):
        path = folder(t, name)
        df.agg(F.count("*").alias("n")).coalesce(1).write.json(path)
        paths[name] = f"{path}/*.json"
    return readers.read_manifests(t.spark, paths).select("name", "available", F.get_json_object("manifest", "$.n").cast("long").alias("n"))


@query("src_11_geojson", "SELECT s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'MultiPolygon' ELSE 'Point' END AS type, CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS n_polygons, CASE WHEN s_suppkey % 3 < 2 THEN s_acctbal END AS first_x FROM supplier")
def _(t):
    path = folder(t, "geojson")
    ring = F.concat(F.lit("[[["), F.col("s_acctbal").cast("string"), F.lit(",0.5],[1,2],[3,4.25]]]"))
    kind = F.col("s_suppkey") % 3
    geom = F.when(kind == 0, F.concat(F.lit('"Polygon","coordinates":'), ring)).when(
        kind == 1, F.concat(F.lit('"MultiPolygon","coordinates":['), ring, F.lit(",[[[9,9],[8,8],[7,7]]]]"))).otherwise(F.lit('"Point","coordinates":[1,2]'))
    feature = F.concat(F.lit(',{"type":"Feature","properties":{"name":"'), "s_name", F.lit('"},"geometry":{"type":'), geom, F.lit("}}"))
    f = t.supplier.select("s_nationkey", F.lit(1).alias("o"), feature.alias("value"))
    keys = t.supplier.select("s_nationkey").distinct()
    ends = keys.select("s_nationkey", F.lit(0).alias("o"), F.lit('{"features":[{"type":"Feature","properties":{}}').alias("value")).unionByName(
        keys.select("s_nationkey", F.lit(2).alias("o"), F.lit("]}").alias("value")))
    # One feature collection per nation, several lines each.
    lines = f.unionByName(ends).repartition("s_nationkey").sortWithinPartitions("s_nationkey", "o").drop("o")
    lines.write.partitionBy("s_nationkey").text(path)
    d = readers.read_geojson(t.spark, path + "/*/*").where(F.col("properties")["name"].isNotNull())
    return d.select(F.col("properties")["name"].alias("name"), "type", F.size("polygons").alias("n"), F.get(F.get(F.get(F.get("polygons", F.lit(0)), F.lit(0)), F.lit(0)), F.lit(0)).alias("first_x")).select(
        "name", "type", F.when(F.col("n") >= 0, F.col("n")).alias("n_polygons"), "first_x")


@query("snk_01_write_jsonl", "SELECT label, 2 * count(*) AS n FROM (" + W(CLS, "SELECT label FROM cls") + ") GROUP BY label")
def _(t):
    path = folder(t, "out")
    d = classified(t).select("url", "label", "score_a", "score_b")
    writers.write_jsonl(d, path, compression="gzip")
    writers.write_jsonl(d, path, compression="gzip")
    return readers.read_jsonl(t.spark, path, "url string, label string, score_a double, score_b double").groupBy("label").agg(F.count("*").alias("n"))


@query("agg_06_per_file", W(CLS, "SELECT 'documents.parquet' AS file, label, count(*) AS n FROM cls GROUP BY label"))
def _(t):
    path = folder(t, "counted")
    named = t.documents.withColumn("url", F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string"))).withColumn("file", F.col("_metadata.file_name"))
    rows = cl.classify(named, LEX).select("file", "url", "label", "score_a", "score_b")
    return writers.write_counted(rows, ["file", "label"], lambda d: writers.write_jsonl(d, path))


@query("snk_02_write_dataset", "SELECT vec_id, label, len(embedding)::BIGINT AS n, true AS is_text FROM embeddings")
def _(t):
    path = folder(t, "dataset")
    writers.write_dataset(t.embeddings, path)
    d = t.spark.read.schema("vec_id long, embedding string, label int").parquet(path)
    return d.select("vec_id", "label", F.size(F.from_json("embedding", "array<float>")).cast("long").alias("n"), F.startswith("embedding", F.lit("[")).alias("is_text"))


@query("snk_03_write_csv", with_records("findings", "SELECT platform, category, status, event_id FROM findings"))
def _(t):
    path = folder(t, "findings")
    writers.write_csv(t.derived("findings"), path, ["platform", "category", "status", "event_id"], ["category", "platform", "event_id"])
    return readers.read_csv(t.spark, path, "platform string, category string, status string, event_id long")


@query("snk_04_summary", W(CLS, """SELECT count(*) AS total, (SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM (SELECT label, count(*) AS n FROM cls GROUP BY label)) AS label,
  (SELECT string_agg(lang || '=' || n, ',' ORDER BY lang) FROM (SELECT lang, count(*) AS n FROM cls GROUP BY lang)) AS lang FROM cls"""))
def _(t):
    d = ag.summary_row(classified(t), ["label", "lang"])
    text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)
    return d.select("total", text("label"), text("lang"))


@query("snk_04_summary_long", W(CLS, """SELECT 'label' AS dim, label AS k, count(*) AS n FROM cls GROUP BY label UNION ALL SELECT 'lang', lang, count(*) FROM cls GROUP BY lang
UNION ALL SELECT 'source', source, count(*) FROM cls GROUP BY source UNION ALL SELECT '(total)', '', count(*) FROM cls"""))
def _(t):
    return ag.summary_long(classified(t), ["label", "lang", "source"])


@query("snk_05_write_splits", "SELECT 'full' AS split, count(*) AS n, sum(p_size)::BIGINT AS size FROM part UNION ALL SELECT 'verified', count(*), sum(p_size)::BIGINT FROM part WHERE p_brand = 'Brand#3'")
def _(t):
    path = folder(t, "splits")
    writers.write_splits(t.part, path, F.col("p_brand") == "Brand#3")
    read = lambda s: t.spark.read.schema(t.part.schema).parquet(f"{path}/{s}").agg(F.lit(s).alias("split"), F.count("*").alias("n"), F.sum("p_size").alias("size"))
    return read("full").unionByName(read("verified"))


def _stream(t: Tables, table: str, schema: T.StructType) -> DataFrame:
    """A table as a stream, be it one file or a folder of files: Spark streams a single file only by a path with a wildcard."""
    return streams.file_stream(t.spark, f"{t.sf_dir}/{table}.parque[t]", schema, "parquet")


@query("str_01_classify_stream", W(CLS, "SELECT doc_id, label, framing_type, score_a, score_b FROM cls"))
def _(t):
    out, ckpt = folder(t, "classified"), folder(t, "ckpt")
    d = _stream(t, "documents", t.documents.schema).withColumn("url", F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string")))
    for _run in range(2):  # the second run finds nothing new
        streams.drain(lambda: streams.classify_stream(d, LEX, out, ckpt))
    return t.spark.read.parquet(out).select("doc_id", "label", "framing_type", "score_a", "score_b")


@query("str_02_skip_seen", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def _(t):
    out = folder(t, "seen")
    d = _stream(t, "events", t.events.schema).select("event_id", "user_id", "event_type")
    for _run in range(2):  # a second query over the same input: every key is known already
        ckpt = folder(t, "ckpt")
        streams.drain(lambda: streams.skip_seen(d, ["user_id", "event_type"], out, ckpt, ["event_id"]))
    return t.spark.read.parquet(out).select("user_id", "event_type", "event_id")


@query("str_03_running_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    out = folder(t, "running")
    streams.run_to_table(streams.running_counts(_stream(t, "events", t.events.schema), ["event_type"]), out, folder(t, "ckpt"), "complete")
    return t.spark.read.parquet(out)


@query("str_04_windowed_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    out = folder(t, "windowed")
    counts = streams.windowed_counts(_stream(t, "events", t.events.schema), "ts", "1 day", ["event_type"])
    streams.drain(lambda: streams.run_to_windows(counts, out, folder(t, "ckpt"), ["event_type"]))
    return t.spark.read.parquet(out).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
