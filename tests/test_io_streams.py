"""Files in, files out, and streams over dropped files."""

import gzip
import json

from pyspark.sql import functions as F

from framelens.lexicon import Lexicon, Signal
from framelens.operators import aggregates as ag
from framelens.plans import census
from framelens.sources import readers, writers
from framelens.streaming import streams

LEX = Lexicon((Signal("alpha", "a", 1.0), Signal("beta", "b", 1.0)))


def test_corpus_reader(spark, tmp_path):
    with gzip.open(tmp_path / "c4-00001-of-2.json.gz", "wt", encoding="utf-8") as f:
        f.write('{"text": "крым", "url": "u1", "timestamp": {"t": 1}}\n{"text": 3\n\n{"url": "u2"}\n')
    (tmp_path / "c4-00002-of-2.json").write_text('{"text": "x"}\n')
    d = readers.read_corpus(spark, str(tmp_path / "c4-*"), with_file=True, keep_bad=True)
    assert {r["file"]: (r["total"], r["errors"]) for r in readers.corpus_counts(d).collect()} == {
        "c4-00001-of-2.json.gz": (3, 2), "c4-00002-of-2.json": (1, 0)}
    good = readers.read_corpus(spark, str(tmp_path / "c4-*"), with_file=True)
    shard = "c4-([0-9]+)"
    assert sorted((r["text"], r["url"]) for r in good.collect()) == [("x", ""), ("крым", "u1")]
    assert readers.select_shards(good, 2, pattern=shard).count() == 1 and readers.select_shards(good, ids=[1], pattern=shard).count() == 1


def test_directory_and_lines(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("a.com\tint\tnews\tp\tq\nb.com\tint\na.com\tint\ttech\n")
    got = readers.read_directory(spark, str(tmp_path / "d.tsv")).collect()
    assert [(r["domain"], r["type"], r["path"]) for r in got] == [("a.com", "tech", None)]
    (tmp_path / "z.tab").write_text("# Isle\nAA,BB\tx\tEurope/Isle \n")
    r = readers.find_field(spark, str(tmp_path / "z.tab"), "isle", "\t", skip="#").collect()
    assert [(x["field"], x["line"]) for x in r] == [("AA,BB", "AA,BB\tx\tEurope/Isle")]


def test_csv_and_jsonl(spark, tmp_path):
    (tmp_path / "r.csv").write_text('"N, M",ind,x,"POB Isle; a"\nO,ent,,\n')
    got = readers.read_registry_csv(spark, str(tmp_path / "r.csv"), 4).collect()
    assert [r["remarks"] for r in got] == ["POB Isle; a", "ent"]
    (tmp_path / "j.jsonl").write_text('{"a": 1}\nbad\n\n{"a": 2}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "j.jsonl"), "a int").count() == 2
    assert readers.read_jsonl(spark, str(tmp_path / "j.jsonl"), "a int", limit=1).count() == 1


def test_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text('{\n "n": 3\n}')
    d = readers.read_manifests(spark, {"m": str(tmp_path / "m.json"), "x": str(tmp_path / "x.json"), "y": str(tmp_path / "no" / "y.json")})
    assert {r["name"]: r["available"] for r in d.collect()} == {"m": True, "x": False, "y": False}


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([(1, ["a"], {"k": 1}), (2, None, None)], "id int, xs array<string>, m map<string,int>")
    writers.write_dataset(d, str(tmp_path / "ds"))
    back = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "ds")).collect()}
    assert json.loads(back[1]["m"]) == {"k": 1} and back[2]["xs"] is None
    writers.write_csv(d.select("id"), str(tmp_path / "csv"), ["id"], ["id"])
    assert readers.read_csv(spark, str(tmp_path / "csv"), "id int").count() == 2
    writers.write_splits(d, str(tmp_path / "sp"), F.col("id") == 2)
    assert spark.read.parquet(str(tmp_path / "sp/verified")).count() == 1
    writers.write_summary(ag.summary_row(d, ["id"]), str(tmp_path / "sum"))
    assert spark.read.json(str(tmp_path / "sum")).first()["total"] == 2


def test_summary_keeps_everything(spark):
    d = spark.range(10).select((F.col("id") % 4).alias("k"))
    r = ag.summary_row(d, ["k"], top=2).first()
    assert r["total"] == 10 and r["k"] == {"0": 3, "1": 3, "(other)": 4}


def test_classify_stream_is_exactly_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    d = spark.createDataFrame([(1, "alpha", "u"), (2, "beta", "v")], "id int, text string, url string")
    d.write.json(src)
    s = streams.file_stream(spark, src, d.schema)
    streams.drain(lambda: streams.classify_stream(s, LEX, out, ck))
    spark.createDataFrame([(3, "none", "w")], d.schema).write.mode("append").json(src)
    for _ in range(2):
        streams.drain(lambda: streams.classify_stream(s, LEX, out, ck))
    assert sorted((r["id"], r["label"]) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "b"), (3, "no_signal")]


def test_skip_seen_and_counts(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    d = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, k string")
    d.write.parquet(src)
    s = streams.file_stream(spark, src, d.schema, "parquet")
    streams.drain(lambda: streams.skip_seen(s, ["k"], out, ck, ["id"]))
    spark.createDataFrame([(4, "y"), (5, "z")], d.schema).write.mode("append").parquet(src)
    streams.drain(lambda: streams.skip_seen(s, ["k"], out, ck, ["id"]))
    assert sorted((r["k"], r["id"]) for r in spark.read.parquet(out).collect()) == [("x", 1), ("y", 3), ("z", 5)]


def test_dedup_within_watermark(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    d = spark.sql("SELECT * FROM VALUES ('x', TIMESTAMP_NTZ'2024-01-01 00:00:00'), ('x', TIMESTAMP_NTZ'2024-01-01 00:10:00'), ('y', TIMESTAMP_NTZ'2024-01-01 00:20:00') AS t(k, ts)")
    d.write.parquet(src)
    s = streams.dedup_within(streams.file_stream(spark, src, d.schema, "parquet"), ["k"], "ts", "1 hour")
    streams.drain(lambda: s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out))
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == ["x", "y"]


def test_article_framing_and_answer_scores(spark):
    web = spark.createDataFrame([(1, "T", "http://u", "<p>alpha isle</p><script>beta</script>"), (2, "T", "http://u", "<p>beta isle</p>"), (3, "X", "http://w", "<p>beta</p>")],
                                "pos int, title string, url string, html string")
    papers = spark.createDataFrame([(4, "P", "10.1/x", "beta isle beta", "J")], "pos int, title string, url string, text string, journal string")
    got = {r["pos"]: (r["label"], r["score_b"]) for r in census.article_framing({"web": web, "papers": papers}, LEX, "isle", ["pos"]).collect()}
    assert got == {1: ("a", 0.0), 4: ("b", 2.0)}
    a = spark.createDataFrame([("m", "q1", "en", "yes", "Yes"), ("m", "q2", "en", "yes", "No"), ("m", "q9", "en", "yes", "No")],
                              "model string, question_id string, language string, expected string, raw_answer string")
    o = spark.createDataFrame([("m", "en", "a", True, False)], "model string, language string, label string, has_a boolean, has_b boolean")
    r = census.answer_scores(a, o, {"q1": "D", "q2": "L"}, F.lit(False), ()).first()
    assert r["uniform"] == round(2 / 3, 4) and r["min"] == 0.0


def test_evidence(spark):
    d = spark.createDataFrame([("see 10.1234/ab. [1] et al. x", "http://a"), ("none", "https://arxiv.org/1"), ("none", "http://b")], "text string, url string")
    got = {r["url"]: (r["doi"], r["academic_domain"], r["citation_count"]) for r in census.evidence(d).collect()}
    assert got == {"http://a": ("10.1234/ab", None, 1), "https://arxiv.org/1": (None, "arxiv.org", 0)}
