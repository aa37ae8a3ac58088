"""Mechanisms for size: lazy lookups, long lexicons, state, grids, chains, one-pass aggregates, splittable readers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from framelens import Lexicon, Signal
from framelens.functions import pages, scoring, values
from framelens.operators import aggregates as ag
from framelens.operators import classify as cl
from framelens.operators import filters, geo, graph, joins, scale, sets, stats, windows
from framelens.sources import readers, writers
from framelens.streaming import streams


def jobs(spark, build):
    """What ``build`` returns and the number of jobs it ran."""
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    out = build()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def scans(df):
    """File scans that really ran: no plan from before the run counts, and a reused exchange has none below it."""
    df.collect()
    n, skip = 0, None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-|"))
        if skip is not None and at < skip:
            skip = None
        if skip is None and "== Initial Plan ==" in line:
            skip = at
        n += skip is None and "FileScan" in line
    return n


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "t")
    d = spark.range(3000).select("id", (F.col("id") % 7).cast("string").alias("a"), F.when(F.col("id") % 3 > 0, (F.col("id") % 5).cast("string")).alias("b"),
                                 F.concat_ws(" ", F.lit("alpha"), (F.col("id") % 11).cast("string")).alias("text"))
    d.write.parquet(path)
    return path


# ---- lookups --------------------------------------------------------------


def test_lookups_run_nothing_while_the_plan_is_built(spark, stored, monkeypatch):
    left = spark.read.parquet(stored)
    right = left.groupBy("a").agg(F.max("id").alias("v"))
    for limit in (scale.BROADCAST_BYTES, 0):
        monkeypatch.setattr(scale, "BROADCAST_BYTES", limit)
        got, n = jobs(spark, lambda: scale.lookup_join(left, right, "a"))  # noqa: B023
        assert n == 0
        assert sorted(map(str, got.select("id", "v").collect())) == sorted(map(str, left.join(right, "a").select("id", "v").collect()))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_with_equal_rows(spark, how):
    """Half of the rows are one key and nothing else; pieces, salts and nulls keep every copy."""
    left = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise((F.col("id") % 9).cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("3", 3), (None, 4), ("x", 5)], "k string, v int")
    want = left.join(right, "k", how)
    got = scale.salted_join(left, right, "k", how, rows_per_salt=700)
    by = want.columns
    assert {tuple(r[:-1]): r[-1] for r in got.groupBy(*by).count().collect()} == {tuple(r[:-1]): r[-1] for r in want.groupBy(*by).count().collect()}


def test_salted_join_spreads_equal_rows_and_reads_once(spark, stored):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(50_000).select(F.lit("hot").alias("k"))
        right = spark.createDataFrame([("hot", 1)], "k string, v int")
        joined = scale.salted_join(left, right, "k", rows_per_salt=1000)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 50_000 and max(sizes) < 30_000
        files = spark.read.parquet(stored)
        big = spark.createDataFrame([(str(i), i) for i in range(7)], "a string, v int")
        assert scans(scale.salted_join(files, big, "a")) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup_index_returns_the_whole_first_entry(frame):
    index = frame([("a.org", [("A", ["l1"], ["X"]), ("B", ["l2"], ["Y"])])], "domain string, entries array<struct<entity_name string, datasets array<string>, country array<string>>>")
    got = joins.lookup_index(frame([("http://www.a.org/x",), ("http://b.org",)], "url string"), index, ()).collect()
    assert {r["url"]: (r["hit_domain"], r["entity_name"], r["datasets"], r["country"]) for r in got} == {
        "http://www.a.org/x": ("a.org", "A", ["l1"], ["X"]), "http://b.org": (None, None, None, None)}


# ---- scoring --------------------------------------------------------------


def test_scores_of_a_long_lexicon(spark):
    import re

    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(150)] + ["a[bc]", "c+", "b{2}", "aa|bb", "ш"]
    signals = tuple(Signal(w, "ab"[i % 2], 0.5 + i % 3) for i, w in enumerate(dict.fromkeys(words)))
    texts = ["".join(rng.choice("abc ш\n") for _ in range(rng.randint(0, 80))) for _ in range(200)] + [None, ""]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for mode, hit in (("presence", lambda p, t: bool(re.search(p, t))), ("occurrence", lambda p, t: len(re.findall(p, t)))):
        got = {r["id"]: (r["score_a"], r["score_b"]) for r in cl.with_scores(d, Lexicon(signals), mode=mode).collect()}
        for i, t in enumerate(texts):
            want = [sum(s.weight * hit(s.pattern, t or "") for s in signals if s.pole == p) for p in "ab"]
            assert got[i] == pytest.approx(tuple(want))


def test_no_generated_code_grows_with_the_lexicon(spark):
    d = spark.createDataFrame([("x",)], "text string").repartition(2)
    sizes = []
    for n in (100, 200):
        scored = cl.with_scores(d, Lexicon(tuple(Signal(f"word{i}", "ab"[i % 2], 1.0) for i in range(n))))
        sizes.append(scored._jdf.queryExecution().executedPlan().toString().lower().count("contains("))
    assert sizes[0] == sizes[1]


# ---- streams --------------------------------------------------------------


def progress(query):
    query.awaitTermination()
    return [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]


def test_seen_keys_are_state_not_history(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id long, k string"
    stream = lambda: streams.file_stream(spark, src, spark.createDataFrame([], schema).schema, "parquet")
    spark.range(2000).select("id", (F.col("id") % 500).cast("string").alias("k")).write.parquet(src)
    streams.drain(lambda: streams.skip_seen(stream(), ["k"], out, str(tmp_path / "one"), ["id"]))
    assert spark.read.parquet(out).count() == 500 and spark.read.parquet(out).agg(F.max("id")).first()[0] == 499
    read = []
    for step in range(3):
        spark.createDataFrame([(10_000 + step, "7"), (20_000 + step, f"new{step}"), (30_000 + step, None)], schema).write.mode("append").parquet(src)
        got = progress(streams.skip_seen(stream(), ["k"], out, str(tmp_path / "one"), ["id"]))
        read.append(sum(p["numInputRows"] for p in got))
    assert read == [3, 3, 3], "a batch reads its own rows only"
    rows = spark.read.parquet(out)
    assert rows.count() == 504 and rows.where("k IS NULL").count() == 1
    # A fresh checkpoint knows what the other one wrote.
    streams.drain(lambda: streams.skip_seen(stream(), ["k"], out, str(tmp_path / "two"), ["id"]))
    assert spark.read.parquet(out).count() == 504


def test_a_replayed_batch_writes_the_same_rows(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    schema = spark.createDataFrame([], "id long, k string").schema
    start = lambda: streams.skip_seen(streams.file_stream(spark, src, schema, "parquet"), ["k"], out, ckpt, ["id"])
    for step in range(2):
        spark.createDataFrame([(step, "a"), (10 + step, f"b{step}")], schema).write.mode("append").parquet(src)
        streams.drain(start)
    before = sorted(map(str, spark.read.parquet(out).collect()))
    commits = sorted((tmp_path / "ckpt/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (commits[-1], tmp_path / "ckpt/commits" / f".{commits[-1].name}.crc"):
        p.unlink(missing_ok=True)
    streams.drain(start)
    assert sorted(map(str, spark.read.parquet(out).collect())) == before


def test_windows_are_dropped_from_state_and_stay_in_the_table(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    schema = spark.createDataFrame([], "ts timestamp, k string").schema
    rows, state = {}, []
    for step, day in enumerate((1, 1, 2, 20, 21)):
        batch = [(f"2024-01-{day:02d} 0{i % 9}:00:00", "xyz"[(i + step) % (2 + step % 2)]) for i in range(8)] + [(None, "x")]
        spark.createDataFrame(batch, "ts string, k string").select(F.col("ts").cast("timestamp").alias("ts"), "k").write.mode("append").parquet(src)
        for ts, k in batch:
            if ts:
                rows[ts[:10], k] = rows.get((ts[:10], k), 0) + 1
        counts = streams.windowed_counts(streams.file_stream(spark, src, schema, "parquet"), "ts", "1 day", ["k"], "2 days")
        got = progress(streams.run_to_windows(counts, out, ckpt, ["k"]))
        state += [p["stateOperators"][0]["numRowsTotal"] for p in got if p["stateOperators"]]
        table = spark.read.parquet(out)
        assert {(str(r["window_start"])[:10], r["k"]): r["n"] for r in table.collect()} == rows, f"batch {step}"
    assert state[-1] < max(state) and state[-1] < len(rows), "old windows leave the state"


# ---- grid and chains ------------------------------------------------------


def test_thin_and_tiny_boxes_lie_in_few_cells(spark):
    rng = random.Random(3)
    boxes = [(0, -1000.0, 1000.0, 0.0, 0.1), (1, 0.0, 1e-7, -500.0, 500.0), (2, 5.0, 5.0, 5.0, 5.0), (3, -1e6, 1e6, -1e6, 1e6), (4, 1e9, 1e9 + 1e-3, 0.0, 1.0)]
    boxes += [(i, x, x + 10 ** rng.uniform(-6, 4), y, y + 10 ** rng.uniform(-6, 4)) for i, x, y in ((5 + i, rng.uniform(-999, 999), rng.uniform(-999, 999)) for i in range(60))]
    polys = [(i, "Polygon", [[[[a, c], [b, c], [b, d], [a, d]]]]) for i, a, b, c, d in boxes]
    parts = geo.polygon_parts(spark.createDataFrame(polys, "pid int, type string, polygons array<array<array<array<double>>>>"), "pid")
    points = [(i, rng.uniform(-1000, 1000), rng.uniform(-1000, 1000)) for i in range(500)] + [(1000 + i, (a + b) / 2, (c + d) / 2) for i, a, b, c, d in boxes]
    got = geo.points_in_polygons(spark.createDataFrame(points, "id int, x double, y double"), parts, "id", "pid")
    want = {(i, p) for i, x, y in points for p, a, b, c, d in boxes if a <= x < b and c <= y < d}
    assert {(r["id"], r["pid"]) for r in got.collect()} == want and len(want) > 60
    b = parts.select(geo._box(F.get(F.col("rings"), F.lit(0))).alias("b")).select("b.*").withColumns({"lx": geo._level("x0", "x1"), "ly": geo._level("y0", "y1")})
    cells = b.select((F.size(F.sequence(geo._cell("x0", "lx"), geo._cell("x1", "lx"))) * F.size(F.sequence(geo._cell("y0", "ly"), geo._cell("y1", "ly")))).alias("n"))
    assert cells.agg(F.max("n")).first()[0] <= 9


def breadth_first(edges, roots, limit=None):
    below = {}
    for child, parent in edges:
        below.setdefault(parent, set()).add(child)
    out = set()
    for root in roots:
        seen, level, depth = {root}, {root}, 0
        while level and (limit is None or depth < limit):
            level = {c for n in level for c in below.get(n, ())} - seen
            depth += 1
            seen |= level
            out |= {(root, n, depth) for n in level}
    return out


@pytest.mark.parametrize("plain", [0, 2])
def test_closure_of_chains_trees_and_rings(spark, plain):
    rng = random.Random(plain)
    edges = [(i + 1, i) for i in range(40)] + [(100 + i, rng.choice([20, 100 + i // 2])) for i in range(1, 25)] + [(5, 30), (200, 201), (201, 200), (300, 40), (301, 300), (40, 40), (None, 3), (7, None)]
    roots = [0, 10, 100, 200, 999]
    d, r = spark.createDataFrame(edges, "child long, parent long"), spark.createDataFrame([(x,) for x in roots], "root long")
    known = [(c, p) for c, p in edges if c is not None and p is not None]
    for limit in (None, 9):
        got = {tuple(x) for x in graph.closure(d, r, max_depth=limit, plain_levels=plain).select("root", "node", "depth").collect()}
        assert got == breadth_first(known, roots, limit)


def test_a_chain_of_a_thousand_takes_few_rounds(spark, monkeypatch):
    written = []
    plain = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name="step": written.append(name) or plain(df, name))
    edges = spark.range(1000).select((F.col("id") + 1).alias("child"), F.col("id").alias("parent"))
    got = graph.closure(edges, spark.range(1).select(F.col("id").alias("root")))
    assert got.count() == 1000 and got.agg(F.max("depth")).first()[0] == 1000
    assert len(written) < 40


# ---- positions and ranks --------------------------------------------------


def test_sensitivity_of_a_small_table_runs_one_job_when_asked(spark):
    d = spark.createDataFrame([(i, float(i), float(i * i % 7), None if i % 2 else float(-i)) for i in range(12)], "m int, p double, x double, y double")
    small, n = jobs(spark, lambda: stats.sensitivity(d, "p", ["x", "y", "p"], "m", few=True))
    assert n == 0
    large = stats.sensitivity(d, "p", ["x", "y", "p"], "m")
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    got = {r["metric"]: (r["n"], r["rho"]) for r in small.collect()}
    assert got["p"] == (12, 1.0) and got["y"] == (6, -1.0)
    assert stats.rank_correlations(d.withColumn("z", F.lit(None).cast("double")), "p", ["z"], "m", few=True) == [("z", 0, None)]


# ---- one pass -------------------------------------------------------------


def test_totals_come_from_the_same_pass(spark, stored):
    d = spark.read.parquet(stored)
    cross = ag.crosstab(d, "a", "b")
    assert scans(cross) == 1 and sum(r["n"] for r in cross.collect()) == 3000
    themed = ag.theme_summary(d.withColumn("groups", F.when(F.col("id") % 2 == 0, F.array("a", "b")).otherwise(F.array().cast("array<string>"))), "a", "b")
    assert scans(themed) == 1
    assert {r["tally"]: r["n"] for r in themed.collect() if r["tally"] == "all"} == {"all": 1500}
    rates = ag.rate_split(
        d.withColumns({"hit": F.col("b") == "1", "anyg": F.col("b").isNotNull()}), F.col("a") == "1", "hit", "anyg", F.col("id") < 100)
    assert scans(rates) == 1 and rates.first()["docs_x"] + rates.first()["docs_y"] == 3000
    firsts = ag.funnel_of_firsts(d, "text", ["id"], [("even", F.col("id") % 2 == 0), ("small", F.col("id") < 5)])
    assert scans(firsts) == 1 and tuple(firsts.first()) == (3000, 11, 6, 3)
    top = ag.top_nested(d, "b", "a", 2)
    assert scans(top) == 1 and [r["b"] for r in top.collect()][0] is None and top.collect()[0]["total"] == 1000
    assert scans(windows.dedup_first(d, ["b"], [F.col("id")], keep_blank=True)) == 1


def test_dedup_keeps_every_blank_row(spark):
    d = spark.createDataFrame([("k", 1), ("k", 2), ("", 3), ("", 3), (None, 4), (None, 4), (" ", 5)], "k string, n int")
    for order in ([F.col("n")], [F.col("n").desc()]):
        got = sorted(r["n"] for r in windows.dedup_first(d, ["k"], order, keep_blank=True).collect())
        assert got in ([1, 3, 3, 4, 4, 5], [2, 3, 3, 4, 4, 5])


def test_summaries(spark):
    d = spark.range(2000).select((F.col("id") % 1500).alias("k"), F.lit(None).cast("string").alias("e"))
    long = {(r["dim"], r["k"]): r["n"] for r in ag.summary_long(d, ["k", "e"]).collect()}
    assert len(long) == 1502 and long["(total)", ""] == 2000 and long["e", "(none)"] == 2000 and long["k", "3"] == 2
    row = ag.summary_row(d, ["k", "e"], top=10).first()
    assert row["total"] == 2000 and row["k"]["(other)"] == 1980 and len(row["k"]) == 11 and row["e"] == {"(none)": 2000}


def test_cohorts_of_several_former_states(spark):
    claims = spark.createDataFrame([(1, "S"), (1, "E"), (2, "E"), (3, "X"), (4, None)], "person int, country string").selectExpr("*", "cast(null as date) start", "cast(null as date) end", "cast(null as date) death")
    facts = ag.person_facts(claims, "A", "B", {"union": ("S",), "empire": ("E",)}, "1997-01-01")
    row = ag.cohort_summary(facts, ("1991-01-01", "1999-01-01"), ("union", "empire")).first()
    assert (row["union_only"], row["empire_only"], row["other"], row["missing"]) == (1, 1, 1, 1)


def test_manifests_and_their_totals(spark, tmp_path):
    got = {r["name"]: tuple(r)[1:] for r in sets.master_summary({"a": spark.createDataFrame([(2,), (3,)], "findings long"), "e": spark.createDataFrame([], "findings long"), "x": None}).select(
        "name", "available", "rows", "total", "n_available").collect()}
    assert got == {"a": (True, 2, 5, 1), "e": (True, 0, 0, 1), "x": (False, 0, 0, 0), "(all)": (False, 2, 5, 2)}
    for n in ("one", "two"):
        (tmp_path / f"{n}.json").write_text(f'{{"n": "{n}"}}')
    read = readers.read_manifests(spark, {"m": str(tmp_path / "*.json"), "gone": str(tmp_path / "no/manifest.json"), "empty": str(tmp_path / "x*.json")}).collect()
    assert sorted((r["name"], r["available"], r["file"]) for r in read if r["file"]) == [("m", True, "one.json"), ("m", True, "two.json")]
    assert sorted((r["name"], r["available"]) for r in read if not r["file"]) == [("empty", False), ("gone", False)]


def test_search_results_are_unique_before_the_filter(spark):
    a = spark.createDataFrame([("i1", "Elsewhere", "x"), ("i2", "Isle college", "")], "id string, name string, city string")
    b = spark.createDataFrame([("i1", "Isle school", "x"), ("i3", "", "isle"), ("", "Isle", "")], "id string, name string, city string")
    assert sorted(r["id"] for r in filters.search_places([a, b], ["Isle"]).collect()) == ["i2", "i3"]


# ---- files ----------------------------------------------------------------


def test_counters_are_observed_while_writing(spark, stored, tmp_path):
    d = spark.read.parquet(stored).withColumn("file", F.col("_metadata.file_name"))
    got, n = jobs(spark, lambda: writers.write_counted(d.select("file", "a", "id"), ["file", "a"], lambda x: writers.write_jsonl(x, str(tmp_path / "out"))))
    assert n == 1, "the write is the only job"
    want = {(r["file"], r["a"]): r["count"] for r in d.groupBy("file", "a").count().collect()}
    assert {(r["file"], r["a"]): r["n"] for r in got.collect()} == want
    assert spark.read.json(str(tmp_path / "out")).columns == ["a", "file", "id"]
    with pytest.raises(ValueError, match="more than"):
        writers.write_counted(d.select("id"), ["id"], lambda x: writers.write_jsonl(x, str(tmp_path / "many")), groups=5)


def test_large_text_files_are_read_by_several_tasks(spark, tmp_path):
    d = spark.range(3000).select("id", F.concat(F.lit('say "x", '), F.col("id").cast("string")).alias("s")).coalesce(1)
    writers.write_csv(d, str(tmp_path / "csv"), ["id", "s"])
    feature = F.concat(F.lit('{"type":"Feature","properties":{"n":"'), F.col("id").cast("string"), F.lit('"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}}'))
    d.select(F.concat(F.when(F.col("id") % 2 == 0, F.lit("\x1e")).otherwise(F.lit("")), feature).alias("value")).write.text(str(tmp_path / "geo"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        csv = readers.read_csv(spark, str(tmp_path / "csv"), "id long, s string")
        geojson = readers.read_geojson(spark, str(tmp_path / "geo"), lines=True)
        assert csv.rdd.getNumPartitions() > 2 and geojson.rdd.getNumPartitions() > 2
        assert csv.count() == 3000 and csv.where("s = concat('say \"x\", ', id)").count() == 3000
        assert geojson.count() == 3000 and geojson.where("size(polygons) = 1 AND type = 'Polygon' AND properties['n'] IS NOT NULL").count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_with_line_breaks_when_asked(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a\nb "q"'), (2, "c")], "id int, s string")
    writers.write_csv(d, str(tmp_path / "csv"), ["id", "s"])
    got = readers.read_csv(spark, str(tmp_path / "csv"), "id int, s string", multi_line=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, d.collect()))


# ---- pages and values -----------------------------------------------------


@pytest.mark.parametrize("html, want", [
    ('<div class="x breadcrumb"><div>A</div> <div>B <div>C</div></div></div><div>D</div>', "A B C"),
    ("<nav class='breadcrumb \"q\"'>A &amp; <b>B</b></nav>C", "A & B"),
    ('<nav aria-label="The BreadCrumb">A</nav>', "A"),
    ('<nav aria-label="breadcrumb">A</nav><ol class="breadcrumb"><li>B<li>C</ol>D', "B C"),
    ('<p data-class="breadcrumb">A</p>', ""),
    ('<p title="a > b" class=breadcrumbs>A</p>B', "A"),
    ('<div><span class="breadcrumb">A</i></div>B', "A"),
    ('<div class="breadcrumb">A<br>B<img src="x"/>C<!-- </div> --><script>"</div>"</script>D</div>E', "A B C D"),
    ('<img class="breadcrumb">A', ""),
    ("<ul class=breadcrumb><li>A", "A"),
    ('<script type="application/ld+json">{"@type":"BreadcrumbList"}</script><ol class="breadcrumb">A</ol>', '{"@type":"BreadcrumbList"}'),
    ("<div class=Breadcrumb>A</div>", ""), (None, ""), ("", ""), ("a < b breadcrumb", ""),
])
def test_breadcrumbs(spark, html, want):
    assert spark.createDataFrame([(html,)], "h string").select(pages.breadcrumb(F.col("h"))).first()[0] == want


def test_word_positions_round_trip(spark):
    rows = [(["b", "a", "b", "c", "a", "b"],), ([],), (["x"],), (None,)]
    d = spark.createDataFrame(rows, "w array<string>").select("w", values.word_positions(F.col("w")).alias("m"))
    got = [r["m"] for r in d.collect()]
    assert got[:3] == [{"a": [1, 4], "b": [0, 2, 5], "c": [3]}, {}, {"x": [0]}]
    assert [r[0] for r in d.select(values.rebuild_text(F.col("m"))).collect()][:3] == ["b a b c a b", "", "x"]


def test_status_rules(spark):
    d = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (0, 2, 0), (0, 0, 0), (1, 1, 0)], "a int, b int, x int")
    assert [r[0] for r in d.select(scoring.encoding_status(F.col("a"), F.col("b"), F.col("x"))).collect()] == ["incorrect", "correct", "incorrect", "na", "na"]


def test_expensive_columns_of_distinct_keys(spark):
    d = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") % 2).alias("j"), "id")
    got = scale.compute_distinct(d, ["k", "j"], {"x": F.col("k") * 10 + F.col("j")})
    assert sorted((r["k"], r["j"], r["x"]) for r in got.collect()) == [(k, j, 10 * k + j) for k in range(3) for j in range(2)]
    assert got.agg(F.sum("n")).first()[0] == 1000 and got.columns == ["k", "j", "n", "x"]


def test_rows_of_one_row_group_are_dealt_when_asked(spark):
    lex = Lexicon((Signal("a", "a", 1.0), Signal("b", "b", 1.0)))
    d = spark.createDataFrame([(i, "ab"[i % 2], None) for i in range(100)], "id int, text string, url string").coalesce(1)
    for build in (lambda p: cl.with_scores(d, lex, partitions=p), lambda p: cl.classify(d, lex, partitions=p)):
        assert build(None).rdd.getNumPartitions() == 1 and build(5).rdd.getNumPartitions() == 5
        same = [sorted((r["id"], r["score_a"], r["score_b"]) for r in build(p).collect()) for p in (None, 5)]
        assert same[0] == same[1]
