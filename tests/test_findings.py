"""Tables of several files, counts before joins, trees below roots and the other cases that a review found."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelens.lexicon import Lexicon, Signal
from framelens.operators import aggregates as ag
from framelens.operators import classify as cl
from framelens.operators import graph
from framelens.plans import io_queries


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_of_one_or_several_files_is_streamed_whole(spark, tmp_path, files):
    d = spark.range(30).select("id", F.col("id").cast("string").alias("text")).repartition(files)
    d.write.parquet(f"{tmp_path}/t.parquet")
    tables = SimpleNamespace(spark=spark, sf_dir=str(tmp_path))
    if files == 1:
        (part,) = (tmp_path / "t.parquet").glob("part-*.parquet")
        tables.sf_dir = str(tmp_path / "one")
        (tmp_path / "one").mkdir()
        (tmp_path / "one" / "t.parquet").write_bytes(part.read_bytes())
    stream = io_queries._stream(tables, "t", d.schema)
    query = stream.writeStream.format("memory").queryName(f"whole_{files}").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["id"] for r in spark.table(f"whole_{files}").collect()) == list(range(30))


def test_trees_below_a_chain_take_few_rounds(spark, monkeypatch):
    """A chain whose every third node has leaves, own and shared ones, and a second parent far below."""
    written = []
    plain = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name="step": written.append(name) or plain(df, name))
    n = 240
    edges = [(i + 1, i) for i in range(n)] + [(1000 + i, i) for i in range(0, n, 3)] + [(2000 + i % 5, i) for i in range(0, n, 3)] + [(230, 100), (-1, -2), (-2, -1), (-3, -2)]
    got = graph.closure(spark.createDataFrame(edges, "child long, parent long"), spark.createDataFrame([(0,), (3,), (-1,)], "root long"), plain_levels=1)
    below = {}
    for child, parent in edges:
        below.setdefault(parent, []).append(child)
    want = set()
    for root in (0, 3, -1):
        seen, level, depth = {root}, {root}, 0
        while level:
            level, depth = {c for x in level for c in below.get(x, ())} - seen, depth + 1
            seen |= level
            want |= {(root, x, depth) for x in level}
    assert {tuple(r) for r in got.select("root", "node", "depth").collect()} == want
    assert len(written) < 30


def test_group_contrast_joins_counts(spark):
    rows = [("m1", "c1", True), ("m1", "c1", False), ("m1", "c3", True), ("m1", None, True), ("m2", "c3", None), ("m2", "c9", True), ("m3", "c9", True)] * 50
    answers = spark.createDataFrame(rows, "model string, city string, correct boolean")
    groups = spark.createDataFrame([("c1", "near"), ("c3", "far"), ("c3", "near")], "city string, grp string")
    got = ag.group_contrast(answers, groups, ["model"], "far", "near")
    cells = {r["model"]: (r["correct_far"], r["total_far"], r["correct_near"], r["total_near"], r["gap"]) for r in got.collect()}
    assert cells == {"m1": (50, 50, 100, 150, 33.3), "m2": (0, 50, 0, 50, 0.0)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Join") < plan.index("AS _total")


def test_plain_words_are_counted_in_one_pass(spark):
    """Words that begin other words, stand in them, overlap them or stand twice in the lexicon; only those that overlap themselves are counted one by one."""
    words = ["ab", "abc", "abcd", "bc", "cd", "d", "aba", "aa", "abab", "ш", "ab", "b 'c", "c\nd"]
    signals = tuple(Signal(w, "ab"[i % 2], 0.1 * (1 + i % 3)) for i, w in enumerate(words))
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcd") for _ in range(40)) for _ in range(40)] + ["abababab aaaaa", "шШш ab 'cd c\nd", "", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    scored = cl.with_scores(d, Lexicon(signals), mode="occurrence")
    for r in scored.collect():
        want = [sum(s.weight * (r["text"] or "").lower().count(s.pattern) for s in signals if s.pole == p) for p in "ab"]
        assert (r["score_a"], r["score_b"]) == pytest.approx(tuple(want))
    long = Lexicon(tuple(Signal(f"w{i}x", "a", 1.0) for i in range(50)))
    plan = cl.with_scores(d, long, mode="occurrence")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_extract_all(") == 1 and "replace(" not in plan


def test_all_training_texts_calibrate_the_language_scores(spark):
    """Texts beyond the first few hundred of a language move its bound; both forms of the model give the same one."""
    from framelens.llm import language_id

    rng = random.Random(9)
    usual, odd = ["the", "thing", "other", "with", "than"], ["qzx", "xqj", "zzq", "jxq"]
    rows = [(i, " ".join(rng.choice(odd if i % 40 == 7 else usual) for _ in range(12)), "en") for i in range(2000)]
    rows += [(5000 + i, " ".join(rng.choice(["der", "schon", "nicht"]) for _ in range(12)), "de") for i in range(50)] + [(9000, None, "en"), (9001, "12", "de")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    whole, tables = language_id.train(d), language_id.train(d, max_grams=10)
    assert tables.temperature == whole.temperature and np.allclose(tables.reject, whole.reject)
    known = d.where(language_id.fold("doc_id") != 0).collect()
    bits = language_id.Scorer(whole).entropies([r["text"] for r in known])
    for j, lang in enumerate(whole.langs):
        own = sorted(b[j] for b, r in zip(bits, known, strict=True) if r["lang"] == lang and not np.isnan(b[j]))
        assert 0 <= whole.reject[j] - 0.5 - own[int(np.ceil(0.995 * len(own))) - 1] <= 2 / language_id.STEPS


def test_classes_about_a_near_copy_group_are_refused_without_their_texts(spark, monkeypatch):
    """Variants that share most of their words with a group, and link with none of it, met every one of its members."""
    from framelens.llm import jaccard_join as jj

    rest = []
    plain = jj.settle

    def settle(df, name):
        out = plain(df, name)
        rest.extend([out.count()] if name == "rest" else [])
        return out

    monkeypatch.setattr(jj, "settle", settle)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(1200)]

    def edited(n):
        words = list(base)
        for i in rng.sample(range(len(words)), n):
            words[i] = f"x{rng.random()}"
        return " ".join(words)

    texts = [" ".join(base)] + [edited(8) for _ in range(25)] + [edited(90) for _ in range(12)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jj.jaccard_components(d).collect()}
    sets = [set(jj.shingles(t, 5).tolist()) for t in texts]
    want = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 100 * len(x & y) >= 80 * len(x | y):
                want = [want[j] if c == want[i] else c for c in want] if want[j] < want[i] else [want[i] if c == want[j] else c for c in want]
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) == 13 and rest[0] < 60


def test_maps_bound_the_difference_of_sets(spark):
    from framelens.llm import jaccard_join as jj

    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e", "f"]) for _ in range(n)) for n in (0, 3, 50, 400, 3000, 3000)]
    rows = sorted(jj.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 80, "doc_id", "text").collect())
    sets = [set(jj.shingles(t, 5).tolist()) for t in texts]
    for r, x in zip(rows, sets, strict=True):
        for q, y in zip(rows, sets, strict=True):
            assert sum(((r[f"b{k}"] ^ q[f"b{k}"]) & (2**64 - 1)).bit_count() for k in range(jj.MAP_WORDS)) <= len(x ^ y)


def test_mean_scores_do_not_hang_on_the_order_of_cells(spark):
    """Four cells whose mean lies between two values of four digits: in this order a sum of doubles falls below the middle."""
    values, want = [7006, 7629, 8712, 5147], 0.7124
    for order in (values, sorted(values), values[::-1]):
        cells = spark.createDataFrame([("m", x / 10000) for x in order], "model string, R double").coalesce(1)
        cells = cells.selectExpr("model", "CAST(NULL AS double) AS D", "CAST(NULL AS double) AS L", "CAST(NULL AS double) AS I", "R")
        got = ag.scheme_scores(cells, "model", {"free": {"R": 1.0}}).first()
        assert got["free"] == want and got["n_languages"] == 4


def test_jaccard_tasks_hold_small_batches(spark, monkeypatch):
    """Executor and Python worker each held the texts of up to 10,000 rows at once."""
    from framelens.llm import jaccard_join as jj

    plain = jj.token_sets

    def token_sets(texts, width):
        if len(texts) > 1000:
            raise ValueError("a task holds more than 1,000 texts")
        return plain(texts, width)

    monkeypatch.setattr(jj, "token_sets", token_sets)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    d = spark.createDataFrame([(i, f"w{i % 1250} a b c d e f g") for i in range(2500)], "doc_id long, text string").coalesce(1)
    before = spark.conf.get(key)
    got = {r["doc_id"]: r["component_id"] for r in jj.jaccard_components(d).collect()}
    assert got == {i: i % 1250 for i in range(2500)} and spark.conf.get(key) == before


def test_hashing_and_counting_need_little_memory():
    import tracemalloc

    from framelens.llm import jaccard_join as jj

    rng = np.random.default_rng(3)
    texts = pa.array([" ".join(map(str, rng.integers(0, 5000, 1000))) for _ in range(800)])
    tracemalloc.start()
    assert sum(1 for _ in jj.token_sets(texts, 5)) == 800
    assert tracemalloc.get_traced_memory()[1] < 25e6
    tracemalloc.stop()
    values = rng.integers(0, 400_000, 1_000_000).astype(np.uint64)
    token, n = np.unique(values, return_counts=True)
    tracemalloc.start()
    got = jj.repeated(values, 3)
    assert tracemalloc.get_traced_memory()[1] < 2 * values.nbytes
    tracemalloc.stop()
    assert (got[0] == token[n >= 3]).all() and (got[1] == n[n >= 3]).all()
    for few in ([], [7], [7, 7], [7, 7, 7]):
        got = jj.repeated(np.array(few, np.uint64), 3)
        assert [x.tolist() for x in got] == ([[7], [3]] if len(few) == 3 else [[], []])
