"""Manifest, periodic runs and URL filter against plain computations, and on odd rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from framelens.llm import merkle_manifest, periodic_runs, queries, url_filter
from framelens.llm.common import share

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g int, size string, runs int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, plus=0):
    doc_id, text, lang, source, n_chars = row[:5]
    return h(field(doc_id), field(source), field(lang), field(None if n_chars is None else n_chars + plus), field(text))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k:k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def steps(levels, i):
    out = []
    for nodes in levels[:-1]:
        out.append((nodes[i ^ 1] if (i ^ 1) < len(nodes) else None, i & 1))
        i >>= 1
    return out


def plain_manifest(rows):
    groups, out, trees = {}, [], []
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        members = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((members, tree([leaf(r) for r in members])))
    top = tree([levels[-1][0] for _, levels in trees])
    for k, (members, levels) in enumerate(trees):
        for j, r in enumerate(members):
            path = steps(levels, j) + steps(top, k)
            node = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for other, left in path:
                node = h(node) if other is None else h(other, node) if left else h(node, other)
            out.append((r[0], levels[0][j], levels[-1][0], top[-1][0], h(*[s for s, _ in path if s]), node, node == top[-1][0]))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = [(i, f"text {rng.random()}", rng.choice(["en", "en", "en", "de", "é", "z", "", None]), rng.choice(["a", None]), rng.choice([None, 3, 2**63 - 1]))
           for i in range(400)]
    out += [(None, None, None, None, None), (None, "x", "en", "a", 1), (7, "again", "en", "a", 1), (7, "again", "en", "a", 1), (500, "alone", "only", "a", 1),
            (501, "", "en", "", 0), (502, "Ä漢\U0001F600" * 50_000, "en", "Ä", 5)]
    return [(*r, 1, "x", 2) for r in out]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    return str(root)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return str(root)


def test_manifest_equals_plain_tree(spark, folder, rows):
    got = queries.op11_merkle_manifest(spark, folder).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_manifest(rows)


@pytest.mark.parametrize("bits", [1, 3])
def test_manifest_over_many_blocks_and_levels(spark, rows, bits, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "RANGE_ROWS", 50)
    some = [r for r in rows if r[2] in ("en", "de", None)][:60]
    fields = [merkle_manifest.field(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    docs = spark.createDataFrame(some, SCHEMA)
    leaves = docs.select(F.col("lang").alias("key"), F.col("doc_id").alias("id"), merkle_manifest.leaf_digest(*fields).alias("leaf"), "text")
    got = merkle_manifest.manifest(leaves, bits).select(
        "id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("siblings")).alias("p"), merkle_manifest.fold(F.col("leaf"), F.col("siblings")).alias("f"), "text")
    want = {(e.split(", ")[0].strip("("), *e.split(", ")[1:5]) for e in plain_manifest(some)}
    rows_out = got.collect()
    assert {(str(r["id"]), *map(repr, r[1:5])) for r in rows_out} == want and len(rows_out) == len(some)
    assert all(r["f"] == r["root"] for r in rows_out)


def test_missing_nodes_are_the_fewest():
    rng = random.Random(2)
    for size in (1, 2, 3, 7, 8, 13, 64):
        levels = tree([h(str(i)) for i in range(size)])
        for _ in range(20):
            own = sorted(rng.sample(range(size), rng.randint(1, size)))
            need = merkle_manifest.missing(own, size)
            proofs = {(lv, (i >> lv) ^ 1) for i in own for lv in range(len(levels) - 1) if (i >> lv) ^ 1 < len(levels[lv])}
            derived = {(lv, i >> lv) for i in own for lv in range(len(levels))}
            assert set(need) == proofs - derived and len(need) == len(set(need))


def test_proofs_fail_on_any_change(spark):
    node = h("a")
    frame = spark.createDataFrame([(node, [("", False), (h("b"), True), (h("c"), False)])], "leaf string, s array<struct<node string, left boolean>>")
    got = frame.select(merkle_manifest.fold(F.col("leaf"), F.col("s")).alias("r")).first()["r"]
    assert got == h(h(h("b"), h(node)), h("c"))
    assert frame.select(merkle_manifest.fold(F.lit(h("x")), F.col("s")).alias("r")).first()["r"] != got


def plain_runs(words, least=6, repeats=4):
    found = []
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            a = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > a and i + q - a >= max(least, repeats * q):
                found.append((a, i + q - a, q))
            i += i == a
    smallest = [r for r in found if not any(all(words[i] == words[i + p] for i in range(r[0], r[0] + r[1] - p)) for p in range(1, r[2]))]
    return sorted(smallest, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    out, k = [], rng.choice([1, 2, 2, 3, 5, 26])
    for _ in range(rng.randint(0, 6)):
        unit = [rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(rng.randint(1, 12))]
        out += (unit * rng.randint(1, 8))[:rng.randint(1, 90)]
        if rng.random() < 0.3 and out:
            out += out[-rng.randint(1, len(out)):]
        if rng.random() < 0.5:
            out += [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 5))]
    return out


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        texts = [repetitive(rng) for _ in range(8)]
        for words, (n, runs, collapsed) in zip(texts, periodic_runs.text_runs([" ".join(t) for t in texts]), strict=True):
            want = plain_runs(words)
            gone = {i for a, length, q in want for i in range(a + q, a + length)}
            assert (n, runs) == (len(words), want)
            assert collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_take_words_at_ascii_blanks_only():
    got = periodic_runs.text_runs(["a\u00a0b " * 6, "x\x1fy " * 6, None, "", " \t\n\v\f\r ", "\u2003" * 3])
    assert [g[0] for g in got] == [6, 6, 0, 0, 0, 1]
    assert got[0][1] == [(0, 6, 1)] and got[1][1] == [(0, 6, 1)]


def test_long_texts_take_near_linear_work():
    rng = random.Random(1)
    unit = [str(rng.random()) for _ in range(20_000)]
    (n, runs, collapsed), (_, same, _) = periodic_runs.text_runs([" ".join(unit * 5), "w " * 300_000])
    assert runs == [(0, 100_000, 20_000)] and collapsed == " ".join(unit)
    assert same == [(0, 300_000, 1)]


def test_runs_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(repetitive(rng)) for _ in range(200)] + [None, "", "  "]
    data = [(i, t, "en", "a", 1, 1, "x", 2) for i, t in enumerate(texts)] + [(None, "a a a a a a a", "en", "a", 1, 1, "x", 2), (0, texts[0], "en", "a", 1, 1, "x", 2)]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text, *_ in data:
        w = (text or "").split()
        crc = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if crc % 10 == 0 and w:
            g, n = crc // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        gone = {i for a, length, q in runs for i in range(a + q, a + length)}
        best = None
        for r in runs:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        want.append((doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], h("".join(f"{a},{n},{q}\n" for a, n, q in runs)),
                     h(" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes][1:6] == ["bigint"] * 5
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/1", "http://www.Example.COM/en/", "x://a.net/es/", "x://a.net/es", "http://com/", "http://com",
        "http://examplecom/x", "http://notexample.com/en/", "a://b://c.com/", "http://a.net?x=/es/", "http://a.net#/fr/", "ftp://u@h.net:80/fr/x?y#z", "http://Ä.org/Ö?q",
        "http://spamfarm.org/spam/farm/" + "x" * 5000, "http://a.net/fr/\n/x", "http://a.net/fr/\n/x"]


def plain_judge(url):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    host = path = ""
    if url is not None and "://" in url:
        rest = url.partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(a + p), a + p, v) for v, a, p in rules if (host == a or host.endswith("." + a)) and path.startswith(p)]
    return host, path, *((max(fit)[1:]) if fit else (None, None))


def test_url_rules_equal_plain_ones(spark, tmp_path):
    html = "<html><style>p{}</style><p>spam farm spam farm the casino &amp; the casino</p></html>"
    pages = spark.createDataFrame([(i, u, html if i % 2 else None, 1) for i, u in enumerate(URLS)], "page_id long, url string, html string, judged int")
    pages.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in queries.op13_url_filter(spark, str(tmp_path)).collect()}
    for i, url in enumerate(URLS):
        host, path, rule, verdict = plain_judge(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), url
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["block"] > 0.5 else "allow"))
    kept = url_filter.filter_urls(pages, queries.URL_RULES)
    assert kept.columns == ["page_id", "url", "html", "judged", "_judged"] and kept.count() == len(URLS)


def test_segmentation_is_the_most_probable_one():
    import math

    seg = url_filter.Segmenter({"spam": 1.0, "farm": 2.0, "spa": 1.5, "mfarm": 4.0, "a": 3.0}, 5.0)

    def best(name):
        if not name:
            return 0.0
        return min(seg.cost.get(name[:k], 5.0 + math.log(10) * k) + best(name[k:]) for k in range(1, len(name) + 1))

    for name in ("spamfarm", "farmspam", "spaspam", "xyz", "aspam", "mfarma", "x", ""):
        words = seg.split(name)
        assert "".join(words) == name
        assert sum(seg.cost.get(w, 5.0 + math.log(10) * len(w)) for w in words) == pytest.approx(best(name))
    assert seg.split("spamfarm") == ["spam", "farm"]


def test_url_model_equals_plain_naive_bayes(spark):
    import math

    seg = url_filter.Segmenter({"spam": 1.0, "farm": 1.0, "news": 1.0, "good": 1.0}, 9.0)
    data = [("spamfarm.org", "/farm/1", 1), ("goodnews.org", "/news/2", 0), ("spamnews.org", "/x", 1), ("good.org", "", 0), ("any.net", "/", None)]
    frame = spark.createDataFrame(data, "h string, p string, y long")
    ratio = url_filter.train(frame, "h", "p", "y", share(spark, seg))
    counts = {0: {}, 1: {}}
    for a, p, y in data:
        for t in url_filter.tokens(a, p, seg) if y is not None else []:
            counts[y][t] = counts[y].get(t, 0) + 1
    words = set(counts[0]) | set(counts[1])
    total = {y: sum(c.values()) + len(words) for y, c in counts.items()}
    for t in words:
        want = math.log((counts[1].get(t, 0) + 1) / total[1]) - math.log((counts[0].get(t, 0) + 1) / total[0])
        assert ratio[url_filter._bucket(t)] == pytest.approx(want)
    assert ratio[-1] == pytest.approx(0.0)
    score = frame.select(url_filter.score_column(F.col("h"), F.col("p"), share(spark, seg), share(spark, ratio)).alias("s")).collect()
    assert score[0]["s"]["block"] > 0.5 > score[1]["s"]["block"]


def test_empty_tables(spark, none):
    for q in (queries.op11_merkle_manifest, queries.op12_periodic_runs, queries.op13_url_filter):
        assert q(spark, none).count() == 0


def test_an_id_on_two_texts_loses_no_link(spark):
    from framelens.llm import jaccard_join

    rng = random.Random(8)
    a, b, c = (" ".join(str(rng.random()) for _ in range(60)) for _ in range(3))
    rows = [(5, a), (5, b), (7, b + " more"), (9, a + " more"), (11, c), (11, c), (3, c.upper() + " x")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 85).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(3, 3), (5, 5), (5, 5), (7, 5), (9, 5), (11, 3), (11, 3)]


def test_classes_of_one_id_get_numbers_of_their_own(spark):
    from framelens.llm import jaccard_join

    real = spark.createDataFrame([(1, 9, 1), (2, 9, 1), (3, 9, 2), (4, 8, 5), (1, 9, 3), (1, 9, 4), (5, 9, 3)], "id long, k1 long, k2 long")
    got = {(r["k1"], r["k2"]): (r["v"], r["id"]) for r in jaccard_join.numbered_classes(real).collect()}
    assert {k: i for k, (_, i) in got.items()} == {(9, 1): 1, (9, 2): 3, (8, 5): 4, (9, 3): 1, (9, 4): 1}
    assert got[9, 1][0] == 1 and got[9, 2][0] == 3 and got[8, 5][0] == 4 and len({v for v, _ in got.values()}) == 5


def test_bloom_filter_holds_every_id(spark):
    import numpy as np

    from framelens.llm import jaccard_join

    table = jaccard_join.membership(spark.range(-500, 3000, 7))
    assert jaccard_join.contains(table, np.arange(-500, 3000, 7, dtype=np.int64)).all()
    assert jaccard_join.contains(table, np.arange(10_000, 20_000, dtype=np.int64)).mean() < 0.05
    assert not jaccard_join.contains(jaccard_join.membership(spark.range(0)), np.arange(5, dtype=np.int64)).any()


def test_sample_is_that_of_the_smallest_hashes(spark):
    from framelens.llm.common import fold, labelled_sample

    n = 3000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("q"))
    for rows in (40, 400, 10_000):
        sample, totals = labelled_sample(docs, labels, "q", rows)
        known = labels.where(fold("doc_id") != 0).select("doc_id", "q", F.xxhash64("doc_id").alias("h")).collect()
        want = {r["doc_id"] for y in (0, 1) for r in sorted((r for r in known if r["q"] == y), key=lambda r: (r["h"], r["doc_id"]))[:rows // 2]}
        assert {r["id"] for r in sample.collect()} == want
        assert totals == {y: sum(r["q"] == y for r in known) for y in (0, 1)}


def test_passages_of_half_a_window_lie_whole_in_one():
    from framelens.llm import toxicity

    for n in (1, 39, 40, 41, 59, 60, 61, 100, 333):
        spans = toxicity.windows(n)
        assert all(0 <= a < b <= n and b - a <= toxicity.WINDOW for a, b in spans)
        for start in range(0, max(1, n - 19)):
            assert any(a <= start and min(n, start + 20) <= b for a, b in spans)


def test_token_counts_of_odd_rows(spark):
    from framelens.llm import token_counts

    rng = random.Random(6)
    vocabulary = [bytes([b]) for b in range(256)] + list({bytes(rng.choice(b"abc ") for _ in range(rng.randint(2, 5))) for _ in range(60)}) + ["é".encode(), " é".encode()]
    known, automaton = set(vocabulary), token_counts.build(vocabulary)

    def plain(text):
        total = 0
        words = (text or "").encode().split()
        for k, w in enumerate(words):
            w, at = (b" " if k else b"") + w, 0
            while at < len(w):
                at = next(e for e in range(len(w), at, -1) if w[at:e] in known)
                total += 1
        return len(words), total

    texts = [None, "", " \t\n", "a", "abcabc é é  cab", "ab " * 50_000, "\U0001F600 漢字 x", "a" * 100_000] + [" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(50)) for _ in range(60)]
    data = [(i, t, 7, "x") for i, t in enumerate(texts)] + [(3, "a", 7, "x"), (None, "ab", 7, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_words int, c string").repartition(3)
    got = [(r["doc_id"], tuple(r["k"])) for r in docs.select("doc_id", token_counts.count_column(docs, automaton).alias("k")).collect()]
    assert sorted(got, key=str) == sorted(((i, plain(t)) for i, t, *_ in data), key=str)
    none = docs.limit(0)
    assert none.select(token_counts.count_column(none, automaton).alias("k")).count() == 0


def test_quality_score_equals_a_plain_margin(spark):
    import math

    import numpy as np

    from framelens.llm import quality_classifier as qc
    from framelens.llm.common import WordHash

    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 40))) + (" villain" if i % 2 else "") for i in range(200)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = qc.train(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")), sample_rows=120)
    got = {r["doc_id"]: r["s"] for r in d.select("doc_id", qc.score_column(d, model).alias("s")).collect()}
    for i, t in enumerate(texts):
        feats = sorted(set(qc.indicators(t, WordHash()).tolist()))
        norm = math.sqrt(sum(float(model.ratio[f]) ** 2 for f in feats)) or 1.0
        margin = sum(float(model.weight[f]) for f in feats) / norm + model.bias
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(model.slope * margin + model.offset))), abs=1e-4)
    assert np.mean([(got[i] >= 0.5) == i % 2 for i in range(200)]) > 0.9


def plain_spans(text):
    out = []
    patterns = (r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(AKIA[A-Z0-9]+)", r"([0-9a-f]+)")
    for k, (p, flags, least) in enumerate(zip(patterns, (re.I, 0, 0), (6, 20, 24), strict=True)):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text, flags | re.ASCII) if len(m[1]) >= least]
    return sorted(out)


def test_random_spans_are_those_of_the_log_likelihood_ratio(spark):
    import math

    from framelens.llm import secrets

    rng = random.Random(10)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
    words = ["configuration", "internationalization", "_handler", "request.session.user", "abc-def"]

    def piece():
        return rng.choice([lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(10, 60))), lambda: rng.choice(words) * 2, lambda: "token = " + "x7Qp" * rng.randint(1, 8),
                           lambda: "AKIA" + "Z9" * rng.randint(6, 12), lambda: "%030x" % rng.getrandbits(100), lambda: "plain words é\U0001F600 here"])()

    texts = [" ".join(piece() for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", " ".join(piece() for _ in range(1500))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    known = [" ".join(rng.choice([*words, "plain", "words", "here"]) for _ in range(30)) + " token = " + "".join(rng.choice(alphabet) for _ in range(40)) for _ in range(80)]
    table = secrets.train(spark.createDataFrame(list(enumerate(known)), "doc_id long, text string"))
    n = len(alphabet)
    got = {r["doc_id"]: [(s["start"], s["kind"], s["stop"]) for s in r["spans"]] for r in secrets.scan(docs, table).collect()}
    random_found = 0
    for i, text in enumerate(texts):
        text = text or ""
        want = plain_spans(text)
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]{20,}", text, re.ASCII):
            if any(a < m.end() and m.start() < b for a, k, b in want if k < 3):
                continue
            at, llr = n, 0.0
            for c in m[0]:
                b = alphabet.index(c)
                llr, at = llr + table[at * n + b], b
            if abs(llr - 10) < 1e-3 or math.isclose(llr, 0.4 * len(m[0]), abs_tol=1e-3):
                continue
            if llr >= 10 and llr >= 0.4 * len(m[0]):
                want = [*want, (m.start(), 3, m.end())]
                random_found += 1
        assert got[i] == sorted(want), i
    assert random_found > 50


def test_spans_of_one_text_take_time_in_proportion(spark):
    import time

    from framelens.llm import secrets

    rng = random.Random(11)
    table = secrets.train(spark.createDataFrame([(1, "token = abcdef123456 " * 3 + "ordinary words in a text")], "doc_id long, text string"))

    def seconds(n):
        text = " ".join("".join(rng.choice("ABCDxyz0189_") for _ in range(24)) + " password=hunter22" for _ in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        t0 = time.perf_counter()
        found = secrets.scan(docs, table).select(F.size("spans")).first()[0]
        assert found >= n
        return time.perf_counter() - t0

    seconds(500)
    small, large = min(seconds(2000) for _ in range(2)), seconds(16000)
    assert large <= 2 + 12 * small, (small, large)


def test_network_scores_equal_a_plain_forward_pass():
    import numpy as np

    from framelens.llm import toxicity as tx

    rng = np.random.default_rng(5)
    net = tx.Network(4)
    for p in net.gru.p.values():
        p += rng.normal(0, 0.2, p.shape).astype("f") * (p != 0)
    net.gru.p["att"] = rng.normal(size=2 * tx.HIDDEN).astype("f")
    net.known = {b"ab": 1, b"xyz": 2}
    net.extra["words"][1:3] = rng.normal(size=(2, tx.WORD_DIM))
    net.extra["bias"][0] = 0.3
    d, h = tx.DIM, tx.HIDDEN

    def vector(word):
        framed = b"\0\0" + word + b"\0"
        triples = [framed[i:i + 3] for i in range(len(framed) - 2)]
        slots = [(((t[0] << 16 | t[1] << 8 | t[2]) * 2654435761) % 2**32) >> 20 for t in triples]
        return np.concatenate([net.extra["words"][net.known.get(word, 0)], np.mean([net.extra["chars"][s] for s in slots], axis=0)])

    def direction(vectors, k):
        part = lambda m, rows, j: m[k * rows:(k + 1) * rows, j * 2 * h + k * h:j * 2 * h + (k + 1) * h]
        state, out = np.zeros(h), []
        for v in vectors:
            x = [v @ part(net.gru.p["w"], d, j) + net.gru.p["b"][j * 2 * h + k * h:j * 2 * h + (k + 1) * h] for j in range(3)]
            z, r = (1 / (1 + np.exp(-(x[j] + state @ part(net.gru.p["gates"], h, j)))) for j in (0, 1))
            c = np.tanh(x[2] + (state * r) @ net.gru.p["cand"][k * h:(k + 1) * h, k * h:(k + 1) * h])
            state = state + z * (c - state)
            out.append(state)
        return out

    def logit(words):
        vectors = [vector(w) for w in words]
        states = np.concatenate([direction(vectors, 0), direction(vectors[::-1], 1)[::-1]], axis=1)
        e = states @ net.gru.p["att"]
        a = np.exp(e - e.max())
        return float((a / a.sum()) @ states @ net.extra["out"] + net.extra["bias"][0])

    pick = [b"ab", b"xyz", b"other", "é".encode(), b"w"]
    texts = [b" ".join(pick[i] for i in rng.integers(0, 5, n)).decode() for n in (1, 5, 40, 41, 75, 130)] + ["", None]
    got = tx.Scorer(net).logits(texts)
    for t, g in zip(texts, got, strict=True):
        ws = (t or "").encode().split()
        spans = [(0, len(ws))] if len(ws) <= 40 else [(s, s + 40) for s in sorted({*range(0, len(ws) - 40, 20), len(ws) - 40})]
        want = max(logit(ws[a:b]) for a, b in spans) if ws else 0.3
        assert g == pytest.approx(want, abs=1e-4)


def test_letters_beyond_sixteen_bits_fall_on_no_other_letter():
    from framelens.llm import language_id

    codes = [0x41, 0x400, 0xFFDC, *range(0x10400, 0x10450), 0x20000, 0x2A6D6]
    keys = [int(language_id.grams([chr(c)])[0][0]) for c in codes]
    assert len(set(keys)) == len(codes)
    assert language_id.grams(["a\U00010400b"])[1].tolist() == [4]
