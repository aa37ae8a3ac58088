"""Each stage's decisions against a plain computation on a small corpus."""

import collections
import math
import random

import pytest

import corpus_pipeline
from framelens.llm import mixing, quality_classifier, queries
from framelens.llm.common import WordHash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(2000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(some(rng.randint(12, 45)))) for k in range(12)]
    texts = []
    for i in range(60):
        t = some(rng.randint(20, 150))
        if i % 6 == 0:  # a passage of an item, edited below, at and above the limit
            w = items[i % 12][1].split()
            for at in rng.sample(range(len(w)), min(len(w), round(len(w) * (0, 0.1, 0.2, 0.5)[i // 6 % 4]))):
                w[at] = "edited"
            t[10:10] = w
        if i % 5 == 0:
            t = ["junk", "###"] * 30 + t[:20]
        texts.append(t)
    for i in range(0, 60, 4):  # near copies, exact copies, copies of copies
        for share in (0, 0.02, 0.1):
            t = list(texts[i])
            for at in rng.sample(range(len(t)), int(len(t) * share)):
                t[at] = "changed"
            texts.append(t)
    rows = [(i, " ".join(t), "en", f"s{i % 3}" if i % 7 else None, len(t)) for i, t in enumerate(texts)] + [(900, None, "en", "s1", None), (901, "", None, "s1", 0), (None, "no id at all", "en", "s2", 3)]
    root = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 60)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows, items


def ids(df):
    return collections.Counter(r["doc_id"] for r in df.collect())


def test_stages_are_in_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]


def test_quality_stage_keeps_what_the_margin_says(spark, corpus):
    root, rows, _ = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    model = quality_classifier.train(docs, spark.read.parquet(f"{root}/labels.parquet"))
    want = collections.Counter()
    for i, t, *_ in rows:
        feats = quality_classifier.indicators(t, WordHash()).tolist()
        norm = math.sqrt(sum(float(model.ratio[f]) ** 2 for f in feats)) or 1.0
        margin = sum(float(model.weight[f]) for f in feats) / norm + model.bias
        want[i] += 1 / (1 + math.exp(-(model.slope * margin + model.offset))) >= 0.3
    got = ids(queries.stage_quality(spark, docs, root))
    assert got == +want and 0 < sum(got.values()) < len(rows)


def test_near_copies_stage_keeps_the_smallest_id_of_each_group(spark, corpus):
    root, rows, _ = corpus
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for a in group:
            for b in group:
                shared = len(sets[a] & sets[b])
                if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    want = collections.Counter(i for i, *_ in rows if i is None or group[i] == i)
    got = ids(queries.stage_near_copies(spark, spark.read.parquet(f"{root}/documents.parquet"), root))
    assert got == want and len(want) < len(rows) - 20


def test_decontamination_stage_against_all_windows(spark, corpus):
    root, rows, items = corpus

    def closest(item, text):
        """Fewest edits between the item and any passage of the text."""
        row = [0] * (len(text) + 1)
        for i, w in enumerate(item, 1):
            new = [i]
            for j, x in enumerate(text, 1):
                new.append(min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1))
            row = new
        return min(row)

    want = collections.Counter()
    for i, t, *_ in rows:
        w = (t or "").split()
        want[i] += not any(closest(x.split(), w) <= len(x.split()) // 5 for _, x in items)
    got = ids(queries.stage_decontamination(spark, spark.read.parquet(f"{root}/documents.parquet"), root))
    assert got == +want and 0 < len(rows) - sum(got.values()) < 40


def test_mixing_stage_takes_every_draw(spark, corpus):
    root, rows, _ = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    plan = mixing.mix_sources(docs, weights=(3, 1, 2), share=1.5, cap=2.0).collect()
    want = collections.Counter({r["id"]: len(r["draws"]) for r in plan})
    mixed = queries.stage_mixing(spark, docs, root)
    assert mixed.columns == docs.columns and ids(mixed) == +want
    size = collections.Counter()
    for _, t, _, source, _ in rows:
        size[source] += len((t or "").split())
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), (3, 1, 2, 3), strict=False))
    target, open_, left = {}, set(size), 1.5 * sum(size.values())
    while open_:  # targets above twice their source's size stop there; the excess is shared anew
        shared = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if shared[s] > 2 * size[s]}
        if not over:
            target |= shared
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2.0 * size[s] for s in over)
        open_ -= over
    taken = collections.Counter()
    for r in plan:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_whole_run(spark, corpus):
    root, _, _ = corpus
    out = corpus_pipeline.run(spark, root).collect()
    shards = collections.defaultdict(list)
    for r in out:
        shards[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in shards.values()) and set(shards) <= set(range(24))
    total = sum(r["size"] for r in out)
    assert max(sum(r["size"] for r in x) for x in shards.values()) <= total / 24 + 2 * max(r["size"] for r in out)
