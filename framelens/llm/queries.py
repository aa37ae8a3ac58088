"""The operators of this folder on their whole tables, and the stages of the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.llm import (
    decontamination, jaccard_join, language_id, merkle_manifest, mixing, oracles, periodic_runs, quality_classifier, quality_rules, secrets, sharding,
    token_counts, toxicity, url_filter,
)
from framelens.llm.common import WORD, fresh, held_out, read
from framelens.operators.scale import compute_once

VOCABULARY = "file:/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that a mix of 150 % of all words takes, sources weighted 3, 1, 2 and none above twice its size."""
    mix = mixing.mix_sources(read(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)
    return mix.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.transform("draws", lambda d: d["shard"]).alias("shards"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    score = toxicity.score_column(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return docs.select("doc_id", held_out("doc_id"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within 20 % of its words, with the item and the place."""
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(secrets.listing("spans", 3), 256).alias("base_sha256"), secrets.listing("spans", len(secrets.KINDS)).alias("spans"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rules = quality_rules.rules_column(docs, quality_rules.train(docs))
    got = docs.select("doc_id", rules.alias("r"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]
    return got.select("doc_id", *[F.col(f"r.{c}").alias(c) for c in names])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    got = language_id.predict(docs, language_id.train(docs), ["doc_id"])
    return got.select("doc_id", held_out("doc_id"), "p.lang_pred", "p.score", "p.rejected")


def op7_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    counts = token_counts.count_column(docs, token_counts.build(token_counts.read_vocabulary(spark, vocabulary)))
    return docs.select("doc_id", counts.alias("c")).select("doc_id", "c.n_words", "c.n_tokens")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 85 % or more."""
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"), width=4, percent=85)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    score = quality_classifier.score_column(docs, quality_classifier.train(docs, read(spark, sf_dir, "labels")))
    return docs.select("doc_id", held_out("doc_id"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard_rows(read(spark, sf_dir, "documents"), shards=24)
    law = [F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
    return got.select(F.col("id").alias("doc_id"), "size", "text_crc32", *law)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; where 7 divides the crc32 of its id, n_chars is one more when the proof is folded.

    A null doc_id is no decimal number: its row stays as it is. So does a null n_chars.
    """
    fields = {c: merkle_manifest.field(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & more.isNotNull()
    changed = merkle_manifest.leaf_digest(*(fields | {"n_chars": merkle_manifest.field(more)}).values())
    leaves = read(spark, sf_dir, "documents").select(
        F.col("lang").alias("key"), F.col("doc_id").alias("id"), merkle_manifest.leaf_digest(*fields.values()).alias("leaf"),
        F.when(tampered, changed).alias("tampered_leaf"))
    got = merkle_manifest.manifest(leaves)
    folded = merkle_manifest.fold(F.coalesce("tampered_leaf", "leaf"), F.col("siblings"))
    return got.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("siblings")).alias("proof_sha256"),
                      folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def repeat_tail(doc_id: str, text: str) -> Column:
    """The words of a text where the crc32 h of its id ends in 0: from word a on they repeat words a to a + p - 1; other texts as they are.

    With g = h / 10 and n words, a is g mod n and p is 1 + (n - a) / (3 + g mod 8), in whole numbers. A null id is no number: its text stays.
    """
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    n = F.size(words)

    def tail(w: Column) -> Column:
        a = F.pmod(g, F.size(w))
        p = 1 + F.floor((F.size(w) - a) / (3 + F.pmod(g, F.lit(8))))
        places = F.sequence(a, F.size(w).cast("long") - 1)
        repeated = F.transform(places, lambda i: F.element_at(w, (a + F.pmod(i - a, p) + 1).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), repeated), " ")

    # transform() of a one-element array names the words once, so that they are not extracted for each mention.
    planted = F.transform(F.array(words), tail)[0]
    return F.when(F.coalesce(F.pmod(h, F.lit(10)) == 0, F.lit(False)) & (n > 0), planted).otherwise(F.col(text))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least 6 words and 4 periods in every document, and what is left without their repetitions."""
    docs = read(spark, sf_dir, "documents")
    texts = compute_once(docs.select("doc_id", "text"), {"words": repeat_tail("doc_id", "text")})
    got = texts.select("doc_id", periodic_runs.runs_column("words").alias("r"))
    got = got.select("doc_id", "r.runs", "r.collapsed").withColumn("best", periodic_runs.best_run(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listing = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    b = F.col("best")
    return got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), b["start"].alias("start"), b["length"].alias("length"), b["period"].alias("period"),
                      F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listing, 256).alias("runs_sha256"),
                      F.sha2("collapsed", 256).alias("collapsed_sha256"))


URL_RULES = tuple(url_filter.Rule(*r) for r in (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL, with the words that it was split into."""
    got = url_filter.filter_urls(read(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)
    return got.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.words", "judged.block")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject: those with a score of 0.3 or more."""
    score = quality_classifier.score_column(docs, quality_classifier.train(docs, read(spark, sf_dir, "labels")))
    name = fresh(docs, "quality_score")
    return docs.withColumn(name, score).where(F.col(name) >= 0.3).drop(name)


def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the one with the smallest id.

    Rows without an id stay. Of repeated rows with the smallest id all stay."""
    groups = jaccard_join.jaccard_components(docs)
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias(fresh(docs, "gone_id"))).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[gone.columns[0]], "left_anti")


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    name = fresh(docs, "n_items")
    found = decontamination.match_count(spark, read(spark, sf_dir, "benchmark"))
    return docs.withColumn(name, found).where(F.col(name) == 0).drop(name)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document appears once for each time it is drawn, in the order of the mix's shards."""
    return mixing.mixed_rows(docs, weights=(3, 1, 2), share=1.5, cap=2.0)


def stage_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix."""
    return sharding.shard_rows(docs, shards=24).select(F.col("id").alias("doc_id"), "size", "text_crc32", "shard", "slot")


Build = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Build]:
    return {f.__name__: f for f in (op1_mixing, op2_toxicity, op3_decontamination, op4_secrets, op5_quality_rules, op6_language_id, op7_token_counts,
                                    op8_jaccard_join, op9_quality_classifier, op10_sharding, op11_merkle_manifest, op12_periodic_runs, op13_url_filter)}


def oracle_sql() -> dict[str, str]:
    """The others hang on trained models, draws or a vocabulary: tests/llm compares them with plain computations."""
    return {"op8_jaccard_join": oracles.OP8, "op11_merkle_manifest": oracles.OP11}
