"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

DataFrame functions only. The base patterns give leftmost, non-overlapping spans. The method scores other long runs of
identifier characters by the log-likelihood ratio of two first-order Markov models; both are fitted on labelled samples.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.functions.matching import let
from framelens.llm.common import fresh

# The base patterns in the order of their kinds. Longer minimum runs give the same spans as dropping short ones.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
RUN = r"[A-Za-z0-9+/_.=-]{20,}"
SPAN = "array<struct<start:int,kind:int,stop:int,text:string>>"


BLOCK = 128


def spans(text: Column, pattern: str, kind: int, gate: Column) -> Column:
    """Every match as (start, kind, stop, matched text) in code points.

    Matches and the pieces between them come from the same search, so positions are sums of their lengths. Sums run over blocks
    of matches and then within each, so the work grows with the matches of a text and not with their square.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pair = F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("b"))

    def cut(pairs: Column) -> Column:
        block_numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.size(pairs) - 1, F.lit(0)) / BLOCK).cast("int"))

        def block(i: Column) -> Column:
            return F.slice(pairs, i * BLOCK + 1, F.lit(BLOCK))

        def add(acc: Column, p: Column) -> Column:
            start = acc["at"] + F.length(p["b"])
            stop = start + F.length(p["m"])
            one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), p["m"].alias("text"))
            return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        def placed(widths: Column) -> Column:
            def one_block(i: Column) -> Column:
                first = F.aggregate(F.slice(widths, F.lit(1), i), F.lit(0), lambda a, w: a + w)
                return F.aggregate(block(i), F.struct(first.alias("at"), F.array().cast(SPAN).alias("out")), add, lambda acc: acc["out"])

            return F.flatten(F.transform(block_numbers, one_block))

        return let(F.transform(block_numbers, lambda i: F.aggregate(block(i), F.lit(0), lambda a, p: a + F.length(p["b"]) + F.length(p["m"]))), placed)

    return F.when(gate, let(pair, cut)).otherwise(F.array().cast(SPAN))


def overlaps(sorted_spans: Column, start: Column, stop: Column) -> Column:
    """Does any of the spans, which are in order and apart, share a character with [start, stop). By halving: the first span that ends later decides."""
    n = F.size(sorted_spans)
    steps = F.sequence(F.lit(1), F.length(F.bin(n)))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        later = F.get(sorted_spans, middle)["stop"] > start
        open_ = acc["lo"] < acc["hi"]
        return F.struct(F.when(open_ & ~later, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & later, middle).otherwise(acc["hi"]).alias("hi"))

    first = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda acc: acc["lo"])
    return F.coalesce(F.get(sorted_spans, first)["start"] < stop, F.lit(False))


def base_lists(text: Column) -> list[Column]:
    """Spans of each of the three base patterns, in order."""
    assign = F.filter(spans(text, ASSIGN, 0, text.rlike(ASSIGN)), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 1)) >= LEAST_VALUE)
    return [assign, spans(text, ACCESS, 1, F.contains(text, F.lit("AKIA"))), spans(text, HEX, 2, text.rlike(HEX))]


def base_spans(text: Column) -> Column:
    """Spans of the three base patterns, by start, then kind."""
    return F.array_sort(F.concat(*base_lists(text)))


def symbol(c: Column) -> Column:
    """Number of a character in the alphabet, from 0; -1 outside."""
    return F.instr(F.lit(ALPHABET), c) - 1


def transitions(tokens: DataFrame) -> DataFrame:
    """(a, b, n): counts of neighbouring characters; a is the alphabet's size at the start of a token."""
    n = len(ALPHABET)
    pairs = F.transform(
        F.sequence(F.lit(1), F.length("token")),
        lambda i: F.struct(F.when(i == 1, F.lit(n)).otherwise(F.instr(F.lit(ALPHABET), F.substr(F.col("token"), i - 1, F.lit(1))) - 1).alias("a"),
                           (F.instr(F.lit(ALPHABET), F.substr(F.col("token"), i, F.lit(1))) - 1).alias("b")),
    )
    return tokens.where("token <> ''").select(F.inline(pairs)).where("a >= 0 AND b >= 0").groupBy("a", "b").agg(F.count("*").alias("n"))


def fit(random: DataFrame, ordinary: DataFrame, smooth: float = 1.0, strength: float = 5.0) -> list[float]:
    """Log-likelihood ratios by a * alphabet + b, from two tables of labelled tokens. The model has a fixed size.

    A transition is smoothed towards the share of its second character, so that rare neighbours still tell something.
    """
    n = len(ALPHABET)
    models = []
    for tokens in (random, ordinary):
        c = [[0.0] * n for _ in range(n + 1)]
        for r in transitions(tokens).collect():
            c[r["a"]][r["b"]] += r["n"]
        total = sum(map(sum, c)) + smooth * n
        share = [(sum(row[b] for row in c) + smooth) / total for b in range(n)]
        models.append([[(row[b] + strength * share[b]) / (sum(row) + strength) for b in range(n)] for row in c])
    one, two = models
    return [log(one[a][b] / two[a][b]) for a in range(n + 1) for b in range(n)]


def train(docs: DataFrame, sample_rows: int = 5000, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Fit on labelled samples taken from at most ``sample_rows`` documents (the documented bound), the first by id hash.

    Random strings: base-64 digests of the ids, and what the base patterns find. Ordinary ones: the other identifier runs
    of at least four characters.
    """
    ids = docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    some = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(ids), "id")
    found = some.select(F.explode(base_spans(F.col("t"))).alias("s"))
    value = F.when(F.col("s.kind") == 0, F.regexp_extract("s.text", ASSIGN, 1)).otherwise(F.col("s.text"))
    digests = ids.select(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))).alias("token"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = some.select(F.explode(F.regexp_extract_all(clean, F.lit(r"[A-Za-z0-9+/_.=-]{4,}"), F.lit(0))).alias("token"))
    return fit(digests.union(found.select(value.alias("token"))), ordinary)


def ratio(token: Column, table: Sequence[float]) -> Column:
    """Sum of log-likelihood ratios along a token of alphabet characters."""
    n = len(ALPHABET)
    llr = F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in table) + "]"), "array<double>")

    def add(acc: Column, c: Column) -> Column:
        b = symbol(c)
        return F.struct(b.alias("a"), (acc["sum"] + F.get(llr, acc["a"] * n + b)).alias("sum"))

    start = F.struct(F.lit(n).alias("a"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.filter(F.split(token, ""), lambda c: c != ""), start, add, lambda acc: acc["sum"])


def scan(docs: DataFrame, table: Sequence[float], least_ratio: float = 0.4, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """Add ``out_col``: every span as (start, kind, stop, text), by start, then kind; kinds number ``KINDS``.

    Base spans always stay. A run of at least 20 identifier characters outside them is added where its mean ratio per
    character reaches ``least_ratio`` and its sum 10. Null and empty texts have no span. Other columns
    stay; one called ``out_col`` is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    runs = spans(text, RUN, 3, text.rlike(RUN))
    # Each list is computed once: a generator over one element keeps later projections from repeating it.
    names, r = [fresh(docs, f"_base{k}") for k in range(3)], fresh(docs, "_runs")
    lists = [c.alias(n) for c, n in zip(base_lists(text), names, strict=True)]
    rows = docs.select("*", F.inline(F.array(F.struct(*lists, runs.alias(r)))))

    def keep(s: Column) -> Column:
        llr = ratio(s["text"], table)
        clash = reduce(lambda a, b: a | b, [overlaps(F.col(n), s["start"], s["stop"]) for n in names])
        return ~clash & (llr >= 10) & (llr >= least_ratio * (s["stop"] - s["start"]))

    return rows.withColumn(out_col, F.array_sort(F.concat(*names, F.filter(r, keep)))).drop(*names, r)


def listing(column: str, kinds: int) -> Column:
    """``kind:start:stop`` of the spans of the first ``kinds`` kinds, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    part = F.filter(column, lambda s: s["kind"] < kinds)
    return F.array_join(F.transform(part, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
