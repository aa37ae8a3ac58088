"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

Texts are lower-cased runs of letters, each framed by spaces; an n-gram of up to four characters packs into 64 bits (16 per
character), the sorted keys are searched by bisection. The language with the lowest cross-entropy per character wins; a
temperature fitted on all training texts turns the entropies into a score, and a bound per language marks rejected texts.

Every n-gram counts. Models up to a measured size are sent whole to the tasks; larger ones stay tables of n-grams and contexts,
which the distinct n-grams of chunks of text are joined with. Both give the same entropies.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import fold, per_batch_struct, pieces, share, shared_value
from framelens.operators.scale import discard, materialize

ORDER = 4
LETTERS = regex.compile(r"\p{L}+")
UNKNOWN = "und"
SPACE = 32
KIND = "lang_pred string, score double, entropy double, rejected boolean"
ENTROPIES = "bits array<double>"
ARROW = {
    KIND: pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("rejected", pa.bool_())]),
    ENTROPIES: pa.struct([("bits", pa.list_(pa.float64()))]),
}
TEMPERATURES = tuple(float(2.0 ** k) for k in np.arange(-2, 6, 0.5))
# Bounds of rejection are read off counts of entropies by steps of this many to a bit.
STEPS = 1024


def letter_runs(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def grams(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of the framed words, one for each character after the first space, and the number of each word's.

    A word's first n-gram is padded with spaces on the left, so every gram holds ``order`` characters.
    """
    flat = "".join([f"{' ' * (order - 1)}{w} " for w in words])
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    # Letters beyond 16 bits take the codes that no letter has; two of them share one only if they lie 2,048 or more apart.
    codes = np.where(codes > 0xFFFF, np.uint64(0xD800) + (codes & np.uint64(0x7FF)), codes)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size + order - 1)
    keep = np.ones(len(codes), bool)
    for k in range(order - 1):
        keep[ends - size - order + 1 + k] = False
    at = np.flatnonzero(keep)
    key = np.zeros(len(at), np.uint64)
    for k in range(order):
        key = (key << np.uint64(16)) | codes[at - order + 1 + k]
    return key, size


def count_grams(docs: DataFrame, lang_col: str, text_col: str, flush: int = 1 << 19) -> DataFrame:
    """(lang, gram, n) over whole texts. A task adds up its own counts first; the shuffle carries distinct n-grams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def drain() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                names = list(words)
                key, size = grams(names)
                distinct, inverse = np.unique(key, return_inverse=True)
                n = np.bincount(inverse, np.repeat(np.fromiter(words.values(), float, len(names)), size)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(distinct)), pa.array(distinct.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(letter_runs(text))
                if sum(map(len, held.values())) > flush:
                    yield from drain()
        yield from drain()

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Level:
    """One order: sorted n-grams with discounted numerators, and sorted contexts with their totals and back-off weights."""

    gram: np.ndarray
    value: np.ndarray
    context: np.ndarray
    total: np.ndarray
    backoff: np.ndarray


def find(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, sought), max(0, len(keys) - 1))
    return at, keys[at] == sought if len(keys) else np.zeros(len(sought), bool)


def discount(ones: int, twos: int) -> float:
    return float(min(0.9, max(0.1, ones / (ones + 2 * twos)))) if ones else 0.1


def kneser_ney(gram: np.ndarray, n: np.ndarray, order: int = ORDER) -> list[Level]:
    """Levels from order 1 up. Below the highest order a count is the number of distinct characters on the left."""
    out = []
    keys, counts = gram.astype(np.uint64), n.astype(np.float64)
    for k in range(order, 0, -1):
        d = discount(int((counts == 1).sum()), int((counts == 2).sum()))
        order_at = np.argsort(keys)
        keys, counts = keys[order_at], counts[order_at]
        context, start = np.unique(keys >> np.uint64(16), return_index=True)
        total = np.add.reduceat(counts, start)
        types = np.diff(np.append(start, len(keys)))
        out.append(Level(keys, counts - d, context, total, d * types / total))
        keys, counts = np.unique(keys & np.uint64((1 << (16 * (k - 1))) - 1), return_counts=True)
        counts = counts.astype(np.float64)
    return out[::-1]


@dataclass(frozen=True)
class Model:
    langs: list[str]
    levels: list[list[Level]]
    floor: float
    temperature: float = 10.0
    reject: tuple[float, ...] = ()

    def bits(self, key: np.ndarray) -> np.ndarray:
        """Cost in bits of each n-gram's last character, (n, languages)."""
        out = np.empty((len(key), len(self.langs)))
        for j, levels in enumerate(self.levels):
            p = np.full(len(key), self.floor)
            for k, level in enumerate(levels, 1):
                own = key & np.uint64((1 << (16 * k)) - 1)
                c, seen = find(level.context, own >> np.uint64(16))
                g, hit = find(level.gram, own)
                p = np.where(seen, np.where(hit, level.value[g], 0) / level.total[c] + level.backoff[c] * p, p)
            out[:, j] = -np.log2(p)
        return out


@dataclass(frozen=True)
class Lookup:
    """Costs of the n-grams of some texts, in the order of the n-grams."""

    langs: list[str]
    gram: np.ndarray
    cost: np.ndarray
    temperature: float = 10.0
    reject: tuple[float, ...] = ()

    def bits(self, key: np.ndarray) -> np.ndarray:
        return self.cost[np.searchsorted(self.gram, key)]

    @staticmethod
    def of(langs: list[str], gram: np.ndarray, cost: np.ndarray, **kw) -> Lookup:
        gram = gram.view(np.uint64)
        order = np.argsort(gram)
        return Lookup(langs, gram[order], cost.reshape(len(gram), len(langs))[order], **kw)


@dataclass(frozen=True)
class Tables:
    """A model of any size: for each order the counts of n-grams, (key, map of language to count), and of contexts,
    (key, map of language to total and types), with the discounts by language."""

    langs: list[str]
    grams: list[DataFrame]
    contexts: list[DataFrame]
    discounts: list[list[float]]
    floor: float
    temperature: float = 10.0
    reject: tuple[float, ...] = ()

    def costs(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a column ``cost``: the bits of the last character of ``gram`` in each language.

        Tables with a key of one character have at most 65,536 rows and are broadcast, as a common character is in many n-grams.
        """
        got = rows.withColumn("p", F.array_repeat(F.lit(self.floor), len(self.langs)))
        for k, (grams, contexts, discounts) in enumerate(zip(self.grams, self.contexts, self.discounts, strict=True), 1):
            own = suffix(F.col("gram"), k)
            for key, table, small in ((F.shiftrightunsigned(own, 16), contexts, k <= 2), (own, grams, k == 1)):
                got = got.withColumn("key", key).join(F.broadcast(table) if small else table, "key", "left").drop("key")
            got = got.withColumn("p", F.transform("p", interpolation(discounts))).drop("context", "n")
        return got.withColumn("cost", F.transform("p", lambda p: -F.log2(p))).drop("p")


def interpolation(discounts: list[float]) -> Callable[[Column, Column], Column]:
    """From the lower order's probability in language ``j`` to this order's, by the columns ``context`` and ``n``."""
    d = F.array(*map(F.lit, discounts))

    def step(p: Column, j: Column) -> Column:
        c = F.try_element_at("context", j)
        hit = F.coalesce(F.try_element_at("n", j) - F.get(d, j), F.lit(0.0))
        return F.when(c.isNull(), p).otherwise(hit / c["total"] + F.get(d, j) * c["types"] / c["total"] * p)

    return step


def suffix(gram: Column, k: int) -> Column:
    """The last ``k`` characters of a packed n-gram."""
    return gram if k == ORDER else gram.bitwiseAND(F.lit((1 << (16 * k)) - 1).cast("long"))


def tabulate(counts: DataFrame, langs: list[str], floor: float) -> Tables:
    """The levels of ``kneser_ney`` as tables, from all rows of (lang, gram, n)."""
    spark = counts.sparkSession
    numbers = spark.createDataFrame(list(enumerate(langs)), "j int, lang string")
    level = counts.join(F.broadcast(numbers), "lang").select("j", F.col("gram").alias("key"), F.col("n").cast("double").alias("n"))
    grams, contexts, discounts = [], [], []
    for k in range(ORDER, 0, -1):
        level = materialize(level, "language-level")
        few = {r["j"]: r for r in level.groupBy("j").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect()}
        discounts.append([discount(few[j]["ones"], few[j]["twos"]) for j in range(len(langs))])
        grams.append(level.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("j", "n"))).alias("n")))
        context = level.groupBy(F.shiftrightunsigned("key", 16).alias("key"), "j").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
        contexts.append(context.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("j", F.struct("total", "types")))).alias("context")))
        level = level.groupBy("j", suffix(F.col("key"), k - 1).alias("key")).agg(F.count("*").cast("double").alias("n")) if k > 1 else level
    return Tables(langs, grams[::-1], contexts[::-1], discounts[::-1], floor)


class Scorer:
    """Cross-entropy of texts; the cost of a distinct word is computed once while it is remembered."""

    def __init__(self, model: Model | Lookup, remember: int = 400_000):
        self.model, self.limit = model, remember
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.langs) + 1))

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """(texts, languages) bits per character; rows of texts without a letter are nan."""
        runs = [letter_runs(t) for t in texts]
        words: set[str] = set()
        for r in runs:
            words.update(r)
        new = list(words.difference(self.row))
        if len(self.row) + len(new) > self.limit:
            self.row.clear()
            new = list(words)
        at = len(self.row)
        while at + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if new:
            key, size = grams(new)
            distinct, inverse = np.unique(key, return_inverse=True)
            cost = np.add.reduceat(self.model.bits(distinct)[inverse], np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0)
            self.table[at:at + len(new)] = np.concatenate([cost, size[:, None]], 1)
            self.row.update(zip(new, range(at, at + len(new)), strict=True))
        out = np.full((len(texts), len(self.model.langs)), np.nan)
        for i, r in enumerate(runs):
            if r:
                sums = self.table[np.fromiter(map(self.row.__getitem__, r), np.int64, len(r))].sum(0)
                out[i] = sums[:-1] / sums[-1]
        return out

    def measure(self, texts: list[str | None]) -> pd.DataFrame:
        """The bits per character of each text in all languages; null without a letter."""
        return pd.DataFrame({"bits": [None if np.isnan(e[0]) else e.tolist() for e in self.entropies(texts)]}, dtype=object)

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """Language, score and rejection; without a letter, or without any learned language, ``und`` and score 0."""
        m = self.model
        if not m.langs:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "entropy": np.nan, "rejected": True}, index=range(len(texts)))
        e = self.entropies(texts)
        none = np.isnan(e[:, 0])
        e0 = np.where(none[:, None], 0.0, e)
        best = e0.argmin(1)
        low = e0[np.arange(len(e0)), best]
        score = 1 / np.exp(-m.temperature * (e0 - low[:, None])).sum(1)
        bound = np.array(m.reject or [np.inf] * len(m.langs))[best]
        lang = np.where(none, UNKNOWN, np.array(m.langs, object)[best])
        return pd.DataFrame({"lang_pred": lang, "score": np.where(none, 0.0, score), "entropy": np.where(none, np.nan, low), "rejected": none | (low > bound)})


def calibrate(model: Model | Tables, known: DataFrame, lang_col: str, text_col: str) -> Model | Tables:
    """Temperature of least log loss on all given texts, and for each language the 99.5 % bound of entropy plus half a bit.

    Texts are scored in their tasks. The driver gets a sum for each temperature, and the texts of a language counted by their
    entropy in steps of 1 / 1024 bit, so a bound is the upper end of its step.
    """
    if not model.langs:
        return model
    rows = scored(known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), model, ["lang"], "text", Scorer.measure, ENTROPIES)
    at = F.array_position(F.array(*map(F.lit, model.langs)), F.col("lang")).cast("int")
    rows = rows.select("lang", at.alias("j"), "p.bits")
    rows = rows.select("lang", F.element_at("bits", F.col("j")).alias("own"), F.transform("bits", lambda x: x - F.array_min("bits")).alias("over"), "j")

    def loss(t: float) -> Column:
        every = F.aggregate("over", F.lit(0.0), lambda acc, x: acc + F.exp(F.lit(-t) * x))
        return F.log(every) + F.lit(t) * F.element_at("over", F.col("j"))

    step = F.floor(F.col("own") * STEPS).cast("long")
    got = rows.groupBy("lang", step.alias("step")).agg(F.count("*").alias("n"), *[F.sum(loss(t)).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]).toPandas()
    # Texts without a letter have no step; a filter before the sums would score every text twice.
    got = got[got["step"].notna()]
    if not len(got):
        return model
    t = TEMPERATURES[int(np.argmin([got[f"t{i}"].sum() for i in range(len(TEMPERATURES))]))]

    def bound(lang: str) -> float:
        of = got[got["lang"] == lang].sort_values("step")
        if not len(of):
            return np.inf
        n = of["n"].cumsum().to_numpy()
        return (int(of["step"].iloc[int(np.searchsorted(n, 0.995 * n[-1]))]) + 1) / STEPS + 0.5

    return replace(model, temperature=t, reject=tuple(bound(x) for x in model.langs))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_grams: int = 1_000_000) -> Model | Tables:
    """Models from all texts outside the held-out fold that have a language, with all their n-grams.

    A model of at most ``max_grams`` n-grams over all languages can be sent to the tasks; a larger one stays in tables, and is
    for ``predict`` only. The same texts calibrate the scores.
    """
    known = docs.where(F.col(lang_col).isNotNull() & (fold(id_col) != 0))
    counts = materialize(count_grams(known, lang_col, text_col), "language-grams")
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    floor = 1.0 / (max(1, counts.select(suffix(F.col("gram"), 1)).distinct().count()) + 1)
    if sum(sizes.values()) <= max_grams:
        got = counts.toPandas()
        parts = dict(list(got.groupby("lang")))
        model = Model(langs, [kneser_ney(parts[x]["gram"].to_numpy().view(np.uint64), parts[x]["n"].to_numpy()) for x in langs], floor)
    else:
        model = tabulate(counts, langs, floor)
    discard(counts)
    return calibrate(model, known, lang_col, text_col)


def scored_column(docs: DataFrame, model: Model, text_col: str, method: Callable[[Scorer, list[str | None]], pd.DataFrame], kind: str) -> Column:
    shared = share(docs.sparkSession, model)

    def make():
        s = Scorer(shared_value(shared))
        return lambda texts: pd.concat([method(s, p) for p in pieces(texts)] or [method(s, [])], ignore_index=True)

    return per_batch_struct(make, kind, F.col(text_col))


def predict_column(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Struct (lang_pred, score, entropy, rejected) of each whole text."""
    return scored_column(docs, model, text_col, Scorer.predict, KIND)


def predict(docs: DataFrame, model: Model | Tables, keep: list[str], text_col: str = "text", chunk_chars: int = 1 << 22) -> DataFrame:
    """Columns ``keep`` and ``p``, the struct of ``predict_column``, of each row, for a model of any size."""
    return scored(docs, model, keep, text_col, Scorer.predict, KIND, chunk_chars)


def scored(docs: DataFrame, model: Model | Tables, keep: list[str], text_col: str, method: Callable[[Scorer, list[str | None]], pd.DataFrame],
           kind: str, chunk_chars: int = 1 << 22) -> DataFrame:
    """Columns ``keep`` and ``p``, the struct ``kind`` that a method of the scorer gives for each text.

    With tables, the rows are written once in chunks of about ``chunk_chars`` characters (a text is never cut); each chunk's
    distinct n-grams get their costs by joins, and the costs meet the chunk again.
    """
    if isinstance(model, Model):
        return docs.select(*keep, scored_column(docs, model, text_col, method, kind).alias("p"))
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    names, langs, temperature, reject = rows.columns, model.langs, model.temperature, model.reject
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    struct = ARROW[kind]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, first = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            chars = np.array([len(t) if t else 0 for t in batch.column(len(names) - 1).to_pylist()], np.int64) + 1
            at = held + np.cumsum(chars)
            held = int(at[-1]) if len(at) else held
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first + at // chunk_chars)], [*names, "chunk"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, words = None, set()

        def drain() -> Iterator[pa.RecordBatch]:
            if words:
                key = np.unique(grams(list(words))[0]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), chunk, np.int64)), pa.array(key)], ["chunk", "gram"])
                words.clear()

        for batch in batches:
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if c != chunk:
                    yield from drain()
                    chunk = c
                words.update(letter_runs(text))
        yield from drain()

    def answer(texts: pa.Table, costs: pa.Table) -> pa.Table:
        flat = costs.column("cost").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        known = Lookup.of(langs, costs.column("gram").to_numpy(), flat, temperature=temperature, reject=reject)
        scorer = Scorer(known)
        got = pd.concat([method(scorer, p) for p in pieces(texts.column("text").to_pylist())], ignore_index=True)
        p = [pa.array(got[f.name].tolist(), f.type, from_pandas=True) for f in struct]
        return pa.table([*[texts.column(c) for c in names[:-1]], pa.StructArray.from_arrays(p, fields=list(struct))], [*names[:-1], "p"])

    chunks = materialize(rows.mapInArrow(deal, f"{fields}, text string, chunk long"), "language-chunks")
    asked = chunks.select("chunk", "text").mapInArrow(ask, "chunk long, gram long").distinct()
    costs = model.costs(asked).select("chunk", "gram", "cost")
    out = chunks.groupBy("chunk").cogroup(costs.groupBy("chunk")).applyInArrow(answer, f"{fields}, p struct<{', '.join(x.replace(' ', ':') for x in kind.split(', '))}>")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "p")
