"""What several operators of this folder share: held-out folds, labelled samples, word hashes, broadcast models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.operators.scale import top_per_key

FOLDS = 5
# Fixed value: what separates words, as a character class of Java and RE2 patterns.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(FOLDS))


def held_out(id_col: str) -> Column:
    return (fold(id_col) == 0).alias("held_out")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, id_col: str = "doc_id",
                    text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample for fitting: at most ``rows / 2`` ids of each class outside the held-out fold, with their texts.

    Ids are taken in the order of their hash, so reruns agree. Also returns how many labelled ids each class has, so that
    a fit can undo the balance. Rows with a null id or label are left out; an id labelled twice counts with its larger
    label, a repeated id with its smallest text.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(target).isNotNull() & (fold(id_col) != 0))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.col(target)).cast("int").alias("y"))
    )
    totals = {int(r["y"]): int(r["n"]) for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # Of each class about twice the wanted ids have a hash below this; the others stay in their tasks.
    early = F.lit(False)
    for y, n in totals.items():
        below = min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, max(rows, 64) / n)))
        early = early | ((F.col("y") == y) & (F.xxhash64("id") <= F.lit(below)))
    some = top_per_key(known.where(early), ["y"], [F.xxhash64("id"), F.col("id")], rows // 2)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # At most `rows` narrow rows: the broadcast has a fixed bound.
    return texts.join(F.broadcast(some), "id").groupBy("id", "y").agg(F.min("text").alias("text")), totals


def share(spark: SparkSession, value) -> Broadcast:
    """Broadcast a model of bounded size together with the code of its classes."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared_value(broadcast: Broadcast):
    return cloudpickle.loads(broadcast.value)


class WordHash(dict):
    """xxh64 of byte words, remembered; the memory is cleared when it holds ``limit`` words."""

    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def pieces(texts: pd.Series | list, max_chars: int = 1 << 20) -> Iterator[list[str | None]]:
    """Cut a batch into runs of whole texts of about ``max_chars`` characters, so that working memory stays bounded."""
    part: list[str | None] = []
    held = 0
    for t in texts:
        part.append(t)
        held += len(t) if t else 0
        if held >= max_chars or len(part) >= 4096:
            yield part
            part, held = [], 0
    if part:
        yield part


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve through weighted (margin, label) pairs, by damped Newton steps."""
    a, b = 1.0, 0.0
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        g, h = weight * (p - goal), weight * p * (1 - p) + 1e-9
        ga, gb = (g * margin).sum() + 1e-3 * a, g.sum()
        haa, hab, hbb = (h * margin * margin).sum() + 1e-3, (h * margin).sum(), h.sum()
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 5.0 / max(abs(da), abs(db), 1e-9))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-7:
            break
    return float(a), float(b)


def per_batch(make: Callable[[], Callable[[pd.Series], pd.Series]], kind: str, column: Column) -> Column:
    """A column computed by ``make()(texts)`` on Arrow batches; ``make`` runs once for each task and partition."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = make()
        for texts in batches:
            yield f(texts)

    return run(column)


def per_batch_struct(make: Callable[[], Callable[[pd.Series], pd.DataFrame]], kind: str, column: Column) -> Column:
    """As ``per_batch`` for a struct of several fields."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = make()
        for texts in batches:
            yield f(texts)

    return run(column)
