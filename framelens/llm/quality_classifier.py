"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a hinge-loss linear model.

Features of a text are the hashed indicators of its words, word pairs, runs of one word and byte triples (lower-cased in
A-Z). Each is scaled by the log ratio of its smoothed counts in the two classes; dual coordinate descent fits the hinge
loss, and a logistic curve through out-of-fold margins turns margins into scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import WordHash, labelled_sample, mix64, per_batch, platt, share, shared_value, sigmoid

BITS = 18
# Words whose hashes a task remembers; some 20 MB.
REMEMBER = 150_000
PAIR = np.uint64(0xD1342543DE82EF95)
RUN_OF_TWO, RUN_OF_THREE = 1, 2


def indicators(text: str | None, words: WordHash, bits: int = BITS) -> np.ndarray:
    """The distinct feature numbers of a text; a null or empty text has none."""
    if not text:
        return np.empty(0, np.int64)
    low = text.encode("utf-8", "surrogatepass").lower()
    ids = words.of(low.split())
    parts = [mix64(ids)]
    if len(ids) > 1:
        same = ids[1:] == ids[:-1]
        parts.append(mix64(ids[:-1] * PAIR + ids[1:])[~same])
        if same.any():
            parts.append(np.array([RUN_OF_TWO], np.uint64) << np.uint64(64 - bits))
            if (same[1:] & same[:-1]).any():
                parts.append(np.array([RUN_OF_THREE], np.uint64) << np.uint64(64 - bits))
    b = np.frombuffer(low, np.uint8).astype(np.uint64)
    if len(b) > 2:
        seen = np.unique((b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:])
        parts.append(mix64(seen + np.uint64(1 << 40)))
    return np.unique((np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64))


@dataclass(frozen=True)
class Model:
    """``ratio``: scale of each feature; ``weight``: fitted weight times scale; ``slope``/``offset``: margin to score."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, feats: np.ndarray) -> float:
        if not len(feats):
            return self.bias
        norm = float(np.sqrt((self.ratio[feats] ** 2).sum()))
        return float(self.weight[feats].sum()) / (norm or 1.0) + self.bias

    def score(self, feats: np.ndarray) -> float:
        return float(sigmoid(self.slope * self.margin(feats) + self.offset))


def fit_linear(rows: list[np.ndarray], y: np.ndarray, bits: int, cost: np.ndarray, epochs: int, seed: int) -> Model:
    """Log-count ratios of the rows, then dual coordinate descent on the hinge loss (``cost``: bound of each dual value)."""
    size = 1 << bits
    count = {c: np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t == c] or [np.empty(0, np.int64)]), minlength=size) + 1.0 for c in (0, 1)}
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    scaled = []
    for r in rows:
        v = ratio[r]
        scaled.append(v / (np.sqrt((v * v).sum()) or 1.0))
    w, bias = np.zeros(size), 0.0
    sign = np.where(y == 1, 1.0, -1.0)
    dual = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], scaled[i]
            gradient = sign[i] * (w[r] @ v + bias) - 1.0
            new = min(max(dual[i] - gradient / ((1.0 if len(r) else 0.0) + 1.0), 0.0), cost[i])
            step = (new - dual[i]) * sign[i]
            if step:
                dual[i] = new
                w[r] += step * v
                bias += step
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return Model(ratio.astype(np.float32), (w * ratio).astype(np.float32), bias, 1.0, 0.0)


def fit(rows: list[np.ndarray], y: np.ndarray, totals: dict[int, int], bits: int = BITS, cost: float = 1.0, epochs: int = 12,
        folds: int = 3, seed: int = 7) -> Model:
    """A calibrated model. With one class only, or no rows, every text gets the share of class 1 (0.5 without labels)."""
    n = {c: int((y == c).sum()) for c in (0, 1)}
    if min(n.values()) < folds:
        all_rows = sum(totals.values())
        share = (totals.get(1, 0) + 1) / (all_rows + 2)
        zero = np.zeros(1 << bits, np.float32)
        return Model(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))
    costs = cost * np.where(y == 1, len(y) / (2 * n[1]), len(y) / (2 * n[0]))
    part = np.random.default_rng(seed).permutation(len(y)) % folds
    margin = np.zeros(len(y))
    for k in range(folds):
        inside = np.flatnonzero(part != k)
        m = fit_linear([rows[i] for i in inside], y[inside], bits, costs[inside], epochs, seed + k)
        for i in np.flatnonzero(part == k):
            margin[i] = m.margin(rows[i])
    # The sample is balanced; weights restore the shares that the classes have among all labels.
    weight = np.where(y == 1, totals[1] / n[1], totals[0] / n[0])
    slope, offset = platt(margin, y, weight / weight.mean())
    m = fit_linear(rows, y, bits, costs, epochs, seed)
    return Model(m.ratio, m.weight, m.bias, slope, offset)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample_rows: int = 4000, bits: int = BITS,
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out fold (the documented bound of the sample)."""

    @F.pandas_udf("binary")
    def features(texts: pd.Series) -> pd.Series:
        words = WordHash(REMEMBER)
        return texts.map(lambda t: indicators(t, words, bits).astype(np.int32).tobytes(), na_action=None)

    sample, totals = labelled_sample(docs, labels, target, sample_rows, id_col, text_col)
    got = sorted(sample.select("id", "y", features("text").alias("f")).collect(), key=lambda r: r["id"])
    return fit([np.frombuffer(r["f"], np.int32) for r in got], np.array([r["y"] for r in got], int), totals, bits)


def score_column(docs: DataFrame, model: Model, text_col: str = "text", bits: int = BITS) -> Column:
    """Score of each text, 0 to 1. A null or empty text is scored by its bias, like any text without known features."""
    shared = share(docs.sparkSession, model)

    def make():
        words, m = WordHash(REMEMBER), shared_value(shared)
        return lambda texts: pd.Series([m.score(indicators(t, words, bits)) for t in texts], dtype="float64")

    return per_batch(make, "double", F.col(text_col))
