"""Quality rules: a linear-chain conditional random field labels the lines of a text as content or boilerplate.

Viterbi decoding gives the lines' labels; the share of words in content lines decides whether a text is kept. The field is
trained here, from two views of a line that share nothing. One view is only seen in training and gives the labels: lines that
repeat, and rows of symbols, digits or repeated words, are boilerplate. The other view (length, ends, capitals, the shape of
words) is what the field decides by, with the labels of the neighbouring lines; weights are fitted by the likelihood of whole
line sequences. So a line is not boilerplate because it repeats, but because it and its neighbours look like lines that do.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import WordHash, mix64, per_batch_struct, share, shared_value

# Fixed values of the base rules.
SYMBOLS = re.compile(r"[#*$%&|<>]")
LEAST_WORDS, REPEAT_PERCENT = 50, 50
CONTENT, BOILERPLATE = 0, 1
N_FEATURES = 24
SPACES = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def line_features(line: str, words: list[bytes], repeated: bool) -> list[int]:
    """Numbers of the indicators that hold for a line with at least one word."""
    n = len(words)
    chars = len(line)
    out = [0, 1 + (n > 2) + (n > 5) + (n > 12) + (n > 30)]
    symbols = len(SYMBOLS.findall(line))
    out.append(6 + (symbols > 0) + (5 * symbols > n) + (2 * symbols > n))
    digits = sum(map(str.isdigit, line)) if any(c in line for c in "0123456789") else 0
    out.append(10 + (20 * digits > chars) + (4 * digits > chars))
    distinct = len(set(words))
    out.append(13 + (3 * distinct < 2 * n) + (2 * distinct < n))
    out.append(16 if line.rstrip()[-1:] in ".!?:\"'" else 17)
    out.append(18 if line.lstrip()[:1].isupper() else 19)
    if repeated:
        out.append(20)
    if "|" in line:
        out.append(21)
    if chars > 12 * n:
        out.append(22)
    if n >= 3 and sum(len(w) for w in words) < 2 * n:
        out.append(23)
    return out


# The features of the view that gives the labels.
EVIDENT = frozenset({9, 12, 15, 20, 21})


def evident(features: list[int]) -> int:
    """The label of a line in training, by the view that the field does not see."""
    return BOILERPLATE if EVIDENT & set(features) else CONTENT


def inputs(features: list[int]) -> list[int]:
    """The view of a line that the field sees."""
    return [x for x in features if x not in EVIDENT]


@dataclass(frozen=True)
class Field:
    """``weight``: feature by label; ``move``: from label to label."""

    weight: np.ndarray
    move: np.ndarray

    def decode(self, lines: list[list[int]]) -> list[int]:
        """The most likely labels (Viterbi); ties go to content."""
        w = self.weight.tolist()
        (cc, cb), (bc, bb) = self.move.tolist()
        a = b = 0.0
        back = []
        for i, f in enumerate(lines):
            ea, eb = sum(w[x][0] for x in f), sum(w[x][1] for x in f)
            if i:
                from_a, from_b = (0 if a + cc >= b + bc else 1), (0 if a + cb >= b + bb else 1)
                a, b = (a + cc, b + bc)[from_a] + ea, (a + cb, b + bb)[from_b] + eb
                back.append((from_a, from_b))
            else:
                a, b = ea, eb
        label = 0 if a >= b else 1
        out = [label] if lines else []
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def fit(sequences: list[list[list[int]]], labels: list[list[int]], epochs: int = 8, rate: float = 0.2, seed: int = 5, decay: float = 1e-4) -> Field:
    """Maximise the conditional likelihood by stochastic gradient steps, with forward and backward sums."""
    w, t = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    gw, gt = np.full(w.shape, 1e-6), np.full(t.shape, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for s in rng.permutation(len(sequences)):
            lines, truth = sequences[s], labels[s]
            if not lines:
                continue
            e = np.array([w[f].sum(0) for f in lines])
            n = len(e)
            fwd, bwd = e.copy(), np.zeros_like(e)
            for i in range(1, n):
                fwd[i] += np.logaddexp.reduce(fwd[i - 1][:, None] + t, 0)
            for i in range(n - 2, -1, -1):
                bwd[i] = np.logaddexp.reduce(t + e[i + 1] + bwd[i + 1], 1)
            z = np.logaddexp.reduce(fwd[-1])
            p = np.exp(fwd + bwd - z)
            p[np.arange(n), truth] -= 1
            dw = decay * w
            for f, d in zip(lines, p, strict=True):
                dw[f] += d / n
            dt = decay * t
            for i in range(1, n):
                pair = np.exp(fwd[i - 1][:, None] + t + e[i] + bwd[i] - z)
                pair[truth[i - 1], truth[i]] -= 1
                dt += pair / n
            gw += dw * dw
            gt += dt * dt
            w -= rate * dw / np.sqrt(gw)
            t -= rate * dt / np.sqrt(gt)
    return Field(w, t)


def lines_of(text: str) -> tuple[list[list[bytes]], list[list[int]], int]:
    """Words and features of the lines that have a word, and how many of them equal an earlier line."""
    seen: set[str] = set()
    words, features, repeats = [], [], 0
    for line in text.split("\n"):
        ws = line.encode("utf-8", "surrogatepass").split()
        if not ws:
            continue
        again = line in seen
        seen.add(line)
        repeats += again
        words.append(ws)
        features.append(line_features(line, ws, again))
    return words, features, repeats


def repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a window of three words which the text holds at least twice."""
    if len(ids) < 4:
        return 0
    key = mix64(mix64(mix64(ids[:-2]) + ids[1:-1]) + ids[2:])
    _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    hit = n[inverse] > 1
    if not hit.any():
        return 0
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k:len(ids) - 2 + k] |= hit
    return int(covered.sum())


def sequences_of(text: str, lines: int = 400) -> list[list[list[int]]]:
    """Features of all lines of a text, as consecutive sequences of at most so many lines."""
    features = lines_of(text)[1]
    return [features[k:k + lines] for k in range(0, len(features), lines)]


def train(docs: DataFrame, sample_rows: int = 1500, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on all lines of at most ``sample_rows`` texts, the first by the hash of their id (the documented bound)."""
    ids = docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"))
    sequences = [s for r in got.orderBy("id").collect() for s in sequences_of(r["text"] or "")]
    return fit([[inputs(f) for f in s] for s in sequences], [[evident(f) for f in s] for s in sequences])


def rules_column(docs: DataFrame, field: Field, text_col: str = "text", least_share: float = 0.5) -> Column:
    """Struct of the base measures, ``content_share`` (1 without words), ``base_failed`` and ``kept`` of each whole text.

    A null or empty text has zeros, fails the base rule and is not kept.
    """
    shared = share(docs.sparkSession, field)

    def make():
        f, known = shared_value(shared), WordHash()

        def rules(texts: pd.Series) -> pd.DataFrame:
            out = []
            for t in texts:
                t = t or ""
                words, features, repeats = lines_of(t)
                n = sum(map(len, words))
                chars = len(t.translate(SPACES))
                again = repeat_words(known.of([w for line in words for w in line]))
                content = sum(len(ws) for ws, y in zip(words, f.decode([inputs(x) for x in features]), strict=True) if y == CONTENT)
                share = content / n if n else 1.0
                failed = n < LEAST_WORDS or 100 * again > REPEAT_PERCENT * n
                out.append((n, chars, len(SYMBOLS.findall(t)), repeats, again, share, failed, not failed and share >= least_share))
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share", "base_failed", "kept"]
            return pd.DataFrame(out, columns=names)

        return rules

    kind = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean"
    return per_batch_struct(make, kind, F.col(text_col))
