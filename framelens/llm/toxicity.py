"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word enters as a hashed word vector joined with the mean vector of its character triples. The network reads windows of
consecutive words that overlap, so that the whole text is covered; attention pooling and a linear layer give a logit per
window. A text's logit is its largest window logit, calibrated on labelled texts.

Training takes, of each toxic text, the window with the word of the strongest log odds, since a toxic text has few toxic
passages, and several windows of each clean text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import labelled_sample, per_batch, pieces, platt, share, shared_value, sigmoid

# Half a window: any passage of up to 20 words lies whole in one.
WINDOW, STRIDE = 40, 20
VOCABULARY, CHAR_SLOTS, WORD_DIM, CHAR_DIM, HIDDEN = 1 << 13, 1 << 12, 8, 6, 8
DIM = WORD_DIM + CHAR_DIM


class BiGru:
    """Both directions in one state of 2H values; blocks of zeros keep the halves apart.

    A step reads the input of the forward half at time t joined with that of the backward half at the mirrored time. Gate
    columns are update (both halves), reset (both halves) and candidate (both halves).
    """

    def __init__(self, rng, dim: int, hidden: int):
        self.dim, self.hidden = dim, hidden
        d, h = dim, hidden
        self.free = {"w": np.zeros((2 * d, 6 * h), np.float32), "gates": np.zeros((2 * h, 4 * h), np.float32), "cand": np.zeros((2 * h, 2 * h), np.float32)}
        for k in (0, 1):
            for j in range(3):
                cols = slice(j * 2 * h + k * h, j * 2 * h + (k + 1) * h)
                self.free["w"][k * d:(k + 1) * d, cols] = 1
                self.free["gates" if j < 2 else "cand"][k * h:(k + 1) * h, cols if j < 2 else slice(k * h, (k + 1) * h)] = 1
        self.p = {k: (rng.uniform(-1, 1, f.shape) / np.sqrt(h)).astype(np.float32) * f for k, f in self.free.items()}
        self.p |= {"b": np.zeros(6 * h, np.float32), "att": np.zeros(2 * h, np.float32)}

    def run(self, v: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """States (batch, time, 2H) of inputs (batch, time, dim); ``keep`` takes what the backward pass needs."""
        n, steps, _ = v.shape
        h = self.hidden
        both = np.concatenate([v, v[:, ::-1]], 2).transpose(1, 0, 2)
        x = np.ascontiguousarray(both).reshape(steps * n, -1) @ self.p["w"] + self.p["b"]
        x = x.reshape(steps, n, -1)
        whole = bool(mask.all())
        m = np.stack([mask, mask[:, ::-1]], 2).repeat(h, 2).astype(np.float32)
        state = np.zeros((n, 2 * h), np.float32)
        out = np.empty((n, steps, 2 * h), np.float32)
        trace = []
        for t in range(steps):
            zr = x[t, :, :4 * h] + state @ self.p["gates"]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = (zr[:, :2 * h] if whole else zr[:, :2 * h] * m[:, t]), zr[:, 2 * h:]
            c = np.tanh(x[t, :, 4 * h:] + (state * r) @ self.p["cand"])
            if keep is not None:
                trace.append((state, zr, z, r, c))
            state = state + z * (c - state)
            out[:, t, :h] = state[:, :h]
            out[:, steps - 1 - t, h:] = state[:, h:]
        if keep is not None:
            keep |= {"trace": trace, "m": m, "both": both}
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        e = np.where(mask > 0, states @ self.p["att"], np.float32(-1e9))
        a = np.exp(e - e.max(1, keepdims=True)) * (mask > 0)
        a = (a / np.maximum(a.sum(1, keepdims=True), 1e-9)).astype(np.float32)
        if keep is not None:
            keep |= {"states": states, "a": a}
        return (a[:, None, :] @ states)[:, 0]

    def forward(self, v: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        return self.pool(self.run(v, mask, keep), mask, keep)

    def backward(self, d_pooled: np.ndarray, keep: dict) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of the input."""
        states, a, h, m = keep["states"], keep["a"], self.hidden, keep["m"]
        d_a = (states @ d_pooled[:, :, None])[:, :, 0]
        d_e = a * (d_a - (d_a * a).sum(1, keepdims=True))
        g = {"att": np.einsum("nt,nth->h", d_e, states)}
        d_states = a[:, :, None] * d_pooled[:, None, :] + d_e[:, :, None] * self.p["att"]
        n, steps, _ = states.shape
        gates, cand = self.p["gates"], self.p["cand"]
        g["gates"], g["cand"] = np.zeros_like(gates), np.zeros_like(cand)
        d_x = np.empty((steps, n, 6 * h), np.float32)
        d_state = np.zeros((n, 2 * h), np.float32)
        for t in range(steps - 1, -1, -1):
            prev, zr, z, r, c = keep["trace"][t]
            d_state = d_state + np.concatenate([d_states[:, t, :h], d_states[:, steps - 1 - t, h:]], 1)
            d_c = d_state * z * (1 - c * c)
            full = zr[:, :2 * h]
            d_z = d_state * (c - prev) * m[:, t] * full * (1 - full)
            d_rp = d_c @ cand.T
            d_zr = np.concatenate([d_z, d_rp * prev * r * (1 - r)], 1)
            g["gates"] += prev.T @ d_zr
            g["cand"] += (prev * r).T @ d_c
            d_x[t, :, :4 * h], d_x[t, :, 4 * h:] = d_zr, d_c
            d_state = d_state * (1 - z) + d_rp * r + d_zr @ gates.T
        flat = d_x.reshape(steps * n, -1)
        g["w"] = keep["both"].reshape(steps * n, -1).T @ flat
        g["b"] = flat.sum(0)
        d_both = (flat @ self.p["w"].T).reshape(steps, n, -1).transpose(1, 0, 2)
        for k, f in self.free.items():
            g[k] *= f
        return g, d_both[:, :, :self.dim] + d_both[:, ::-1, self.dim:]


def char_slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the byte triples of each word, which is framed by two zero bytes and one; and where each word begins."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 3
    b = np.frombuffer(b"".join([b"\0\0%b\0" % w for w in words]), np.uint8).astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    slot = ((code * np.uint32(2654435761)) >> np.uint32(32 - 12)).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    inside = np.ones(len(slot), bool)
    ends = begin[1:]
    inside[ends - 2] = inside[ends - 1] = False  # triples that span two words
    return slot[inside], begin - 2 * np.arange(len(words))


@dataclass
class Network:
    """The whole model; ``out`` maps a pooled window to a logit, ``slope`` and ``offset`` calibrate a text's logit."""

    seed: int = 11
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None
    known: dict[bytes, int] = field(default_factory=dict)  # row of each word that has a vector of its own; 0: none
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.gru = BiGru(rng, DIM, HIDDEN)
        self.extra = {
            "chars": rng.normal(0, 0.3, (CHAR_SLOTS, CHAR_DIM)).astype(np.float32),
            "words": np.zeros((VOCABULARY, WORD_DIM), np.float32),
            "out": rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), "bias": np.zeros(1, np.float32),
        }

    def inputs(self, words: list[bytes], keep: dict | None = None) -> np.ndarray:
        """The vector of each word: its hashed word vector and the mean of its character-triple vectors."""
        slots = np.fromiter((self.known.get(w, 0) for w in words), np.int64, len(words))
        chars, begin = char_slots(words)
        share = np.diff(np.append(begin, len(chars)))
        if keep is not None:
            keep |= {"slots": slots, "chars": chars, "share": share}
        mean = np.add.reduceat(self.extra["chars"][chars], begin, axis=0) / share[:, None].astype(np.float32)
        return np.concatenate([self.extra["words"][slots], mean], 1)

    def params(self) -> dict[str, np.ndarray]:
        return {f"gru.{k}": v for k, v in self.gru.p.items()} | self.extra

    def gradients(self, words: list[bytes], ids: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the weighted log loss over windows of word numbers; also the logits."""
        low: dict = {}
        high: dict = {}
        vectors = self.inputs(words, low)
        pooled = self.gru.forward(vectors[ids], mask, high)
        logit = pooled @ self.extra["out"] + self.extra["bias"][0]
        d = ((sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
        gw, dx = self.gru.backward(d[:, None] * self.extra["out"], high)
        g = {f"gru.{k}": v for k, v in gw.items()} | {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
        dv = np.zeros_like(vectors)
        np.add.at(dv, ids.ravel(), (dx * mask[:, :, None]).reshape(-1, dx.shape[2]))
        g["words"] = np.zeros_like(self.extra["words"])
        np.add.at(g["words"], low["slots"], dv[:, :WORD_DIM])
        g["words"][0] = 0
        g["chars"] = np.zeros_like(self.extra["chars"])
        np.add.at(g["chars"], low["chars"], np.repeat(dv[:, WORD_DIM:] / low["share"][:, None], low["share"], axis=0))
        return g, logit


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover n words; the last one ends with the text."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


class Scorer:
    """Window logits of many texts at once; vectors of distinct words are remembered up to a bound."""

    def __init__(self, net: Network, remember: int = 400_000, batch: int = 512):
        self.net, self.limit, self.batch = net, remember, batch
        self.row: dict[bytes, int] = {}
        self.table = np.zeros((1024, DIM), np.float32)

    def _learn(self, words: set[bytes]) -> None:
        new = list(words.difference(self.row))
        if len(self.row) + len(new) > self.limit:
            self.row.clear()
            new = list(words)
        for k in range(0, len(new), 8192):
            part = new[k:k + 8192]
            at = len(self.row)
            while at + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at:at + len(part)] = self.net.inputs(part)
            self.row.update(zip(part, range(at, at + len(part)), strict=True))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The largest window logit of each text; an empty one has that of a window without words."""
        net = self.net
        empty = float(net.extra["bias"][0])
        tokens = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        vocabulary: set[bytes] = set()
        for ws in tokens:
            vocabulary.update(ws)
        self._learn(vocabulary)
        best = np.full(len(texts), -np.inf)
        owner, start, stop, flat, at = [], [], [], [], 0
        for i, ws in enumerate(tokens):
            flat.append(np.fromiter(map(self.row.__getitem__, ws), np.int64, len(ws)))
            for a, b in windows(len(ws)):
                owner.append(i)
                start.append(at + a)
                stop.append(at + b)
            at += len(ws)
        if not owner:
            return np.full(len(texts), empty)
        ids = np.concatenate(flat)
        own, lo, hi = np.array(owner), np.array(start), np.array(stop)
        order = np.argsort(hi - lo, kind="stable")
        for k in range(0, len(order), self.batch):
            part = order[k:k + self.batch]
            width = int((hi[part] - lo[part]).max())
            where = lo[part][:, None] + np.arange(width)
            mask = (where < hi[part][:, None]).astype(np.float32)
            pooled = net.gru.forward(self.table[ids[np.minimum(where, len(ids) - 1)]], mask)
            np.maximum.at(best, own[part], pooled @ net.extra["out"] + empty)
        return np.where(np.isinf(best), empty, best)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.net.constant is not None:
            return np.full(len(texts), self.net.constant)
        return sigmoid(self.net.slope * self.logits(texts) + self.net.offset)


def log_odds(tokens: list[list[int]], y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Log ratio of the shares of toxic and clean texts that hold each word, drawn towards 0 for few texts; number of texts."""
    held = {c: np.zeros(size) for c in (0, 1)}
    for ws, c in zip(tokens, y, strict=True):
        held[c][np.unique(np.array(ws, np.int64))] += 1
    n = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    prior = 4 * (held[0] + held[1] + 1) / (n[0] + n[1] + 2)
    return np.log((held[1] + prior) / (n[1] + 4)) - np.log((held[0] + prior) / (n[0] + 4)), held[0] + held[1]


def fit(texts: list[str | None], y: np.ndarray, totals: dict[int, int], clean_windows: int = 3, steps: int = 600, batch: int = 32,
        rate: float = 0.02, least: int = 5, seed: int = 11) -> Network:
    """Train on windows of the sample; a third of the texts is kept aside for the calibration.

    A toxic text has few toxic passages: it gives the window with the strongest word, by the log odds of words in toxic
    and clean texts, a clean text gives its own strongest window and ``clean_windows - 1`` random ones.
    With one class only, or no rows, every text gets the share of class 1 among the labels (0.5 without labels).
    """
    net = Network(seed)
    n1 = int((y == 1).sum())
    if min(n1, len(y) - n1) < 6:
        net.constant = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
        return net
    rng = np.random.default_rng(seed)
    aside = np.zeros(len(y), bool)
    for c in (0, 1):
        aside[rng.permutation(np.flatnonzero(y == c))[::3]] = True
    numbers: dict[bytes, int] = {}
    inside = rng.permutation(np.flatnonzero(~aside))
    tokens = [[numbers.setdefault(w, len(numbers)) for w in (texts[i] or "").encode("utf-8", "surrogatepass").lower().split()] for i in inside]
    odds, texts_with = log_odds(tokens, y[inside], len(numbers))
    vocabulary = list(numbers)
    frequent = [int(k) for k in np.argsort(-texts_with, kind="stable")[:VOCABULARY - 1] if texts_with[k] >= least]
    net.known = {vocabulary[k]: i + 1 for i, k in enumerate(frequent)}
    net.extra["words"][1:] = rng.normal(0, 0.1, (VOCABULARY - 1, WORD_DIM))
    # A word is as strong as itself or as the strongest run of five bytes in it, if enough texts hold them.
    runs: dict[bytes, int] = {}
    parts = [[runs.setdefault(x, len(runs)) for x in {(b" %b " % w)[k:k + 5] for k in range(max(1, len(w) - 2))}] for w in vocabulary]
    run_odds, run_texts = log_odds([[r for w in set(ws) for r in parts[w]] for ws in tokens], y[inside], len(runs))
    run_odds[run_texts < least] = -9
    strength = np.maximum(np.where(texts_with < least, -9, odds), [run_odds[p].max() for p in parts])
    rows, truth = [], []
    for ws, c in zip(tokens, y[inside], strict=True):
        got = windows(len(ws))
        if not got:
            continue
        best = int(np.argmax([strength[ws[a:b]].max() for a, b in got]))
        for k in {best} | ({int(x) for x in rng.permutation(len(got))[:clean_windows - 1]} if c == 0 else set()):
            rows.append(ws[got[k][0]:got[k][1]])
            truth.append(float(c))
    truth = np.array(truth)
    weight = np.where(truth == 1, 0.5 / max(1, (truth == 1).sum()), 0.5 / max(1, (truth == 0).sum())) * len(truth)
    params = net.params()
    m = {k: np.zeros_like(v) for k, v in params.items()}
    v = {k: np.zeros_like(p) for k, p in params.items()}
    step, epochs = 0, max(5, -(-steps * batch // max(1, len(rows))))
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            part = order[k:k + batch]
            width = max(len(rows[i]) for i in part)
            ids = np.zeros((len(part), width), np.int64)
            mask = np.zeros((len(part), width), np.float32)
            for j, i in enumerate(part):
                ids[j, :len(rows[i])], mask[j, :len(rows[i])] = rows[i], 1
            used, inverse = np.unique(ids, return_inverse=True)
            g, _ = net.gradients([vocabulary[u] for u in used], inverse.reshape(ids.shape), mask, truth[part], weight[part])
            step += 1
            size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for name, p in params.items():
                d = g[name] * min(1.0, 1.0 / (size + 1e-9))
                m[name] = 0.9 * m[name] + 0.1 * d
                v[name] = 0.99 * v[name] + 0.01 * d * d
                p -= rate * (1 - epoch / epochs) * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v[name] / (1 - 0.99 ** step)) + 1e-8)
    held = np.flatnonzero(aside)
    logit = Scorer(net).logits([texts[i] for i in held])
    share = np.where(y[held] == 1, totals[1] / max(1, (y[held] == 1).sum()), totals[0] / max(1, (y[held] == 0).sum()))
    net.slope, net.offset = platt(logit, y[held], share / share.mean())
    return net


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", sample_rows: int = 1500, id_col: str = "doc_id",
          text_col: str = "text") -> Network:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out fold (the documented bound of the sample)."""
    sample, totals = labelled_sample(docs, labels, target, sample_rows, id_col, text_col)
    got = sample.orderBy("id").collect()
    return fit([r["text"] for r in got], np.array([r["y"] for r in got], int), totals)


def score_column(docs: DataFrame, net: Network, text_col: str = "text") -> Column:
    """Score of each whole text, 0 to 1. Null, empty and blank texts get the score of a window without words."""
    shared = share(docs.sparkSession, net)

    def make():
        scorer = Scorer(shared_value(shared))
        return lambda texts: pd.Series(np.concatenate([scorer.scores(p) for p in pieces(texts)] or [np.empty(0)]))

    return per_batch(make, "double", F.col(text_col))
