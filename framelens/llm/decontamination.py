"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Words (lower-cased in A-Z, without outer punctuation) are the symbols. The CGK random walk reads a window word by word; at
each step a random bit of (step, word) says whether it moves on, so two windows within a small edit distance give embeddings
of small Hamming distance. Each repetition has a walk of its own and samples a few positions of the embedding; windows and
items that agree there in any repetition are compared exactly. Walks of edited passages drift apart, the more so the longer
the item, so the numbers of positions and repetitions are derived for each item size from passages with just as many edits as
the limit allows. Where no number within the bound reaches the target recall, every window is compared exactly.

Which windows are embedded: an item of n words within k edits of a passage shares with it a run of at least
(n - k) / (k + 1) unedited words, so windows are taken where a text holds such a run of an item. Nothing is lost by that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.llm.common import mix64, per_batch, pieces, share, shared_value

PUNCTUATION = b".,;:!?\"'()[]{}<>|*#$%&-_"
SAMPLED = (3, 2)  # positions per repetition: fewer where the first choice needs more than FEW repetitions
FEW, MOST = 24, 64  # repetitions; an item size that needs more than MOST is not hashed
WALKED = 128  # words; longer items are not hashed
TRIALS = 100  # edited passages of each kind from which the repetitions are derived
LONGEST_RUN = 3
CLASSES = 256  # the walk's random bits depend on one of so many classes of words


@dataclass
class Items:
    """A block of items: word numbers, edit limits, runs and LSH tables. Its size is bounded by the block's."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[bytes, int]
    limit: list[int]
    run_keys: dict[int, np.ndarray] = field(default_factory=dict)
    run_places: dict[int, list[list[tuple[int, int]]]] = field(default_factory=dict)
    bits: np.ndarray | None = None  # of all walks
    tables: dict[int, tuple] = field(default_factory=dict)  # by hashed size: sampled steps and, for each repetition, sorted keys and their items


def tokens(text: str | bytes) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return raw.lower().split()


def run_key(ids: np.ndarray, length: int) -> np.ndarray:
    """One value for each run of ``length`` words."""
    n = len(ids) - length + 1
    key = np.zeros(max(0, n), np.uint64)
    for k in range(length if n > 0 else 0):
        key = mix64(key + ids[k:k + n].astype(np.uint64) + np.uint64(1))
    return key


def walk_bits(size: int) -> np.ndarray:
    """The bit of (repetition, step, class of the word) of walks over up to ``size`` words."""
    return np.random.default_rng(1000).integers(0, 2, (MOST, steps(WALKED), CLASSES), np.int8)[:, :steps(size)]


def steps(size: int) -> int:
    """Steps in which a walk still reads words: it has used up ``size`` words after about twice as many."""
    return max(1, 8 * size // 5)


def sampled_steps(size: int, positions: int, repetitions: int) -> np.ndarray:
    """(repetitions, positions): the steps at which windows of ``size`` words are compared."""
    rng = np.random.default_rng([size, positions])
    return np.stack([rng.choice(steps(size), min(positions, steps(size)), replace=False) for _ in range(repetitions)])


def edited(item: np.ndarray, edits: int, kind: str, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The item after so many edits, amid other words, and for each word its place in the item, or -1."""
    n = len(item)
    kinds = rng.integers(0, 3, edits) if kind == "mixed" else np.full(edits, ("substitutions", "deletions", "insertions").index(kind))
    replaced, gone, new = (int((kinds == x).sum()) for x in range(3))
    at = rng.choice(n, replaced + gone, replace=False)
    source = np.arange(n)
    source[at[:replaced]] = -1
    source = np.delete(source, at[replaced:])
    source = np.insert(source, rng.integers(0, len(source) + 1, new), -1)
    source = np.concatenate([np.full(n, -1), source, np.full(n, -1)])
    return np.where(source < 0, rng.integers(1 << 40, 1 << 41, len(source)), item[source]), source


@lru_cache(4096)
def repetitions(size: int, edits: int, run: int, recall: float) -> tuple[int, int]:
    """(positions, repetitions) with which passages ``edits`` edits away from an item of ``size`` words reach the recall.

    Measured for each kind of edit on windows around shared runs of ``run`` words; the worst kind counts, and the share of
    misses is halved as a margin for the error of measurement. (0, 0): not within ``MOST`` repetitions.
    """
    rng = np.random.default_rng([size, edits])
    bits = walk_bits(size)
    items = rng.integers(0, 1 << 40, (TRIALS, size))
    groups = []
    for kind in ("mixed", "substitutions", "deletions", "insertions"):
        rows, trial = [], []
        for t, item in enumerate(items):
            text, source = edited(item, edits, kind, rng)
            held = source[:len(source) - run + 1] >= 0
            for k in range(1, run):
                held &= source[k:len(source) - run + 1 + k] == source[:len(source) - run + 1] + k
            at = np.flatnonzero(held)
            for begin in np.unique(np.maximum(0, at - source[at])).tolist():
                part = text[begin:begin + size]
                rows.append(np.concatenate([part, np.full(size - len(part), -1)]))
                trial.append(t)
        groups.append((np.array(rows).reshape(-1, size), np.array(trial, np.int64)))
    best = (0, 0)
    for positions in SAMPLED:
        where = sampled_steps(size, positions, MOST)
        own = signatures(items, size, bits, where)
        need = 1
        for rows, trial in groups:
            hit = np.zeros((TRIALS, MOST), bool)
            np.logical_or.at(hit, trial, signatures(rows, size, bits, where) == own[trial])
            miss = 1 - hit.mean(1)
            reached = (miss[:, None] ** np.arange(1, MOST + 1)).mean(0) <= (1 - recall) / 2
            need = max(need, int(reached.argmax()) + 1 if reached.any() else MOST + 1)
        if need <= MOST and (not best[1] or need < best[1]):
            best = positions, need
        if 0 < best[1] <= FEW:
            break
    return best


def hashing(size: int, limit: int, recall: float) -> tuple[int, int]:
    """``repetitions`` of the next multiple of five words, whose walks drift further, at the same share of edits or more."""
    if limit == 0:
        return SAMPLED[0], 1
    grid = -(-size // 5) * 5
    if size > WALKED - 4 or limit >= size:
        return 0, 0
    return repetitions(grid, -(-limit * grid // size), run_length(size, limit), recall)


def run_length(size: int, limit: int) -> int:
    """Words of a run that any passage within the limit shares with an item of ``size`` words."""
    return max(1, min(LONGEST_RUN, (size - limit) // (limit + 1)))


def signatures(windows: np.ndarray, size: int, bits: np.ndarray, where: np.ndarray) -> np.ndarray:
    """(windows, repetitions): value of the sampled positions of each window's CGK embeddings.

    Windows are rows of word numbers, padded by -1 on the right; a walk that has read all ``size`` words stays behind them.
    """
    n, reps = len(windows), len(where)
    padded = np.concatenate([windows, np.full((n, 1), -1)], 1)
    classes = (mix64((padded + 2).astype(np.uint64)) >> np.uint64(64 - 8)).astype(np.int64)
    at = np.zeros((n, reps), np.int64)
    key = np.broadcast_to(np.arange(reps, dtype=np.uint64), (n, reps)).copy()
    rows, columns = np.arange(n)[:, None], np.arange(reps)[None, :]
    for step in range(int(where.max()) + 1):
        wanted = np.flatnonzero((where == step).any(1))
        if len(wanted):
            key[:, wanted] = mix64(key[:, wanted] + (padded[rows, at[:, wanted]] + 2).astype(np.uint64))
        at += bits[columns, step, classes[rows, at]]
        np.minimum(at, size, out=at)
    return key


def build(rows: list[tuple[int, str | None]], max_share: float, recall: float) -> Items:
    """Index a block of (id, text). Items without a word are left out: they match nothing."""
    it = Items([], [], {}, [])
    runs: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for item_id, text in rows:
        ws = [w for w in (t.strip(PUNCTUATION) or t for t in tokens(text or "")) if w]
        if not ws:
            continue
        ids = np.array([it.vocabulary.setdefault(w, len(it.vocabulary)) for w in ws], np.int64)
        k = int(max_share * len(ids))
        j = len(it.ids)
        it.ids.append(item_id)
        it.words.append(ids)
        it.limit.append(k)
        length = run_length(len(ids), k)
        for offset, key in enumerate(run_key(ids, length).tolist()):
            runs.setdefault(length, {}).setdefault(key, []).append((j, offset))
    for length, table in runs.items():
        keys = sorted(table)
        it.run_keys[length] = np.array(keys, np.uint64)
        it.run_places[length] = [table[k] for k in keys]
    sizes: dict[int, list[int]] = {}
    for j, ids in enumerate(it.words):
        sizes.setdefault(len(ids), []).append(j)
    hashed = {size: hashing(size, it.limit[members[0]], recall) for size, members in sizes.items()}
    it.bits = walk_bits(max([size for size, (_, reps) in hashed.items() if reps], default=1))
    for size, members in sizes.items():
        positions, reps = hashed[size]
        if not reps:
            continue
        where = sampled_steps(size, positions, reps)
        keys = signatures(np.stack([it.words[j] for j in members]), size, it.bits, where)
        order = np.argsort(keys, axis=0, kind="stable")
        it.tables[size] = where, np.take_along_axis(keys, order, 0), np.array(members)[order]
    return it


def edit_distance(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Least edits from the item to any part of the passage, with that part's begin and end."""
    m = len(passage)
    cols = np.arange(m + 1)
    row, begin = np.zeros(m + 1, np.int64), cols.copy()
    for i, w in enumerate(item, 1):
        diagonal = row[:-1] + (passage != w)
        up = row[1:] + 1
        new = np.concatenate([[i], np.minimum(diagonal, up)])
        b = np.concatenate([[0], np.where(diagonal <= up, begin[:-1], begin[1:])])
        shifted = new - cols
        low = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == low, cols, 0))
        row, begin = low + cols, b[source]
    end = int(row.argmin())
    return int(row[end]), int(begin[end]), end


class Matcher:
    """Finds items in texts; word numbers of distinct words are remembered up to a bound."""

    def __init__(self, items: Items, remember: int = 150_000):
        self.items = items
        vocabulary = items.vocabulary

        class Numbers(dict):
            def __missing__(self, w: bytes) -> int:
                if len(self) >= remember:
                    self.clear()
                v = self[w] = vocabulary.get(w.strip(PUNCTUATION) or w, -1)
                return v

        self.numbers = Numbers()

    def windows(self, ids: np.ndarray) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
        """Item-sized windows around runs that an item holds too: (begin, size) of hashed sizes, (item, begin) of the others."""
        it, out, plain = self.items, set(), set()
        for length, keys in it.run_keys.items():
            n = len(ids) - length + 1
            if n < 1:
                continue
            known = np.ones(n, bool)
            for k in range(length):
                known &= ids[k:k + n] >= 0
            at = np.flatnonzero(known)
            if not len(at):
                continue
            key = np.zeros(len(at), np.uint64)
            for k in range(length):
                key = mix64(key + ids[at + k].astype(np.uint64) + np.uint64(1))
            where = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            for a, w in zip(at[keys[where] == key].tolist(), where[keys[where] == key].tolist(), strict=True):
                for j, offset in it.run_places[length][w]:
                    if len(it.words[j]) in it.tables:
                        out.add((max(0, a - offset), len(it.words[j])))
                    else:
                        plain.add((j, max(0, a - offset)))
        return out, plain

    def match(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int, int]]]:
        """For each text: (item id, edits, item words, first word, end word) of each item found, once, at its closest place."""
        it = self.items
        ids: list[np.ndarray] = []
        places: dict[int, list[tuple[int, int]]] = {}
        unhashed: list[set[tuple[int, int]]] = []
        for i, text in enumerate(texts):
            ws = tokens(text) if text else []
            ids.append(np.fromiter(map(self.numbers.__getitem__, ws), np.int64, len(ws)))
            hashed, plain = self.windows(ids[i])
            for begin, size in hashed:
                places.setdefault(size, []).append((i, begin))
            unhashed.append(plain)
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]

        def compare(i: int, j: int, first: int, last: int) -> None:
            """The closest passage around windows of the item that begin from ``first`` to ``last``."""
            k, size = it.limit[j], len(it.words[j])
            lo = max(0, first - k - 1)
            passage = ids[i][lo:last + size + k + 1]
            if np.isin(it.words[j], passage).sum() < size - k:
                return  # k edits leave at least size - k words of the item
            d, a, b = edit_distance(it.words[j], passage)
            if d <= k and (j not in best[i] or d < best[i][j][0]):
                best[i][j] = (d, lo + a, lo + b)

        for size, found in places.items():
            for i, begin, j in sorted(self.candidates(ids, size, found)):
                compare(i, j, begin, begin)
        for i, plain in enumerate(unhashed):
            first = last = None
            for j, begin in sorted(plain):
                if first is not None and first[0] == j and begin - first[1] <= it.limit[j]:
                    last = begin  # edits within the limit shift a window by no more
                    continue
                if first is not None:
                    compare(i, *first, last)
                first, last = (j, begin), begin
            if first is not None:
                compare(i, *first, last)
        return [[(it.ids[j], d, len(it.words[j]), a, b) for j, (d, a, b) in sorted(found.items())] for found in best]

    def candidates(self, ids: list[np.ndarray], size: int, found: list[tuple[int, int]]) -> set[tuple[int, int, int]]:
        """(text, begin, item) where a window agrees with an item in some repetition. Equal windows are embedded once."""
        where, keys, members = self.items.tables[size]
        block = np.full((len(found), size), -1, np.int64)
        for row, (i, begin) in enumerate(found):
            part = ids[i][begin:begin + size]
            block[row, :len(part)] = part
        distinct, inverse = np.unique(block, axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        hits: dict[int, set[int]] = {}
        for lo in range(0, len(distinct), 4096):
            got = signatures(distinct[lo:lo + 4096], size, self.items.bits, where)
            for r in range(got.shape[1]):
                left, right = np.searchsorted(keys[:, r], got[:, r], "left"), np.searchsorted(keys[:, r], got[:, r], "right")
                for w in np.flatnonzero(right > left):
                    hits.setdefault(lo + int(w), set()).update(members[left[w]:right[w], r].tolist())
        if not hits:
            return set()
        return {(*found[row], j) for row, w in enumerate(inverse.tolist()) for j in hits.get(w, ())}


def item_blocks(bench: DataFrame, block_items: int, max_share: float, recall: float, id_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The query set in blocks of about ``block_items`` items, so that what is sent to the tasks stays bounded."""
    blocks = max(1, math.ceil(bench.count() / block_items))
    for b in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(blocks)) == b)
        got = rows.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).orderBy("i", "t").collect()
        yield build([(r["i"], r["t"]) for r in got], max_share, recall)


def contaminated(docs: DataFrame, bench: DataFrame, max_share: float = 0.2, recall: float = 0.98, block_items: int = 5000, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, item_words, first_word, end_word): each document row that holds an item within the limit.

    The limit is ``max_share`` of the item's words, as edits of whole words. Null, empty and blank texts or items match
    nothing; a repeated row gives its matches again; items of equal text each match; an empty table gives no row.
    """
    out = None
    for items in item_blocks(bench, block_items, max_share, recall):
        shared = share(docs.sparkSession, items)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared_value(shared))
            for batch in batches:
                found = [m for part in pieces(batch.column(1).to_pylist()) for m in matcher.match(part)]
                rows = [(i, *m) for i, ms in zip(batch.column(0).to_pylist(), found, strict=True) for m in ms]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "edits", "item_words", "first_word", "end_word"])

        part = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(find, "doc_id long, item_id long, edits long, item_words long, first_word long, end_word long")
        out = part if out is None else out.union(part)
    return out


def match_count(spark: SparkSession, bench: DataFrame, text_col: str = "text", max_share: float = 0.2, recall: float = 0.98, block_items: int = 5000) -> Column:
    """Number of items that a text holds within the limit; 0 for a null or empty text. A document without any is clean."""
    total = F.lit(0)
    for items in item_blocks(bench, block_items, max_share, recall):
        shared = share(spark, items)

        def make(shared=shared):
            matcher = Matcher(shared_value(shared))
            return lambda texts: pd.Series([len(m) for part in pieces(texts) for m in matcher.match(part)], dtype="int32")

        total = total + per_batch(make, "int", F.col(text_col))
    return total
