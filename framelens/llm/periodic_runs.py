"""Runs: stretches of words that repeat with a period, found by recursive frequency splitting and a lag scan.

A run is a maximal stretch of consecutive words with smallest period q and a length of at least ``max(min_words, min_repeats * q)``.
Every word of a run occurs at least ``min_repeats`` times in it. So a word that occurs less often within a segment lies in no
run of that segment and splits it; the parts are counted anew and split again until every word of every segment occurs often
enough. Only the segments that survive are scanned for lags.

The lag scan looks at lags 2^j to 2^(j+1) - 1 together. A run with such a period holds two neighbouring tiles of 2^j words,
at multiples of 2^j, that both repeat at that lag. Tiles are compared by rolling hashes with all shifts into the next tile,
which costs one comparison per word and level; what agrees is then compared word by word. Time is near n log n in the
words of a text, also for one long text of a single word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from framelens.llm.common import mix64, pieces

KIND = "struct<n_words:bigint, runs:array<struct<start:bigint,length:bigint,period:bigint>>, collapsed:string>"


def split_rare(words: np.ndarray, text: np.ndarray, min_words: int, min_repeats: int) -> list[tuple[int, int]]:
    """Segments [start, end) of the words of many texts in which every word occurs ``min_repeats`` times or more.

    ``words`` holds a code for each word, ``text`` the text that it belongs to; a segment lies within one text.
    Segments that cannot hold ``min_words`` words are left out. Each round looks only at the parts of segments that were just split.
    """
    place = np.arange(len(words))
    segment = text.astype(np.int64)
    stable: list[tuple[int, int]] = []
    while len(place):
        pair = segment * (int(words.max()) + 1) + words[place]
        _, which, times = np.unique(pair, return_inverse=True, return_counts=True)
        rare = times[which] < min_repeats
        if rare.any():
            touched = np.zeros(int(segment[-1]) + 1, bool)
            touched[segment[rare]] = True
            settled = ~touched[segment]
        else:
            settled = np.ones(len(place), bool)
        stable += _stretches(place[settled], segment[settled], min_words)
        left = ~settled & ~rare
        place, segment = place[left], segment[left]
        if not len(place):
            break
        begins = np.ones(len(place), bool)
        begins[1:] = (np.diff(place) > 1) | (np.diff(segment) != 0)
        segment = np.cumsum(begins) - 1
        long_enough = np.bincount(segment)[segment] >= min_words
        place, segment = place[long_enough], segment[long_enough]
    return sorted(stable)


def _stretches(place: np.ndarray, segment: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    if not len(place):
        return []
    cut = np.flatnonzero((np.diff(place) > 1) | (np.diff(segment) != 0)) + 1
    starts, ends = place[np.r_[0, cut]], place[np.r_[cut - 1, len(place) - 1]] + 1
    return [(int(a), int(b)) for a, b in zip(starts, ends, strict=True) if b - a >= min_words]


def _stretch(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The maximal [start, end) around ``at`` in which words ``lag`` apart are equal; words[at] equals words[at + lag]."""
    n = len(words)
    end, step = at + lag, 64
    while end < n:
        top = min(n, end + step)
        other = np.flatnonzero(words[end:top] != words[end - lag:top - lag])
        if len(other):
            end += int(other[0])
            break
        end, step = top, step * 2
    start, step = at, 64
    while start > 0:
        low = max(0, start - step)
        other = np.flatnonzero(words[low:start] != words[low + lag:start + lag])
        if len(other):
            start = low + int(other[-1]) + 1
            break
        start, step = low, step * 2
    return start, end


def lag_scan(words: np.ndarray, min_words: int, min_repeats: int) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of one segment, by start and then period."""
    n = len(words)
    runs: list[tuple[int, int, int]] = []
    hashes = mix64(words.astype(np.uint64) + np.uint64(1))
    tile = 1
    while min_repeats * tile <= n:
        # For each word the furthest end of a run with a shorter period that holds it.
        reach = np.zeros(n + 1, np.int64)
        for a, length, _ in runs:
            reach[a] = max(reach[a], a + length)
        np.maximum.accumulate(reach, out=reach)
        width = -(-len(hashes) // tile) * tile
        rows = np.zeros(width, np.uint64)
        rows[:len(hashes)] = hashes
        rows = rows.reshape(-1, tile)
        same = rows[1:] == rows[:-1, :1]
        at, shift = np.nonzero(same[:-1] & same[1:])
        at, lag = at * tile, shift + tile
        # A run with shorter periods that holds a tile and its repetition makes the longer lag a multiple of its period.
        fresh = (at + tile + lag < len(hashes)) & (min_repeats * lag <= n) & (reach[at] < at + tile + lag)
        at, lag = at[fresh], lag[fresh]
        order = np.lexsort((at, lag))
        known = (0, 0)
        found = []
        for s, q in zip(at[order].tolist(), lag[order].tolist(), strict=True):
            if q == known[0] and s < known[1]:
                continue
            a, b = _stretch(words, s, q) if words[s] == words[s + q] else (s, s)
            known = (q, b - q)
            if b - a >= max(min_words, min_repeats * q) and reach[a] < b:
                found.append((a, b - a, q))
        runs += sorted(set(found))
        if len(hashes) <= tile:
            break
        hashes = mix64(hashes[:-tile] * np.uint64(3) + hashes[tile:])
        tile *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def text_runs(texts: list[str | None], min_words: int = 6, min_repeats: int = 4) -> list[tuple[int, list[tuple[int, int, int]], str]]:
    """For each text its number of words, its runs, and its words without the repetitions of runs."""
    split = [t.encode().split() if t else [] for t in texts]  # bytes split at just the blanks of the word pattern
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(sizes)
    codes: dict[bytes, int] = defaultdict(count().__next__)
    words = np.fromiter((codes[w] for ws in split for w in ws), np.int64, int(sizes.sum()))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    drop: dict[int, np.ndarray] = {}
    for a, b in split_rare(words, np.repeat(np.arange(len(split)), sizes), min_words, min_repeats):
        k = int(np.searchsorted(ends, a, side="right"))
        base = int(ends[k] - sizes[k])
        for start, length, period in lag_scan(words[a:b], min_words, min_repeats):
            first = a - base + start
            runs[k].append((first, length, period))
            drop.setdefault(k, np.zeros(int(sizes[k]), bool))[first + period:first + length] = True
    out = []
    for k, ws in enumerate(split):
        kept = [ws[i] for i in np.flatnonzero(~drop[k]).tolist()] if k in drop else ws
        out.append((len(ws), sorted(runs[k], key=lambda r: (r[0], r[2])), b" ".join(kept).decode()))
    return out


def runs_column(text: str | Column = "text", min_words: int = 6, min_repeats: int = 4) -> Column:
    """Struct (n_words, runs, collapsed) of a text.

    ``runs`` lists (start, length, period) by start and period, word numbers from 0; ``collapsed`` holds the words joined by
    one space, without the words that any run contains after its first period. A null, empty or blank text has no words, no
    runs and an empty ``collapsed``. Repeated rows get equal results, an empty table none; other columns are not touched.
    A text is read whole, whatever its length; ``min_repeats`` is 4 or more.
    """
    if min_repeats < 4:
        raise ValueError("the lag scan needs runs of four periods or more")

    @F.pandas_udf(KIND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [x for part in pieces(batch) for x in text_runs(part, min_words, min_repeats)]
            yield pd.DataFrame({
                "n_words": [x[0] for x in got],
                "runs": [[{"start": a, "length": n, "period": q} for a, n, q in x[1]] for x in got],
                "collapsed": [x[2] for x in got],
            })

    return run(F.col(text) if isinstance(text, str) else text)


def best_run(runs: Column) -> Column:
    """Of the runs the one with the greatest exact length / period; ties: smallest start, then period. Null without runs."""

    def better(best: Column, r: Column) -> Column:
        more = r["length"] * best["period"] > best["length"] * r["period"]
        return F.when(best.isNull() | more, r).otherwise(best)

    kind = "struct<start:bigint,length:bigint,period:bigint>"
    return F.aggregate(runs, F.lit(None).cast(kind), better)
