"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. Each node has a failure link and the number of pieces that following the link pops off
the front, so a word is read once, byte by byte, and only piece counts are added up; no piece is built.
"""

from __future__ import annotations

import base64
from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import per_batch_struct, share, shared_value


@dataclass(frozen=True)
class Automaton:
    """``step``: next node by node * 256 + byte; ``fail``, ``popped``: link and pieces popped by it; ``piece``: node ends one.

    A link of -1 means that no piece starts here: the vocabulary must hold every single byte, so it does not occur.
    """

    step: dict[int, int]
    fail: list[int]
    popped: list[int]

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match split."""
        step, fail, popped = self.step, self.fail, self.popped
        node = n = 0
        for b in word:
            to = step.get(node << 8 | b)
            while to is None:
                n += popped[node]
                node = fail[node]
                to = step.get(node << 8 | b)
            node = to
        while node:
            n += popped[node]
            node = fail[node]
        return n


def build(vocabulary: list[bytes]) -> Automaton:
    """Links by breadth first. A node that ends a piece pops it and returns to the root; another one pops what its parent's
    links pop until a node with the same next byte is found."""
    missing = {bytes([b]) for b in range(256)} - set(vocabulary)
    if missing:
        raise ValueError("the vocabulary must hold every single byte")
    step: dict[int, int] = {}
    ends = {0}
    size = 1
    for v in vocabulary:
        node = 0
        for b in v:
            key = node << 8 | b
            if key not in step:
                step[key] = size
                size += 1
            node = step[key]
        ends.add(node)
    children: list[list[tuple[int, int]]] = [[] for _ in range(size)]
    for key, to in step.items():
        children[key >> 8].append((key & 255, to))
    fail, popped = [0] * size, [0] * size
    queue = deque([0])
    while queue:
        parent = queue.popleft()
        for b, node in children[parent]:
            queue.append(node)
            if node in ends:
                popped[node] = 1
                continue
            # Not a piece itself: its parent is not the root, as every byte is a piece.
            n, at = popped[parent], fail[parent]
            while (at << 8 | b) not in step:
                n += popped[at]
                at = fail[at]
            fail[node], popped[node] = step[at << 8 | b], n
    return Automaton(step, fail, popped)


def read_vocabulary(spark, path: str) -> list[bytes]:
    """Pieces of a vocabulary file with one base64 piece and its rank per line; its size bounds what is sent to tasks."""
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0).collect()
    return sorted(base64.b64decode(r["value"].split()[0]) for r in rows)


def count_column(docs: DataFrame, automaton: Automaton, text_col: str = "text", remember: int = 500_000) -> Column:
    """Struct (n_words, n_tokens) of each whole text; zeros for a null, empty or blank one.

    Words are separated by ASCII white space; a word that does not begin its text is counted with one space before it.
    """
    shared = share(docs.sparkSession, automaton)

    def make():
        a, known = shared_value(shared), {}

        def pieces_of(word: bytes) -> int:
            n = known.get(word)
            if n is None:
                if len(known) >= remember:
                    known.clear()
                n = known[word] = a.count(word)
            return n

        def count(texts: pd.Series) -> pd.DataFrame:
            words, tokens = [], []
            for t in texts:
                ws = (t or "").encode("utf-8", "surrogatepass").split()
                words.append(len(ws))
                tokens.append(a.count(ws[0]) + sum(pieces_of(b" " + w) for w in ws[1:]) if ws else 0)
            return pd.DataFrame({"n_words": np.array(words, np.int64), "n_tokens": np.array(tokens, np.int64)})

        return count

    return per_batch_struct(make, "n_words long, n_tokens long", F.col(text_col))
