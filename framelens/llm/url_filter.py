"""URL filter: rules first, then naive Bayes over the words of host and path.

Names in URLs are often words written together. A unigram model, counted over the words of all page texts, splits them by the
most probable segmentation (Viterbi). Multinomial naive Bayes scores the pieces; it learns from URLs with a known verdict,
here those that a rule decides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import fresh, share, shared_value, sigmoid
from framelens.operators.scale import discard, materialize

LEXICON_WORDS = 200_000
LONGEST = 24
BUCKET_BITS = 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``place`` is a host and the beginning of a path, as in ``example.com/en/``; the host stands for its subdomains too."""

    verdict: str
    place: str

    @property
    def host(self) -> str:
        return self.place.partition("/")[0]

    @property
    def path(self) -> str:
        return "".join(self.place.partition("/")[1:])


def host_path(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty for null or a text without ``://``."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (place, verdict) of the longest rule that fits; null if none does. Rules are inlined: a list, not a table."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r.place), r.place)):
        ok = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        fits.append(F.when(ok, F.struct(F.lit(rule.place).alias("place"), F.lit(rule.verdict).alias("verdict"))))
    return F.coalesce(*fits, F.lit(None).cast("struct<place:string,verdict:string>"))


def text_words(html: str) -> Column:
    """The lower-case words of a page's text that consist of a-z only, two letters to ``LONGEST``."""
    text = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&\w+;", " ")
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)), lambda w: w.rlike(f"^[a-z]{{2,{LONGEST}}}$"))


@dataclass
class Segmenter:
    """Splits a lower-case name into the most probable sequence of words."""

    cost: dict[str, float]
    unknown: float
    memory: dict[str, list[str]] = field(default_factory=dict)

    def split(self, name: str) -> list[str]:
        got = self.memory.get(name)
        if got is None:
            if len(self.memory) >= 20_000:
                self.memory.clear()
            got = self.memory[name] = self._viterbi(name)
        return got

    def _viterbi(self, name: str) -> list[str]:
        """Ties go to the longer last word. A word that the model does not hold costs ``unknown`` and one more decade for each letter."""
        best, back = [0.0], [0]
        decade = math.log(10)
        for end in range(1, len(name) + 1):
            least, at = math.inf, end - 1
            for start in range(max(0, end - LONGEST), end):
                c = best[start] + self.cost.get(name[start:end], self.unknown + decade * (end - start))
                if c < least:
                    least, at = c, start
            best.append(least)
            back.append(at)
        out, end = [], len(name)
        while end:
            out.append(name[back[end]:end])
            end = back[end]
        return out[::-1]


def read_lexicon(pages: DataFrame, html_col: str = "html", max_words: int = LEXICON_WORDS) -> Segmenter:
    """Unigram costs from the words of all pages.

    Every word is counted. The model holds the words with at least 2^t counts for the smallest t that leaves ``max_words`` of
    them (the documented bound of what is sent to the tasks); the rest is unknown to it and only counts in the total.
    """
    counts = materialize(pages.select(F.explode(text_words(html_col)).alias("word")).groupBy("word").count(), "lexicon")
    level = F.floor(F.log2("count"))
    levels = {int(r["level"]): (int(r["words"]), int(r["total"])) for r in counts.groupBy(level.alias("level")).agg(
        F.count("*").alias("words"), F.sum("count").alias("total")).collect()}  # at most 63 rows
    total, held, least = sum(t for _, t in levels.values()), 0, 64
    for k in sorted(levels, reverse=True):
        if held + levels[k][0] > max_words:
            break
        held, least = held + levels[k][0], k
    known = counts.where(level >= least).collect() if held else []
    discard(counts)
    return Segmenter({r["word"]: math.log(total / r["count"]) for r in known}, math.log(max(total, 1)) - math.log(10))


def tokens(host: str, path: str, segmenter: Segmenter) -> list[str]:
    """The words of each label of the host and of the path; a number is ``#``. Host words are marked, so the two do not mix."""
    out = []
    for mark, text in (("h:", host), ("", path)):
        for piece in re.findall(r"[0-9]+|[^\W\d_]+", text):
            out += [mark + "#"] if piece[0].isdigit() else [mark + w for w in segmenter.split(piece.lower())]
    return out


def _bucket(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode()) & ((1 << BUCKET_BITS) - 1)


def _token_buckets(host: Column, path: Column, lexicon: Broadcast) -> Column:
    @F.pandas_udf("array<int>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        segmenter = shared_value(lexicon)
        for hosts, paths in batches:
            yield pd.Series([[_bucket(t) for t in tokens(h, p, segmenter)] for h, p in zip(hosts, paths, strict=True)])

    return run(host, path)


def train(urls: DataFrame, host: str, path: str, label: str, lexicon: Broadcast) -> np.ndarray:
    """Log ratio block : allow of each token bucket, and last the prior's.

    ``label`` is 1 (block), 0 (allow) or null (not learned from). Tokens are hashed into a fixed number of buckets, so the model
    and what reaches the driver have a fixed size; counts cover every labelled row and are combined before the shuffle.
    Without labelled rows every ratio is 0.
    """
    known = urls.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), _token_buckets(F.col(host), F.col(path), lexicon).alias("b"))
    # The row itself counts in the bucket after the last.
    size = 1 << BUCKET_BITS
    counted = known.select("y", F.explode(F.concat("b", F.array(F.lit(size)))).alias("b")).groupBy("b").agg(
        F.sum("y").alias("block"), F.sum(1 - F.col("y")).alias("allow"))
    n = np.zeros((2, size + 1))
    for r in counted.collect():
        n[:, r["b"]] = r["block"], r["allow"]
    smooth = n + 1.0
    used = max(1, int((n[:, :-1].sum(0) > 0).sum()))
    ratio = np.log(smooth[0] / smooth[1])
    ratio[:-1] -= np.log((n[0, :-1].sum() + used) / (n[1, :-1].sum() + used))
    return ratio


def score_column(host: Column, path: Column, lexicon: Broadcast, model: Broadcast) -> Column:
    """Struct (words, block): the tokens and the probability of ``block``."""

    @F.pandas_udf("struct<words:array<string>,block:double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        segmenter, ratio = shared_value(lexicon), shared_value(model)
        for hosts, paths in batches:
            words = [tokens(h, p, segmenter) for h, p in zip(hosts, paths, strict=True)]
            odds = [ratio[-1] + sum(ratio[_bucket(t)] for t in ws) for ws in words]
            yield pd.DataFrame({"words": words, "block": sigmoid(np.array(odds, float))})

    return run(host, path)


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with a struct column (host, path, rule, verdict, words, block) named ``judged`` (or ``_judged`` if that is taken).

    The verdict is that of the longest fitting rule, else ``block`` if its probability is above one half, else ``allow``.
    A null URL or one without ``://`` has an empty host and path, fits no rule and gets the verdict of the prior. Repeated rows
    get equal verdicts; an empty table gives no rows; names may be of any length; other columns are kept.
    """
    spark = pages.sparkSession
    host, path = host_path(url_col)
    lexicon = share(spark, read_lexicon(pages, html_col))
    urls = pages.select(host.alias("host"), path.alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    labelled = urls.withColumn("y", F.when(F.col("rule.verdict").isNotNull(), (F.col("rule.verdict") == "block").cast("long")))
    model = share(spark, train(labelled, "host", "path", "y", lexicon))
    score = score_column(F.col("_h"), F.col("_p"), lexicon, model)
    name = fresh(pages, "judged")
    parts = pages.select(F.struct("*").alias("row"), host.alias("_h"), path.alias("_p")).select(
        "row", "_h", "_p", rule_of(F.col("_h"), F.col("_p"), rules).alias("_r"), score.alias("_s"))
    verdict = F.coalesce("_r.verdict", F.when(F.col("_s.block") > 0.5, "block").otherwise("allow"))
    return parts.select("row.*", F.struct(F.col("_h").alias("host"), F.col("_p").alias("path"), F.col("_r.place").alias("rule"),
                                          verdict.alias("verdict"), "_s.words", "_s.block").alias(name))
