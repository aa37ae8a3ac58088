"""N-gram Jaccard join with prefix filters under several global token orders.

Tokens are hashed word n-grams. In any global order, two sets of Jaccard similarity t share a token among the first
``n - ceil(t * n) + 1`` of each. All orders put frequent tokens last (heavy hitters of the whole corpus) and differ in a hash;
candidates meet on a prefix token of the first order and must also share prefix tokens of the others, pass the length
filter, and pass a bound of the symmetric difference from bit maps, before their whole sets are compared.

Texts with equal sets form a class first, so copies never meet. The result is components, so a candidate whose ends are
already connected needs no comparison: first every class is compared with the most central class of each of its prefix
tokens; only tokens whose classes are not yet connected then compare the rest, except classes whose distances from that
central class differ by more than a link allows. No link between components is left out.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import mix64
from framelens.operators.scale import batches_of, discard, materialize

ORDERS, MAP_WORDS = 3, 16
HEAVY_TOKENS, CHUNK, CHUNK_LEAST = 1 << 18, 1 << 21, 3
# Bytes of text that are hashed at a time (some 40 bytes of working memory for each), and rows of a batch that a task holds.
BLOCK, ROWS = 1 << 18, 1000
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
SEPARATES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BYTE = mix64(np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64) + np.uint64(BASE))
SALTS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47), np.uint64(0xC2B2AE3D27D4EB4F))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word of the texts whose bytes stand in ``data`` from one bound to the next.

    A polynomial over the bytes, read off prefix sums; A-Z count as a-z. Working memory is bounded by blocks of whole words.
    """
    solid = ~SEPARATES[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(BYTE[data[lo:hi]] * powers(BASE, hi - lo), out=total[1:])
        begin = starts[i:j] - lo
        out[i:j] = mix64((total[ends[i:j] - lo] - total[begin]) * powers(INVERSE, hi - lo)[begin])
        i = j
    return out, np.searchsorted(bounds, starts, "right") - 1


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2 ** 64."""
    table = np.full(n, base, np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


def fold_words(ids: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` words."""
    n = len(ids) - width + 1
    key = np.full(n, width, np.uint64)
    for k in range(width):
        key = mix64(key * np.uint64(31) + ids[k:k + n])
    return key


def token_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct token hashes: runs of ``width`` words, the whole sequence if it is shorter, none without a word."""
    if not len(texts):
        return
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = min(len(texts), max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK, "right")) - 1))
        ids, owner = words(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i])
        held = np.bincount(owner, minlength=j - i)
        key, at = np.empty(0, np.uint64), owner[:0]
        if len(ids) >= width:
            key, at = fold_words(ids, width), owner[:len(ids) - width + 1]
            whole = at == owner[width - 1:]
            key, at = key[whole], at[whole]
        ends = np.cumsum(np.bincount(at, minlength=j - i))
        word_ends = np.cumsum(held)
        for k in range(j - i):
            n = int(held[k])
            if n >= width:
                s = np.sort(key[ends[k] - (n - width + 1):ends[k]])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            else:
                yield fold_words(ids[word_ends[k] - n:word_ends[k]], n) if n else np.empty(0, np.uint64)
        i = j


def grouped(sets: Iterator[np.ndarray], size: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """Runs of whole sets with about ``size`` tokens."""
    group, held = [], 0
    for s in sets:
        group.append(s)
        held += len(s)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def shingles(text: str | None, width: int) -> np.ndarray:
    return next(token_sets(pa.array([text], pa.string()), width))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table and let the shuffle files behind it go: nothing refers to them any more."""
    with batches_of(df.sparkSession, ROWS):
        out = materialize(df, f"jaccard-{name}")
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def repeated(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Values that stand ``least`` times or more, ascending, and how often. Sorts ``values`` in place, so it needs little more memory."""
    values.sort()
    ahead = values[least - 1:]
    often = np.unique(ahead[ahead == values[:len(ahead)]])
    return often, np.searchsorted(values, often, "right") - np.searchsorted(values, often)


def heavy_tokens(docs: DataFrame, width: int, text_col: str) -> np.ndarray:
    """Tokens that are frequent anywhere in the corpus, at most HEAVY_TOKENS. They only shape the orders: any choice is right.

    Each run of about CHUNK tokens reports those it holds CHUNK_LEAST times; reports add up over all texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def report() -> pa.RecordBatch:
            every = np.concatenate(held)
            held.clear()
            token, n = repeated(every, CHUNK_LEAST)
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["t", "n"])

        for batch in batches:
            for s in token_sets(batch.column(0), width):
                held.append(s)
                size += len(s)
                if size >= CHUNK:
                    yield report()
                    size = 0
        if held:
            yield report()

    level = F.floor(8 * F.log2("n")).cast("int").alias("level")
    got = settle(docs.select(text_col).mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).select("t", level), "heavy")
    # Some 400 levels at most. The highest whose tokens fit together are taken whole.
    taken, least = 0, 1 << 20
    for r in sorted(got.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        taken += r["count"]
        if taken > HEAVY_TOKENS:
            break
        least = r["level"]
    tokens = got.where(F.col("level") >= least).select("t").toArrow().column(0).to_numpy()
    discard(got)
    return np.sort(tokens.view(np.uint64))


def digest(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, k1, k2, p0.., b0..): set size, 128-bit key of the set, prefixes of each order and the bit map.

    Prefix tokens are cut to 32 bits: two that coincide only add a candidate.
    """
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_tokens(docs, width, text_col))
    names = ["id", "n", "k1", "k2", *[f"p{k}" for k in range(ORDERS)], *[f"b{k}" for k in range(MAP_WORDS)]]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = heavy.value
        for batch in batches:
            ids, sizes, keys = batch.column(0), [], []
            prefixes: list[list[np.ndarray]] = [[] for _ in range(ORDERS)]
            maps = np.zeros((batch.num_rows, MAP_WORDS * 64), np.uint8)
            i = 0
            for group in grouped(token_sets(batch.column(1), width)):
                every = np.concatenate(group)
                at = np.minimum(np.searchsorted(often, every), max(0, len(often) - 1))
                late = (often[at] == every).astype(np.uint64) << np.uint64(63) if len(often) else np.uint64(0)
                ranks = [(mix64(every ^ salt) >> np.uint64(1)) | late for salt in SALTS]
                cut = (every >> np.uint64(22)).astype(np.uint32).view(np.int32)
                spots = (every >> np.uint64(64 - 10)).astype(np.int64)
                lo = 0
                for s in group:
                    n, hi = len(s), lo + len(s)
                    sizes.append(n)
                    keys.append(set_key(s))
                    maps[i] = np.bincount(spots[lo:hi], minlength=MAP_WORDS * 64) & 1
                    take = n - (percent * n + 99) // 100 + 1 if n else 0
                    for k, rank in enumerate(ranks):
                        prefixes[k].append(cut[lo:hi][np.argpartition(rank[lo:hi], take - 1)[:take]] if take < n else cut[lo:hi])
                    i, lo = i + 1, hi
            bits = np.packbits(maps, axis=1).view(np.int64)
            pair = np.array(keys, np.int64).reshape(-1, 2)
            lists = []
            for p in prefixes:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in p])]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(p) if p else np.empty(0, np.int32))))
            cols = [ids, pa.array(sizes, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), *lists, *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(MAP_WORDS)]]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = ", ".join(["id long", "n long", "k1 long", "k2 long", *[f"p{k} array<int>" for k in range(ORDERS)], *[f"b{k} long" for k in range(MAP_WORDS)]])
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(make, kind)


def membership(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the ids in the only column: two of at least sixteen bits for each, in 16 MB at most whatever their number."""
    bits = 1 << min(27, max(16, (16 * ids.count()).bit_length()))

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(bloom_places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits).ravel())
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(value.view(np.int64))], ["w", "b"])

    got = ids.mapInArrow(spots, "w int, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(bits >> 6, np.uint64)
    table[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return table


def bloom_places(ids: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([mix64(ids.view(np.uint64) ^ salt) & np.uint64(bits - 1) for salt in SALTS[:2]])


def contains(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids the Bloom filter holds; it also says yes to a few that were never put in."""
    place = bloom_places(ids, len(table) << 6)
    return ((table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool).all(axis=0)


def class_texts(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(v, t): a text of each of the wanted classes (k1, k2, v, id).

    The ids reach the map tasks as a Bloom filter of bounded size, so texts of other ids are not shuffled.
    """
    filtered = docs.sparkSession.sparkContext.broadcast(membership(wanted.select("id")))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = filtered.value
        for batch in batches:
            kept = batch.filter(pa.array(contains(table, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))))
            keys = np.array([set_key(s) for s in token_sets(kept.column(1), width)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), kept.column(1)], ["k1", "k2", "t"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id IS NOT NULL").mapInArrow(pick, "k1 long, k2 long, t string")
    # Any text of a class has its set.
    return texts.groupBy("k1", "k2").agg(F.min("t").alias("t")).join(wanted.select("k1", "k2", "v"), ["k1", "k2"]).select("v", "t")


def shared_tokens(pairs: DataFrame, width: int) -> DataFrame:
    """(a, b, sum, shared): sizes of the intersections of the token sets of pairs (a, b, sum, ta, tb) of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(token_sets(batch.column(3), width), token_sets(batch.column(4), width), strict=True)
            shared = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(shared, pa.int64())], ["a", "b", "sum", "shared"])

    return pairs.select("a", "b", "sum", "ta", "tb").mapInArrow(count, "a long, b long, sum long, shared long")


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    k1, k2 = np.frombuffer(xxhash.xxh128_digest(s.tobytes()), np.int64)
    return int(k1), int(k2)


def numbered_classes(real: DataFrame) -> DataFrame:
    """(k1, k2, v, id): classes with their number and smallest id.

    The number is that id, which packs well; where an id is the smallest of several classes, as it stands on several texts, all
    but one of them are numbered by a hash. Numbers that meet by chance are drawn anew: that list is tiny at any size.
    """
    classes = settle(real.groupBy("k1", "k2").agg(F.min("id").alias("id")), "classes")
    first = classes.groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("f")).select("id", "f.k1", "f.k2", F.lit(True).alias("first"))
    key = ["id", "k1", "k2"]
    numbered = settle(classes.join(first, key, "left").select(*key, "first", F.when(F.col("first"), F.col("id")).otherwise(F.xxhash64(*key)).alias("v")), "classes")
    for salt in range(1, 9):
        met = [r["v"] for r in numbered.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").collect()]
        if not met:
            break
        again = F.col("v").isin(met) & F.col("first").isNull()
        numbered = settle(numbered.withColumn("v", F.when(again, F.xxhash64(F.lit(salt), *key)).otherwise(F.col("v"))), "classes")
    return numbered.drop("first")


def of_classes(rows: DataFrame, wanted: DataFrame, names: list[str]) -> DataFrame:
    """(v, names) of the wanted classes (k1, k2, v, id), from a row of each. Rows of other ids stay in their map tasks (Bloom filter)."""
    filtered = rows.sparkSession.sparkContext.broadcast(membership(wanted.select("id")))

    @F.pandas_udf("boolean")
    def held(ids: pd.Series) -> pd.Series:
        return pd.Series(contains(filtered.value, ids.to_numpy(np.int64)))

    some = rows.where("id IS NOT NULL AND n > 0").where(held("id")).groupBy("k1", "k2").agg(*[F.first(c).alias(c) for c in names])
    return some.join(wanted.select("k1", "k2", "v"), ["k1", "k2"]).select("v", *names)


def fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable, for ids in links (a, b), by alternating large and small stars.

    Each round moves edges to smaller ends; edges are written between rounds. It ends when a round changes nothing.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    print_of = fingerprint(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.inline(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))))).where("u > v").distinct()
        old, edges = edges, settle(small, "edges")
        discard(old)
        now = fingerprint(edges)
        if now == print_of:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        print_of = now


def near(n: str, m: str, percent: int) -> Column:
    """Length filter: sets of these sizes can reach the similarity."""
    return (100 * F.least(n, m) >= percent * F.greatest(n, m))


def places(a: str, b: str) -> Column:
    """In how many places two bit maps differ."""
    return sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(MAP_WORDS)), F.lit(0))


def difference_fits(percent: int, a: str, b: str, n: Column, m: Column) -> Column:
    """Bit maps differ in no more places than the sets of a linked pair may: a place holds whether an odd number of tokens falls on it, so it differs only by a token of one set."""
    return places(a, b) * (100 + percent) <= (100 - percent) * (n + m)


def compare(pairs: DataFrame, rows: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b, linked, lo, hi) of candidate pairs (a, b) of classes, with bounds of their Jaccard distance.

    The other orders' prefixes and the bit maps come first, then the whole sets of what is left, whose distance is exact.
    """

    def ends(of: DataFrame) -> DataFrame:
        return settle(classes.join(of.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "v"), "wanted")

    names = [*[f"p{k}" for k in range(1, ORDERS)], *[f"b{k}" for k in range(MAP_WORDS)]]
    wanted = ends(pairs)
    info = settle(of_classes(rows, wanted, ["n", *names]), "info")
    one = info.select(F.col("v").alias("a"), F.col("n").alias("na"), *[F.col(c).alias(f"a{c}") for c in names])
    two = info.select(F.col("v").alias("b"), F.col("n").alias("nb"), *[F.col(c).alias(f"b{c}") for c in names])
    total = F.col("na") + F.col("nb")
    fits = difference_fits(percent, "ab", "bb", F.col("na"), F.col("nb"))
    for k in range(1, ORDERS):
        fits = fits & F.arrays_overlap(f"ap{k}", f"bp{k}")
    got = settle(pairs.join(one, "a").join(two, "b").select("a", "b", total.alias("sum"), places("ab", "bb").alias("places"), fits.alias("fits")), "candidates")
    discard(info, wanted)
    # Texts pack to less than half of their token sets, so they are what travels to the pairs.
    left = got.where("fits")
    wanted = ends(left)
    texts = settle(class_texts(docs, wanted, width, id_col, text_col), "texts")
    both = left.join(texts.select(F.col("v").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("v").alias("b"), F.col("t").alias("tb")), "b")
    exact = settle(shared_tokens(both, width).select("a", "b", "shared"), "shared")
    distance = 1 - F.col("shared") / (F.col("sum") - F.col("shared"))
    # Sets that differ in at least d tokens are at least 2 d / (sum + d) apart; what a filter refused is beyond the limit.
    least = F.greatest(2 * F.col("places") / (F.col("sum") + F.col("places")), F.lit(1 - percent / 100))
    out = got.join(exact, ["a", "b"], "left").select(
        "a", "b", F.coalesce(100 * F.col("shared") >= percent * (F.col("sum") - F.col("shared")), F.lit(False)).alias("linked"),
        F.coalesce(distance, least).alias("lo"), F.coalesce(distance, F.lit(1.0)).alias("hi"))
    out = settle(out, "links")
    discard(got, wanted, texts, exact)
    return out


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: links where 100 * shared >= percent * union of token sets.

    Null, empty and blank texts have size 0 and are linked with nothing: their component is their own id. Rows without an
    id take no part and have no component. Texts of equal sets are one class, and classes are what is linked: repeated rows
    are members of their text's class, and an id that stands on several texts is a member of each of their classes, row by row.
    An empty table gives no row. ``percent`` is from 51 to 100.
    """
    rows = settle(digest(docs, width, percent, id_col, text_col), "digest")
    real = rows.where("id IS NOT NULL AND n > 0")
    classes = numbered_classes(real)
    # One row per class (and one more for each repetition of it): copies never meet. All members of a class have the same size and prefixes.
    leaders = settle(real.select("id", "k1", "k2", "n", "p0").join(classes, ["id", "k1", "k2"]).select("v", "n", "p0"), "leaders")
    # Both uses read the same three columns dealt by token, so Spark shuffles the postings once.
    postings = leaders.select(F.explode("p0").alias("t"), "v", "n").repartition("t")
    shared = postings.groupBy("t").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("n").alias("most")).where("lo <> hi AND most > 0").select("t")
    meet = settle(postings.join(shared, "t").distinct(), "postings")
    discard(leaders)
    central = meet.groupBy("v").agg(F.count("*").alias("m"))
    hubs = meet.join(central, "v").groupBy("t").agg(F.max(F.struct("m", "v", F.col("n").alias("nh"))).alias("h"))
    hubs = settle(hubs.select("t", F.col("h.v").alias("hub"), F.col("h.nh").alias("nh")), "hubs")
    star = meet.join(hubs, "t").where((F.col("v") != F.col("hub")) & near("n", "nh", percent)).select(F.least("v", "hub").alias("a"), F.greatest("v", "hub").alias("b")).distinct()
    star = settle(star, "star")
    links = compare(star, rows, classes, docs, width, percent, id_col, text_col)
    joined = components(links.where("linked"))

    named = meet.join(joined.withColumnRenamed("id", "v"), "v", "left").withColumn("g", F.coalesce("component", "v"))
    open_tokens = named.groupBy("t").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("t")
    # How far a class is from its token's hub, by comparison or else by the sizes.
    far = links.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "lo", "hi")
    own, to_hub = F.col("v") == F.col("hub"), (F.least("v", "hub") == F.col("_a")) & (F.greatest("v", "hub") == F.col("_b"))
    lo = F.when(own, 0.0).otherwise(F.coalesce("lo", 1 - F.least("n", "nh") / F.greatest("n", "nh")))
    gaps = named.join(open_tokens, "t").join(hubs, "t").join(joined.select(F.col("id").alias("hub"), F.col("component").alias("gh")), "hub", "left").join(far, to_hub, "left")
    gaps = settle(gaps.select("t", "v", "n", "g", (F.col("g") != F.coalesce("gh", "hub")).alias("apart"), lo.alias("lo"), F.when(own, 0.0).otherwise(F.coalesce("hi", F.lit(1.0))).alias("hi")), "gaps")
    bits = of_classes(rows, settle(classes.join(gaps.select("v").distinct(), "v"), "wanted"), [f"b{k}" for k in range(MAP_WORDS)])
    left = settle(gaps.join(bits, "v"), "open")
    discard(gaps)
    x = left.where("apart").select("t", F.col("v").alias("x"), F.col("n").alias("nx"), F.col("g").alias("gx"), F.col("lo").alias("lx"), F.col("hi").alias("hx"), *[F.col(f"b{k}").alias(f"x{k}") for k in range(MAP_WORDS)])
    y = left.select(F.col("t").alias("t2"), F.col("v").alias("y"), F.col("n").alias("ny"), F.col("g").alias("gy"), F.col("lo").alias("ly"), F.col("hi").alias("hy"), F.col("apart").alias("ay"), *[F.col(f"b{k}").alias(f"y{k}") for k in range(MAP_WORDS)])
    # Jaccard distance is a metric: ends of a link are about as far from their token's hub. Two that are both apart meet once.
    reach = F.lit(1 - percent / 100 + 1e-9)
    level = (F.col("lx") - F.col("hy") <= reach) & (F.col("ly") - F.col("hx") <= reach)
    once = ~F.col("ay") | (F.col("x") < F.col("y"))
    fits = (F.col("gx") != F.col("gy")) & once & level & near("nx", "ny", percent) & difference_fits(percent, "x", "y", F.col("nx"), F.col("ny"))
    more = x.join(y, (F.col("t") == F.col("t2")) & fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = settle(more.join(star, ["a", "b"], "left_anti"), "rest")
    more_links = compare(more, rows, classes, docs, width, percent, id_col, text_col)
    before, joined = joined, components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more_links.where("linked").select("a", "b")))
    narrow = settle(rows.select("id", "n", "k1", "k2"), "keys")
    discard(rows, meet, hubs, star, left, more, links, more_links, before)

    # A component is named by a class; its name for the reader is the smallest id of its classes.
    member = classes.join(joined.withColumnRenamed("id", "v"), "v", "left").select("k1", "k2", "id", F.coalesce("component", "v").alias("c"))
    least = member.groupBy("c").agg(F.min("id").alias("component_id"))
    out = narrow.join(member.select("k1", "k2", "c").join(least, "c"), ["k1", "k2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id"))
