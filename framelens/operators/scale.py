"""What keeps the other operators safe on large and skewed data.

* a side is broadcast only if its plan says that it is small;
* beyond that bound a lookup is a shuffle join in which frequent keys of the
  large side are salted, so no task receives a whole hot key;
* "first row per key" uses a ranked window that Spark limits per key before
  the shuffle (``WindowGroupLimit``, for up to 1,000 rows per key);
* numbering rows globally is a range partitioning plus per-partition offsets,
  never one sorted partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Of files, so compressed: the rows take some times that in memory.
BROADCAST_BYTES = 32 * 1024 * 1024
ROWS_PER_SALT = 100_000
NULL_SALTS = 64


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by the session.

    Only a local session may leave it unset: it gets a folder in its warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    root = f"{spark.conf.get('spark.sql.warehouse.dir')}/_steps"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Meanwhile Python workers get batches of at most ``rows`` rows (fewer if the session says so): executor and worker each hold a whole batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, now = spark.conf.get(key, None), int(spark.conf.get(key))
    spark.conf.set(key, str(min(rows, now) if now > 0 else rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage and survives executor loss; used where a plan is reused
    by several jobs that must see identical rows.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder at ``path``, in whatever store it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote. Nothing that is still to be computed may read them."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def compute_once(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    """Add expensive columns so that they are evaluated exactly once per row.

    A later filter on a projected column is pushed below the projection with
    the expression copied into it, once per mention; it cannot be pushed
    below a generator. The generator here yields one row per input row.
    """
    value = F.struct(*[c.alias(name) for name, c in exprs.items()])
    return df.select("*", F.inline_outer(F.array(value)))


def compute_distinct(df: DataFrame, keys: Sequence[str], exprs: Mapping[str, Column], n: str = "n") -> DataFrame:
    """Expensive columns of ``keys`` alone, evaluated once for each distinct combination, with its number of rows.

    Equal rows are folded in each task before the shuffle, so frequent combinations cost one evaluation, wherever they stand.
    """
    return compute_once(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)), exprs)


def collect_bounded(df: DataFrame, max_rows: int) -> list[Row]:
    """Collect a table that must be small; raise when it is not."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"table has more than {max_rows} rows, too large to inline")
    return rows


def plan_bytes(df: DataFrame) -> int:
    """Spark's upper estimate of a table's size, from its files or rows; nothing runs. A table of unknown size counts as very large."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _common(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> list[Column]:
    """The keys in the types that both sides' values compare in."""
    both = left.select(*keys).limit(0).union(right.select(*keys).limit(0))
    return [F.col(k).cast(both.schema[k].dataType) for k in keys]


def salted_join(left: DataFrame, right: DataFrame, key: str | Sequence[str], how: str = "left", rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Equi-join on ``key`` that spreads hot and null keys of ``left``; nothing runs while the plan is built.

    Equal rows of ``left`` are grouped with their count first, in each task before the shuffle, and large groups are cut into
    pieces of ``rows_per_salt`` rows. A key with more rows than that gets a salt for each ``rows_per_salt`` of them; a piece
    takes its salt from a hash of its row and its number, so a repeated task finds the same one. Rows of ``right`` with such
    a key are repeated for its salts. Both the keys' counts and the join read the grouped rows, whose exchange Spark reuses.
    Keys are compared in the type that both sides have in common. Rows of maps cannot be grouped by hash: use other columns.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    keys = [key] if isinstance(key, str) else list(key)
    typed = [c.alias(f"_k{i}") for i, c in enumerate(_common(left, right, keys))]
    on, n = [f"_k{i}" for i in range(len(keys))], F.lit(rows_per_salt).cast("long")
    grouped = left.groupBy(*left.columns).agg(F.count(F.lit(1)).alias("_m"))
    pieces = grouped.select("*", *typed, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / n))).alias("_i"))
    pieces = pieces.withColumn("_m", F.least(n, F.col("_m") - n * F.col("_i")))
    # At most one row for each `rows_per_salt` rows of the table.
    hot = pieces.groupBy(*on).agg(F.sum("_m").alias("_n")).where(F.col("_n") > n).select(*on, F.ceil(F.col("_n") / n).alias("_salts"))
    absent = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    mark = F.xxhash64(*left.columns) + F.col("_i")
    salt = F.when(absent, F.pmod(mark, F.lit(NULL_SALTS))).otherwise(F.pmod(mark, F.coalesce("_salts", F.lit(1))))
    lhs = pieces.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_salts", "_i")
    others = [c for c in right.columns if c not in keys] if how in ("left", "inner") else []
    rhs = right.select(*typed, *others).join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)).cast("long") - 1))).drop("_salts")
    joined = lhs.join(rhs, [*on, "_salt"], how)
    copies = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"))))
    return copies.select(*keys, *[c for c in left.columns if c not in keys], *others)


def lookup_join(left: DataFrame, right: DataFrame, key: str | Sequence[str], how: str = "left") -> DataFrame:
    """Join a dictionary: broadcast when its plan is known to be small, salted shuffle join otherwise."""
    if plan_bytes(right) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), key, how)
    return salted_join(left, right, key, how)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows per key in ``order``; every map task forwards at most ``n`` rows per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "rn", partitions: int | None = None) -> DataFrame:
    """Exact 1-based position of every row in ``order``, without a single-partition sort.

    Rows are range-partitioned by all order columns (make the last one unique) and written once, so that a repeated task
    finds the same partitions. Positions are two prefix sums: the place in the partition, and the rows of the partitions
    before, of which the second sorts one row for each partition.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    # monotonically_increasing_id packs (partition, position in partition).
    packed = ranged.sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    fixed = materialize(packed, "numbered").withColumn("_pid", F.shiftright("_mid", 33))
    sizes = fixed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        fixed.join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(1))
        .drop("_pid", "_off", "_mid")
    )


def number_few(df: DataFrame, order: Sequence[Column], name: str = "rn") -> DataFrame:
    """1-based position in ``order`` of the rows of a table that is small by nature, such as one row for each model: one sort, nothing written."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
