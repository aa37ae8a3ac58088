"""Incremental forms: classify new files once, skip known keys, running and windowed counts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from framelens.lexicon import Lexicon
from framelens.operators.classify import classify
from framelens.operators.scale import discard, exists, materialize

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", glob: str | None = None,
                files_per_trigger: int = 1_000) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def classify_stream(docs: DataFrame, lex: Lexicon, out: str, checkpoint: str, **kw) -> StreamingQuery:
    """Classify new documents and append the result exactly once (file sink and its log)."""
    return (
        classify(docs, lex, **kw)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB: on disk, read and written by key. A query copies the setting when it starts."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def skip_seen(stream: DataFrame, keys: Sequence[str], out: str, checkpoint: str, order: Sequence[str] = ()) -> StreamingQuery:
    """Append only rows whose key was not written before, also across restarts and by other queries on the same output.

    The keys are keyed state, so a batch reads its own rows and looks up their keys; what was written before is not read
    again. Rows of a key are reduced in each task before the shuffle. Within a batch the first row in ``order`` (else by key)
    stays. Keys compare column by column, null with null.

    Files that other queries put into ``out`` are a second source of this query: the first batch of a fresh checkpoint learns
    their keys, later batches only those of new files. Each batch has its own folder, named by its checkpoint and number, so a
    replayed batch overwrites only itself. A row is new if its key was first seen in this batch: a batch has one time,
    kept in the checkpoint, which a replay repeats.
    """
    spark, by = stream.sparkSession, list(order) or list(keys)
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    if not exists(spark, f"{out}/run={run}"):
        spark.createDataFrame([], stream.schema).write.parquet(f"{out}/run={run}/batch=-1")
    written = T.StructType([*stream.schema.fields, T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())])
    others = spark.readStream.schema(written).parquet(out).where(F.col("run") != run)

    def tagged(df: DataFrame, old: bool) -> DataFrame:
        key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("_k")
        row = F.struct(*[F.col(c) for c in stream.columns]).alias("_row")
        return df.select(key, row, F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(by)]).alias("_by"), F.lit(old).alias("_old"))

    rows = tagged(stream, False).unionByName(tagged(others, True)).withColumn("_at", F.current_timestamp())
    firsts = rows.groupBy("_k").agg(
        F.max("_old").alias("_old"), F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.min_by("_row", F.struct("_at", "_by")).alias("_row"))

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.where(~F.col("_old") & (F.col("_first") == F.col("_last")))
        new.select("_row.*").write.mode("overwrite").parquet(f"{out}/run={run}/batch={batch_id}")

    with rocksdb_state(spark):
        return firsts.writeStream.option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).foreachBatch(write).start()


def dedup_within(stream: DataFrame, keys: Sequence[str], ts: str, watermark: str) -> DataFrame:
    """Drop repeated keys that arrive within the watermark; the state stays bounded.

    Use :func:`skip_seen` when a key must never come back.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return timed.dropDuplicatesWithinWatermark(list(keys))


def running_counts(stream: DataFrame, by: Sequence[str]) -> DataFrame:
    """Running counters; use complete or update mode."""
    return stream.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(stream: DataFrame, ts: str, width: str, by: Sequence[str], watermark: str = "1 day") -> DataFrame:
    """Counts per fixed window and key. In update or append mode the watermark drops the state of old windows; in complete mode all state stays."""
    return (
        stream.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, watermark)
        .groupBy(F.window(ts, width), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), *by, "n")
    )


def run_to_windows(df: DataFrame, out: str, checkpoint: str, by: Sequence[str], window: str = "window_start") -> StreamingQuery:
    """Keep the latest row of every (window, key) of an aggregated stream in ``out``, one partition for each window.

    A batch rewrites the windows that it touches and no others: their rows with other keys are carried over. Its own rows
    are the state's values, so a replayed batch writes the same. ``out`` has the columns of ``df`` and ``window_id``.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = materialize(batch.withColumn("window_id", F.unix_micros(window)), "windows")
        # One row for each window that the batch touches, which the watermark bounds.
        touched = [r["window_id"] for r in new.select("window_id").distinct().collect()]
        if touched and exists(spark, out):
            same = reduce(lambda a, b: a & b, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("window_id", *by)])
            old = spark.read.schema(new.schema).parquet(out).where(F.col("window_id").isin(touched))
            kept = materialize(old.alias("o").join(new.alias("n"), same, "left_anti").unionByName(new), "windows")
        else:
            kept = new
        if touched:
            kept.write.partitionBy("window_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(out)
        discard(*{id(x): x for x in (new, kept)}.values())

    with rocksdb_state(df.sparkSession):
        return df.writeStream.option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).foreachBatch(write).start()


def run_to_table(df: DataFrame, out: str, checkpoint: str, mode: str) -> None:
    """Drive an aggregated stream over everything available and keep its latest result in ``out``.

    Complete mode replaces the table with each batch.
    """

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    query = writer.foreachBatch(write).start()
    query.awaitTermination()


def drain(start: Callable[[], StreamingQuery]) -> None:
    """Start a query with an available-now trigger and wait for it."""
    start().awaitTermination()
