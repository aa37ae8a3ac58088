"""Writers. Spark's committer replaces locks and append files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_jsonl(df: DataFrame, path: str, mode: str = "append", compression: str | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.option("compression", compression) if compression else writer).json(path)


def stringify(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text; null stays null."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
        out.append((F.to_json(c) if nested else c).alias(f.name))
    return df.select(*out)


def write_dataset(df: DataFrame, path: str, nested_as_json: bool = True, partition_by: Sequence[str] = (),
                  mode: str = "overwrite") -> None:
    out = stringify(df) if nested_as_json else df
    writer = out.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, cols: Sequence[str], sort: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Fixed column order; sorted across the part files when ``sort`` is given."""
    out = df.select(*cols)
    (out.orderBy(*sort) if sort else out).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_splits(df: DataFrame, path: str, verified: Column, mode: str = "overwrite") -> None:
    """The full table and its verified part as two splits."""
    flat = stringify(df)
    flat.write.mode(mode).parquet(f"{path}/full")
    flat.where(verified).write.mode(mode).parquet(f"{path}/verified")


def write_summary(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-row nested summary as one JSON document."""
    df.coalesce(1).write.mode(mode).json(path)


def write_counted(df: DataFrame, by: Sequence[str], write: Callable[[DataFrame], None], groups: int = 50_000) -> DataFrame:
    """Write ``df`` and return the rows written for each value of ``by`` (as text), counted by the writing job itself.

    The counters are metrics that the job observes on its way, merged from one small table in each task. They are exact for up
    to ``groups`` values, such as a file with a label, which is checked by their sum; beyond that it raises after the write.
    """
    spark, seen = df.sparkSession, Observation()
    key = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"k{i}") for i, c in enumerate(by)]))
    keyed = df.withColumn("_key", key)
    watched = keyed.observe(seen, F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(_key, {groups}, {2 * groups})").alias("top"))
    write(watched.drop("_key"))
    got = seen.get
    rows = [(t["item"], t["count"]) for t in got["top"] or []]
    if sum(n for _, n in rows) != got["n"]:
        raise ValueError(f"more than {groups} groups: the rows are written, count them from there")
    parsed = F.from_json("k", ", ".join(f"k{i} string" for i in range(len(by))))
    return spark.createDataFrame(rows, "k string, n long").select(*[parsed[f"k{i}"].alias(c) for i, c in enumerate(by)], "n")
