"""Readers with explicit schemas.

Gzip files are not splittable: one task reads one shard. Repartition after the
topic filter, when little text is left, rather than before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelens.operators.scale import exists

CORPUS = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("timestamp", T.VariantType()),
    ]
)
CORRUPT = "_corrupt_record"


def read_corpus(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = CORPUS, with_file: bool | str = False,
                keep_bad: bool = False) -> DataFrame:
    """JSON-lines shards, plain or compressed by extension; globs are allowed.

    A line that is no JSON object, or that has no ``text``, is bad. Bad lines
    are dropped, or kept with ``is_bad`` set so that they can be counted.
    ``with_file`` adds the file name, ``with_file="path"`` the whole path.
    """
    fields = [f for f in schema.fields if f.name != CORRUPT]
    full = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    raw = spark.read.schema(full).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    bad = F.col(CORRUPT).isNotNull() | F.col("text").isNull()
    cols = [F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if f.name == "url" else F.col(f.name) for f in fields]
    if with_file:
        cols.append(F.col("_metadata.file_path" if with_file == "path" else "_metadata.file_name").alias("file"))
    out = raw.select(*cols, bad.alias("is_bad"))
    return out if keep_bad else out.where(~F.col("is_bad")).drop("is_bad")


def corpus_counts(df: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """Total lines (bad ones included) and parse errors of ``read_corpus(keep_bad=True)``."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if("is_bad").alias("errors"))


def select_shards(df: DataFrame, start: int | None = None, end: int | None = None, ids: Sequence[int] | None = None,
                  file: str = "file", pattern: str = "([0-9]+)") -> DataFrame:
    """Rows of a shard range (end exclusive) or of an explicit shard list.

    The shard number is group 1 of ``pattern``, the first run of digits by default.
    """
    shard = F.regexp_extract(F.col(file), pattern, 1).try_cast("int")
    if ids is not None:
        return df.where(shard.isin(*ids))
    cond = F.lit(True)
    if start is not None:
        cond = cond & (shard >= start)
    if end is not None:
        cond = cond & (shard < end)
    return df.where(cond)


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, limit: int | None = None) -> DataFrame:
    """Tolerant JSON lines: malformed and blank lines are dropped; optional row cap."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df if limit is None else df.limit(limit)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, header: bool = True, multi_line: bool = False) -> DataFrame:
    """CSV with quotes; positional columns when ``header`` is off.

    A record is a line, so a large file is read by many tasks. ``multi_line`` allows line breaks within quotes; then one task reads a file.
    """
    return (
        spark.read.schema(schema).option("header", header).option("multiLine", multi_line).option("escape", '"').csv(path)
    )


def read_registry_csv(spark: SparkSession, path: str | Sequence[str], columns: int, multi_line: bool = False) -> DataFrame:
    """Headerless CSV as ``c0 … cN`` plus ``remarks``, the last non-null column of the row."""
    names = [f"c{i}" for i in range(columns)]
    df = read_csv(spark, path, ", ".join(f"{n} string" for n in names), False, multi_line)
    return df.withColumn("remarks", F.coalesce(*[F.col(n) for n in reversed(names)]))


def read_directory(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Tab-separated directory (domain, origin, type, path); the last line of a domain counts.

    At most four fields per line: further tabs belong to the path. Lines with
    fewer than three fields are ignored.
    """
    lines = spark.read.text(path).select(
        F.split("value", "\t", 4).alias("p"),
        F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_i"),
    )
    rows = lines.where(F.size("p") >= 3).select(
        F.col("p")[0].alias("domain"), F.col("p")[1].alias("origin"), F.col("p")[2].alias("type"),
        F.get(F.col("p"), F.lit(3)).alias("path"), "_f", "_b", "_i",
    )
    last = F.max_by(F.struct("origin", "type", "path"), F.struct("_f", "_b", "_i")).alias("v")
    return rows.groupBy("domain").agg(last).select("domain", "v.*")


def find_field(spark: SparkSession, path: str | Sequence[str], keyword: str, sep: str, index: int = 0,
               prefix: bool = False, skip: str | None = None) -> DataFrame:
    """Field ``index`` (−1 for the last) of the delimited lines that contain or start with a keyword."""
    value = F.col("value")
    hit = F.startswith(value, F.lit(keyword)) if prefix else F.contains(F.lower(value), F.lit(keyword.lower()))
    lines = spark.read.text(path).where(hit)
    if skip is not None:
        lines = lines.where(~F.startswith(value, F.lit(skip)))
    parts = F.split_part(value, F.lit(sep), F.lit(index + 1 if index >= 0 else index))
    return lines.select(F.trim(value).alias("line"), F.trim(parts).alias("field"))


def read_manifests(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Small JSON documents, a row for each file, kept under their name; a name without a file gives an unavailable row."""
    parts = []
    for name, path in paths.items():
        folder, _, base = path.rpartition("/")
        if exists(spark, folder):
            files = spark.read.option("wholetext", True).option("pathGlobFilter", base).text(folder).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("manifest"))
        else:
            files = spark.createDataFrame([], "file string, manifest string")
        # The files of one manifest are few and small by nature; the outer explode keeps a row where there is none.
        found = files.agg(F.array_sort(F.collect_list(F.struct("file", "manifest"))).alias("f")).select(F.inline_outer("f"))
        parts.append(found.select(F.lit(name).alias("name"), F.col("manifest").isNotNull().alias("available"), "file", "manifest"))
    return reduce(DataFrame.unionByName, parts)


FEATURE = "struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>"
RING = "array<array<array<double>>>"


def read_geojson(spark: SparkSession, path: str | Sequence[str], lines: bool = False) -> DataFrame:
    """Features as rows: ``properties``, ``type`` and ``polygons``.

    ``polygons`` is an array of polygons (arrays of rings of points) for
    Polygon and MultiPolygon geometries and null for other types. A feature
    collection is one document, which one task reads; with ``lines`` each line
    is a feature (RFC 8142, with or without its record separator), and a large
    file is read by many tasks. Lines that are no feature are dropped.
    """
    if lines:
        text = spark.read.text(path).select(F.translate("value", "\x1e", "").alias("v"))
        f = text.select(F.from_json("v", FEATURE).alias("f")).where("f.geometry IS NOT NULL OR f.properties IS NOT NULL")
    else:
        f = spark.read.option("multiLine", True).schema(f"features array<{FEATURE}>").json(path).select(F.explode("features").alias("f"))
    coords, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    one = F.from_json(coords, RING)
    many = F.from_json(coords, f"array<{RING}>")
    return f.select(
        F.col("f.properties").alias("properties"),
        kind.alias("type"),
        F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many).alias("polygons"),
    )
