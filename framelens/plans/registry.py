"""Query catalogue: a Spark plan and, where SQL can say it, an independent oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


@dataclass(frozen=True)
class Tables:
    """The given tables of one directory, read on access."""

    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def derived(self, name: str) -> DataFrame:
        """A record table derived from the given tables by the shared SQL in ``records``."""
        from framelens.plans.records import RECORDS

        sql = RECORDS[name]
        used = {x: getattr(self, x) for x in TABLES if "{" + x + "}" in sql}
        return self.spark.sql(sql, **used)


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(tables)`` under ``name``."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in CATALOGUE:
            raise ValueError(f"duplicate query {name}")
        CATALOGUE[name] = Query(build, sql)
        return build

    return add


def with_records(names: list[str] | str, body: str) -> str:
    """Oracle text over derived record tables: the same derivation as a common table expression."""
    from framelens.plans.records import RECORDS

    names = [names] if isinstance(names, str) else names
    plain = {x: x for x in TABLES}
    parts = [f"{n} AS ({RECORDS[n].format(**plain)})" for n in names]
    return "WITH " + ",\n".join(parts) + "\n" + body
