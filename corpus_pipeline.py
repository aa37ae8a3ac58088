"""From documents to shards: reject, deduplicate, decontaminate, mix, shard. Each stage is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from framelens.llm import queries as q
from framelens.operators.scale import checkpoint_root

STAGES = [
    ("quality classifier", q.stage_quality),
    ("n-gram Jaccard join", q.stage_near_copies),
    ("benchmark decontamination", q.stage_decontamination),
    ("mixing sources to target weights", q.stage_mixing),
    ("sharding", q.stage_sharding),
]

# Trained models and hashed orders cannot be said in SQL; tests/llm compares the stages with plain computations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage's rows are written to the shared folder and read as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{root}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
