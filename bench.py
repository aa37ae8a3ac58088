"""Time the headline queries (or, with --all, the whole catalogue) and print one JSON line.

The given files have one row group each, so one task reads and scores a table. ``several_files`` has the times of the
heaviest queries on a copy whose larger tables lie in several files, as they do at scale.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from framelens import build_session
from framelens.plans.catalogue import queries

HEADLINE = (
    "flt_01_topic_filter", "cls_01_presence_score", "cls_02_occurrence_score", "cls_04_signal_hits", "cls_08_framing_type",
    "cls_11_groups", "agg_05_census", "agg_08_group_breakdown", "win_01_dedup_first", "url_10_site_type", "fn_02_html_to_text",
    "cls_26_page_status", "join_01_lookup_host", "join_06_best_source", "join_08_pending", "join_13_points_in_polygons",
    "join_18_closure", "cls_17_answer_class", "agg_02_tallies", "agg_13_composite", "agg_18_cohorts", "st_01_wilson",
    "st_07_logit", "st_08_spearman", "win_02_wrong_samples", "win_07_every_nth",
)

SPLIT = ("documents", "pages", "lineitem", "orders", "events")
HEAVY = ("cls_01_presence_score", "cls_02_occurrence_score", "cls_01_long_lexicon", "cls_08_framing_type", "cls_11_groups", "agg_05_census", "cls_17_answer_class")


def timed(build, spark, sf_dir: str, runs: int) -> float:
    best = None
    for _ in range(runs):
        t0 = time.perf_counter()
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - t0
        best = took if best is None else min(best, took)
    return round(best, 3)


def split_copy(spark, sf_dir: str, to: str, files: int) -> None:
    for name in os.listdir(sf_dir):
        table = name.removesuffix(".parquet")
        if table in SPLIT:
            spark.read.parquet(f"{sf_dir}/{name}").repartition(files).write.parquet(f"{to}/{name}")
        elif os.path.isfile(f"{sf_dir}/{name}"):
            shutil.copy(f"{sf_dir}/{name}", f"{to}/{name}")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    todo = queries()
    names = list(todo) if "--all" in sys.argv else list(HEADLINE)
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # start the executors
    times = {name: timed(todo[name], spark, sf_dir, 1 if "--all" in sys.argv else 2) for name in names}
    several = {}
    if "--all" not in sys.argv:
        with tempfile.TemporaryDirectory() as tmp:
            split_copy(spark, sf_dir, tmp, 2 * (int(cpus) if cpus.isdigit() else 8))
            several = {name: timed(todo[name], spark, tmp, 2) for name in HEAVY}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "several_files": several, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
