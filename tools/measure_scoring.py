"""Throughput of the scorers by lexicon size, on the given file and on a copy of several row groups, and cost of the six-way tally.

    python tools/measure_scoring.py [sf-dir] [cores]
"""

from __future__ import annotations

import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from framelens import Lexicon, Signal, build_session  # noqa: E402
from framelens.operators import aggregates as ag  # noqa: E402
from framelens.operators import classify as cl  # noqa: E402
from framelens.plans.registry import Tables  # noqa: E402


def timed(df) -> float:
    t0 = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def shuffle_bytes(spark) -> int:
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    cores = sys.argv[2] if len(sys.argv) > 2 else "4"
    spark = build_session(f"local[{cores}]", shuffle_partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    t = Tables(spark, sf_dir)
    docs = t.documents.cache()
    n = docs.count()
    # The most frequent words of the corpus as signals.
    words = [r["w"] for r in docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("length(w) > 2").groupBy("w").count().orderBy(F.desc("count"), "w").limit(200).collect()]
    with tempfile.TemporaryDirectory() as tmp:
        t.documents.repartition(4 * int(cores)).write.parquet(f"{tmp}/copy")
        for name, source in (("cached", docs), ("given file", t.documents), (f"copy of {4 * int(cores)} files", spark.read.parquet(f"{tmp}/copy"))):
            for mode in ("presence", "occurrence"):
                for k in (10, 50, 100, 200):
                    lex = Lexicon(tuple(Signal(f" {w} ", "ab"[i % 2], 1.0) for i, w in enumerate(words[:k])))
                    best = min(timed(cl.with_scores(source, lex, mode=mode).select("score_a", "score_b")) for _ in range(3))
                    print(f"{name}, {mode}, {k} signals: {best:.2f} s, {n / best:,.0f} docs/s")
    answers = t.derived("answers")
    before = timed(ag.tallies(answers, "q1"))
    print(f"six-way tally: {min(before, timed(ag.tallies(answers, 'q1'))):.2f} s")
    try:
        s0 = shuffle_bytes(spark)
        cached = answers.cache()
        cached.count()
        s1 = shuffle_bytes(spark)
        timed(ag.tallies(cached, "q1"))
        print(f"six-way tally shuffle: {shuffle_bytes(spark) - s1:,} bytes (input join before it: {s1 - s0:,})")
    except Exception as e:  # the status store is no public API
        print("shuffle bytes not available:", str(e)[:120])


if __name__ == "__main__":
    main()
