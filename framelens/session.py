"""Session settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "framelens", shuffle_partitions: int | None = None) -> SparkSession:
    """Build a session.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit
    configuration decides, and AQE coalesces or splits partitions at run time.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master is not None:
        builder = builder.master(master)
        if master.startswith("local"):
            # One JVM: no UI, and all of the heap belongs to the driver.
            builder = (
                builder.config("spark.ui.enabled", "false")
                .config("spark.driver.memory", "8g")
                .config("spark.driver.bindAddress", "127.0.0.1")
                .config("spark.driver.host", "127.0.0.1")
            )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
