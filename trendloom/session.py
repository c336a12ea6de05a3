"""Session defaults shared by the bench, the tests and local runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "trendloom", cpus: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with UTC time, adaptive execution and small shuffles.

    On a cluster the session comes from spark-submit; only the settings that
    results depend on (UTC) are assumed by the library.
    """
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
