"""Session helper for local work and tests; on a cluster the submitter configures Spark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str | None = None, app: str = "tessera", **conf: str) -> SparkSession:
    """A local session with adaptive execution, UTC timestamps and small shuffles.

    ``cores`` defaults to ``BENCH_CPUS`` or 8; ``conf`` overrides any setting (use
    ``**{"spark.x": "y"}``).
    """
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
