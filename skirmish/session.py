"""Session helper shared by the bench, the tests and scripts."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "skirmish", cores: str | None = None, partitions: int = 8) -> SparkSession:
    """A local session with the settings that the engine expects of a cluster session too.

    AQE coalesces and splits shuffle partitions; the time zone is fixed because epoch
    arithmetic on ``timestamp_ntz`` columns depends on it.
    """
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SKIRMISH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
