"""Session defaults for tests, the bench and ad-hoc use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session; on a cluster the submitter's own settings win over these."""
    cpus = cpus or os.cpu_count() or 1
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shelfwise")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
