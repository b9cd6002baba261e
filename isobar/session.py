"""Session factory with the settings the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "isobar", cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Return a session: UTC, adaptive execution and Arrow on, shuffle partitions near the core count.

    On a cluster pass ``shuffle_partitions`` of two to three times the executor cores; adaptive
    execution then coalesces what is too small and splits what is skewed.
    """
    b = (
        SparkSession.builder.master(os.environ.get("SPARK_MASTER", f"local[{cores}]"))
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
