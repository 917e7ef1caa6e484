"""A session with the settings the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "provspark", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, and whatever ``settings`` add."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    return builder.config(map=base | settings).getOrCreate()
