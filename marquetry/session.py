"""A Spark session with the settings the engine assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "marquetry", **conf: str) -> SparkSession:
    """Adaptive execution, UTC and Arrow; anything given overrides. Shuffle partitions are left to adaptive coalescing."""
    builder = SparkSession.builder.appName(name)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
