"""Session factory: Spark's own defaults, adaptive execution on, UTC, no local paths."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "orrery", **conf: str) -> SparkSession:
    """`conf`: Spark settings with dots written as double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
