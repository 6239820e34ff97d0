"""A session with the settings the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **config: str) -> SparkSession:
    """UTC and adaptive execution with skew joins; ``config`` has dots written as double underscores."""
    builder = SparkSession.builder.appName("tickloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in config.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
