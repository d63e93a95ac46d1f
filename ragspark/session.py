"""Session settings that suit this engine's plans."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "ragspark", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; other settings by keyword with ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
