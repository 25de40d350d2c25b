"""A session with the settings that the engine's plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "archsieve", **settings: str) -> SparkSession:
    """Adaptive plans, skew splitting and UTC; other settings by name, dots written as two underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
