"""A session with what the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "letterloom", **options: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")  # long expressions are built in half the time
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
