"""The session the library is meant to run in."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "cohortlake", **conf: str) -> SparkSession:
    """UTC, adaptive execution and ANSI mode; conf entries use ``__`` for the dots of Spark's names."""
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true"}
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
