"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lotlens", master: str | None = None, **conf: str) -> SparkSession:
    """UTC and adaptive execution; anything else the cluster sets stays."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    return builder.config(map={k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
