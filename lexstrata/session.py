"""Session defaults: UTC, adaptive execution, native ANSI semantics."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(name: str = "lexstrata", **conf: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=DEFAULTS | conf).getOrCreate()
