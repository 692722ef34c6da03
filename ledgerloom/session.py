"""Session with what the engine wants: UTC, adaptive plans, skew joins."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "ledgerloom", **conf: str) -> SparkSession:
    wanted = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(name)
    for k, v in wanted.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
