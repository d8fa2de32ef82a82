"""A session with the settings that the plans here count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "sparkloom", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew-join splitting, UTC, and Arrow; on a cluster set spark.checkpoint.dir to a shared folder."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
