"""A session with the settings that the engine's plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "marlstone", **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow; partitions are left to the cluster and to adaptive coalescing unless conf says otherwise."""
    builder = SparkSession.builder.appName(name)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false", "spark.sql.unionOutputPartitioning": "false"}
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
