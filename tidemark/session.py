"""A session with the settings that the engine's results assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; partitions: for shuffles, else Spark's own."""
    builder = SparkSession.builder.appName("tidemark")
    builder = builder.master(master) if master else builder
    own = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    own |= {"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}
    return builder.config(map=own | conf).getOrCreate()
