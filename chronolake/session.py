"""Spark sessions with the settings the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    """A session in UTC with adaptive execution. On a cluster leave ``master`` and ``partitions`` to its configuration."""
    b = SparkSession.builder.appName("chronolake")
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in (conf | more).items():
        b = b.config(k, v)
    return b.getOrCreate()
