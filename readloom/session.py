"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "readloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with this library's settings; those given win. Without a master the cluster's is used."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | settings).items():
        b = b.config(k, v)
    return b.getOrCreate()
