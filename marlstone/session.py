"""Session with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: AQE re-plans joins, splits skewed partitions and coalesces small ones from measured sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build(master: str | None = None, **settings: str) -> SparkSession:
    """A session; ``master`` only where no submitter names one."""
    builder = SparkSession.builder.appName("marlstone").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()
