"""Session factory with the settings every operator assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[8]", partitions: int = 8, memory: str = "16g", **more: str) -> SparkSession:
    """A session for local work; on a cluster pass the cluster's own session to the operators instead."""
    builder = SparkSession.builder.master(master).appName("ledgerlight").config("spark.driver.memory", memory)
    for key, value in (SETTINGS | {"spark.sql.shuffle.partitions": str(partitions)} | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
