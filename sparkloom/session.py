"""The engine's session settings, pinned so that results don't depend on the machine."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.cbo.enabled": "true",
}


def session(app: str = "sparkloom", master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; shuffle_partitions should follow the data (about 128 MB each)."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | more)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
