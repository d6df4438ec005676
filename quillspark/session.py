"""Spark session factory used by the benchmark and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", app: str = "quillspark", shuffle_partitions: int = 8,
                  driver_memory: str = "8g", **settings: str) -> SparkSession:
    """A session with AQE and UTC on; settings are more of Spark's, with _ for dots. Every other one stays Spark's own."""
    builder = SparkSession.builder
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return (
        builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
