"""Session settings that the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: str | int | None = None) -> SparkSession:
    """Adaptive plans, ANSI errors, UTC; partitions: shuffle partitions, which adaptive plans then coalesce."""
    b = SparkSession.builder.appName("loomgraph")
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    }.items():
        b = b.config(k, v)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    if master and master.startswith("local"):
        b = b.config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
