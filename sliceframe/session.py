"""Session helper for tests, the bench and the command line."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(master: str = "local[*]", extra: dict | None = None) -> SparkSession:
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | (extra or {})
    b = SparkSession.builder.master(master).appName("sliceframe")
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
