"""Sessions with the settings that the dialect's semantics rest on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: What decides results: overflow and bad casts are errors, clocks have no zone, names keep their case.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.caseSensitive": "true",
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.parquet.datetimeRebaseModeInRead": "CORRECTED",
    # COUNT, MIN and MAX over whole files come from their footers, where a source is opened for that.
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Where all of a join's partitions turn out to be that small when they are there, hashing them is cheaper than sorting both sides.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
}


def own(spark: SparkSession) -> SparkSession:
    """A session of its own over the same context, with the engine's settings; the given one stays as it is."""
    new = spark.newSession()
    for k, v in SETTINGS.items():
        new.conf.set(k, v)
    return new


def local(cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session, for the command line and tests."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("millrace").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    b = b.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", os.environ.get("MILLRACE_MEMORY", "4g"))
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
