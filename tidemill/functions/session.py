"""Sessions and scoped settings."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def session(app: str = "tidemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that results rely on. Sizes come from SPARK_DRIVER_MEMORY, SPARK_SHUFFLE_PARTITIONS, SPARK_MAX_PARTITION_BYTES."""
    builder = SparkSession.builder.appName(app)
    master = master or os.environ.get("SPARK_MASTER")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.legacy.timeParserPolicy": "CORRECTED",
        "spark.sql.files.maxPartitionBytes": os.environ.get("SPARK_MAX_PARTITION_BYTES", "128m"),
        "spark.ui.showConsoleProgress": "false",
    }
    if "SPARK_SHUFFLE_PARTITIONS" in os.environ:
        settings["spark.sql.shuffle.partitions"] = os.environ["SPARK_SHUFFLE_PARTITIONS"]
    if "SPARK_DRIVER_MEMORY" in os.environ:
        settings["spark.driver.memory"] = os.environ["SPARK_DRIVER_MEMORY"]
    spark = builder.config(map=settings | conf).getOrCreate()
    spark.sparkContext.setLogLevel(os.environ.get("SPARK_LOG_LEVEL", "WARN"))
    return spark


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings (double underscores for dots) for the length of a block."""
    names = {k.replace("__", "."): str(v) for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries in this block go when each ends; a plan that ran here must not run again."""
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        yield
