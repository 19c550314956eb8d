"""The session used by tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, memory: str = "8g", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with adaptive execution and a UTC clock.

    On a cluster the session comes from the submitter; nothing in the package
    reads settings that only this function makes.
    """
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("textwarrant")
        .config("spark.driver.memory", os.environ.get("TEXTWARRANT_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
