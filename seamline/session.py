"""Session helpers shared by queries, bench and tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers started after this call.

    A deployed job ships the package with ``--py-files``; this covers sessions whose driver found the
    repository through ``sys.path`` alone, which Python workers don't inherit.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def local_session(cpus: str | int = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and bench share."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("seamline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark
