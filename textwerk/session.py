"""A session with the settings that the operators are planned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive plans, skew joins and UTC; Arrow batches bounded. master is only set where none is given by the
    environment that submits the job."""
    b = SparkSession.builder.appName("textwerk")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def local_session(cores: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return get_session(f"local[{n}]", **{"spark.sql.shuffle.partitions": str(shuffle_partitions or n), "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
