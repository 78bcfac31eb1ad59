"""SparkSession factory used by the bench, the tests and the command line."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with AQE, ANSI mode, UTC and Arrow on.

    On a cluster leave `master` unset: spark-submit's settings then hold.
    """
    b = SparkSession.builder.appName("lodestrata")
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = os.environ.get("LODESTRATA_DRIVER_MEMORY", "8g")
    for k, v in {**conf, **extra}.items():
        b = b.config(k, v)
    return b.getOrCreate()
