"""SparkSession settings this library is developed against."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(master: str | None = None, *, shuffle_partitions: int | None = None, app: str = "cladeframe") -> SparkSession:
    """Get or create a session: UTC, adaptive execution on, Arrow on.

    On a cluster leave ``master`` unset and let spark-submit decide. ``shuffle_partitions``
    is only an upper bound, adaptive execution merges small partitions.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            b = b.config("spark.driver.memory", os.environ.get("CLADEFRAME_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
