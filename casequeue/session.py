"""Session helper shared by tests, the bench and cluster jobs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

BATCH_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well as rows, unless the session has its own bound."""
    if int(spark.conf.get(BATCH_BYTES_CONF, str(2**31 - 1))) == 2**31 - 1:
        spark.conf.set(BATCH_BYTES_CONF, str(BATCH_BYTES))


def local_session(app: str = "casequeue", cpus: str | int = "*") -> SparkSession:
    """Local session for tests and the bench; clusters bring their own."""
    partitions = str(cpus) if str(cpus).isdigit() else "8"
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CASEQUEUE_DRIVER_MEMORY", "8g"))
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
