"""Spark session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "ticklens",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE on and UTC time zone; reuses an active session if one exists.

    The master is set only when it is given or when nothing else names one: under
    ``spark-submit`` the cluster's own setting stays.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder
    if master or not ("PYSPARK_GATEWAY_PORT" in os.environ or "SPARK_REMOTE" in os.environ):
        builder = builder.master(master or f"local[{cpus}]")
    builder = (
        builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus) * 2))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TICKLENS_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared, durable folder and is used as is; leaving it unset
    there is an error, because a folder of one machine is lost with it. Only a local session
    (tests, a laptop) gets a fresh local folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not current:
        current = sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
    path = tempfile.mkdtemp(prefix="ticklens-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path
