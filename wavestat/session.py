"""Spark session helpers.

The library never builds its own cluster configuration: on a cluster the
session comes from the caller.  ``get_session`` is for local runs and tests.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the moment aggregates (X'WX of the models, the pairwise cross-product
    # matrices of the correlation) carry one buffer per matrix entry; keep
    # them inside whole-stage codegen
    "spark.sql.codegen.maxFields": "1000",
    # no Python call-site capture per Column call (driver-side overhead only)
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "wavestat") -> SparkSession:
    """Build (or reuse) a session with the settings the library expects."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    driver_mem = os.environ.get("WAVESTAT_DRIVER_MEMORY")
    if driver_mem:
        builder = builder.config("spark.driver.memory", driver_mem)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is always honoured.  Only
    when it is unset (local runs) a folder in the session's warehouse is used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        # local runs only: no shared folder was named, so use the session's warehouse
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize_with_path(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder; return it reread, and the folder (for ``release``).

    Cuts the lineage: a lost executor re-reads the files instead of recomputing the whole plan.
    """
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/wavestat-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path  # schema given: no job to infer it


def release(spark, path: str) -> None:
    """Delete a folder written by ``materialize_with_path`` once nothing reads it."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hpath, True)
