"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import gc
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31T00:00:00Z"


def build(app: str = "pagelens", master: str = "local[8]", **conf: str) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """Day bounds and timestamp casts are defined in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables, reachable by every executor.

    It comes from ``spark.checkpoint.dir``; where that is unset it lies beside the warehouse, which
    executors share too.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(shared or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch")
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, partitioned as it was.

    For intermediates whose layout later passes rely on; they read all of its columns.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder as columns: later passes read only those they need."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffles of jobs that are over: it does so when the driver collects their plans, which a large heap puts off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
