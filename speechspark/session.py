"""Session helper for local runs and tests; clusters bring their own session."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: int = 8, name: str = "speechspark", **conf) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for streaming checkpoints.

    The cluster names it in ``spark.checkpoint.dir``; only a local master, where
    every executor sees the same disk, may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="speechspark-")


def kept(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's folder, or in our own where none is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not share the driver's path."""
    import speechspark

    root = os.path.dirname(os.path.dirname(os.path.abspath(speechspark.__file__)))
    if getattr(spark.sparkContext, "_speechspark_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="speechspark-pkg-")
    archive = shutil.make_archive(os.path.join(folder, "speechspark"), "zip", root, "speechspark")
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._speechspark_shipped = True
