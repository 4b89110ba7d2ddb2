"""Tables that jobs write for themselves, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local folder in local mode (tests), and an error on a cluster."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="setloom-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def tidy(spark: SparkSession, share: float = 0.45) -> None:
    """Have the driver's JVM collect its garbage once its heap has grown past a share of its limit, as plans of many steps leave much."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > share * runtime.maxMemory():
        spark._jvm.java.lang.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    tidy(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
