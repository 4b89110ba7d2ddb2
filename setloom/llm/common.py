"""Shared helpers of the training-data operators: shared storage, range dealing, text batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; where it is unset a local one in local mode (tests), and an error on a cluster."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="setloom-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


#: While a table is written: a query's shuffle files go when the query has ended, as the table needs them no more, and
#: Arrow batches have few rows, as tasks and workers hold several copies of one.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, executors may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    tidy(spark)
    before = {k: spark.conf.get(k) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path, compression=compression)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def tidy(spark: SparkSession, share: float = 0.45) -> None:
    """Have the driver's JVM collect its garbage once its heap has grown past a share of its limit.

    Plans of many steps leave garbage; left alone, the heap grows to its limit before anything is freed, and on top of it
    come code, threads and buffers. A collection also gives unused heap back and lets Spark drop old shuffle files.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > share * runtime.maxMemory():
        spark._jvm.java.lang.System.gc()


def forget(*frames: DataFrame) -> None:
    """Delete tables made by stored() that nothing will read again."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, key: str, parts: int) -> list:
    """At most `parts` values of `key`, each one present in df, the smallest first: starts of about equal ranges.

    Only the key column is read; the driver receives one value per partition.
    """
    fractions = [i / parts for i in range(1, parts)] or [0.5]
    row = df.agg(F.min(key).alias("low"), F.percentile_approx(key, fractions, 20 * parts + 1000).alias("cuts")).first()
    if row["low"] is None:
        return []
    return sorted({row["low"], *row["cuts"]}) if parts > 1 else [row["low"]]


def range_bucket(key: Column, bounds: list) -> Column:
    """Index of the last bound that is not above key, by binary search in the JVM; 0 for nulls and small keys."""
    if len(bounds) < 2:
        return F.lit(0)
    steps = [1 << i for i in reversed(range((len(bounds) - 1).bit_length()))]
    values = F.array(*map(F.lit, bounds))
    n = len(bounds)

    def narrow(low: Column, step: Column) -> Column:
        at = low + step
        fits = (at < n) & (F.element_at(values, F.least(at, F.lit(n - 1)) + 1) <= key)
        return F.when(fits, at).otherwise(low)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), narrow)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, text: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice has at most `rows` rows and about `size` bytes of text (a longer text: alone).

    What Arrow has freed goes back to the system after each batch: a worker outlives its task, and its share is small.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.zeros(batch.num_rows, "i8")
        if text in batch.schema.names:
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype("i8")
        total = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            stop = int(np.searchsorted(total, base + size, "right"))
            stop = min(max(stop, start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
        del batch
        pa.default_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch, nulls as empty texts."""
    return [x or "" for x in batch.column(column).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
