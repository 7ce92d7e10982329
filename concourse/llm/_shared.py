"""Helpers that several operators share: reading tables, cutting lineage, hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SETTLED: dict[int, str] = {}
MIX_A = np.uint64(0xFF51AFD7ED558CCD)
MIX_B = np.uint64(0xC4CEB9FE1A85EC53)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Rows hold whole texts, so fewer than the usual 10,000 go to a Python worker at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir; a folder of our own only where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors.

    Shuffle files of the write go as it ends. spent: settled tables that nothing reads after this; they are deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    for old in spent:
        discard(old)
    out = spark.read.schema(df.schema).parquet(path)
    _SETTLED[id(out)] = path
    weakref.finalize(out, _SETTLED.pop, id(out), None)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table."""
    spark, path = df.sparkSession, _SETTLED.get(id(df))
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidy(*memos: dict) -> None:
    """At the end of a task: empty what it remembered and give freed memory back, as a later job may use this worker for something else."""
    for memo in memos:
        memo.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * MIX_A
    h = h ^ (h >> np.uint64(33))
    h = h * MIX_B
    return h ^ (h >> np.uint64(33))
