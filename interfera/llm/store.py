"""Where intermediate tables live, and which sizes may be broadcast."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A list of ids may be broadcast up to this many rows (16 bytes each, so 32 MB).
BROADCAST_IDS = 2_000_000


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and returns it with a short lineage.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset, one is set in local mode only.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint(eager=True)


def folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; an error on a cluster that names none."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir"):
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir is unset: it names a folder that the driver and the executors share")
    return os.path.join(tempfile.gettempdir(), "spark-checkpoints")


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of the counted number of ``rows``, marked for broadcasting if that is within BROADCAST_IDS."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once, as texts may be very long: batches end at so many rows or bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, and at a task's end the system gets back what the allocators of its Python worker keep: the worker lives
    on for later stages, beside others."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
            trim(0)

    return whole
