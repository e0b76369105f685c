"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if (held := sc._jsc.sc().getCheckpointDir()).isDefined():
        return held.get().rstrip("/")
    own = f"/tmp/checkpoints/inkwell-{os.getuid()}"
    sc.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


#: Folders that each open ``passing`` block has asked for.
_OPEN: list[list[str]] = []


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables materialized in the block are removed at its end, but for those given to the function that it yields.

    For steps that end in written tables: nothing that outlives the block may read the others.
    """
    made, kept = [], set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._inkwell_path)
        return df

    _OPEN.append(made)
    try:
        yield keep
    finally:
        _OPEN.remove(made)
        if _OPEN:
            _OPEN[-1].extend(kept)
        for path in made:
            if path not in kept:
                remove(spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and it survives lost executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._inkwell_path = path
    return back


def remove(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def discard(df: DataFrame) -> None:
    """Remove a materialized table that nothing reads any more."""
    if path := getattr(df, "_inkwell_path", None):
        remove(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Remove all tables and archives that this application has written to the shared folder, once nothing reads them."""
    remove(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")


def trim() -> None:
    """Give memory that a worker no longer uses back to the system; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
