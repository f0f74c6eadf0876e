"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Select ``names`` from ``df``, whatever other columns it has.

    Exact names win over names that differ in case; of repeated names the first is taken.
    """
    at = []
    for name in names:
        found = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not found:
            raise ValueError(f"column {name!r} is missing; there are {df.columns}")
        at.append(found[0])
    if len({c.lower() for c in df.columns}) < len(df.columns):
        df = df.toDF(*(f"c{i}_" for i in range(len(df.columns))))
    return df.select(*(F.col(f"`{df.columns[i]}`").alias(n) for i, n in zip(at, names)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a folder is made for a local master only; a cluster must name one.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="textquarry-")
        spark.sparkContext.setCheckpointDir(set_to)
        set_to = spark.sparkContext.getCheckpointDir()
    return set_to.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/textquarry/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again, so that its lineage ends there.

    Results are read from such tables lazily, so they stay until ``clear`` is called.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application's operators have written; call it when their results have been read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_bytes(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts that hold about ``most`` bytes together; a longer text is a run of its own."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    block = np.cumsum(size) // most
    at = np.flatnonzero(np.diff(block, prepend=-1)) if len(size) else np.zeros(0, np.int64)
    yield from zip(at.tolist(), [*at[1:].tolist(), len(size)])


def tidy(run):
    """A function over Arrow batches that gives its memory back at the end: workers live on for other stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
