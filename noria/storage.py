"""Intermediate tables in shared storage.

Lineage is cut by writing Parquet below the folder that the cluster names in ``spark.checkpoint.dir``;
every executor and the driver can read it again, so a lost executor costs a re-read and never a
recomputation of everything before it. The tables go when the driver's JVM ends, or with ``clear``.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="noria-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where it is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.conf.get("spark.master", "local").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = _own_folder()
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; what is written there goes with the driver."""
    path = f"{shared_folder(spark)}/noria-{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    _WRITTEN.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete all tables that this driver has stored; how many there were. DataFrames that read them can't be used any more."""
    n = len(_WRITTEN)
    while _WRITTEN:
        there = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    return n
