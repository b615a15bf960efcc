"""Stores of frames laid out for how they are read: by utterance without a shuffle, or by a range of places without a scan.

``save_bucketed`` writes a table whose files are buckets of a key, sorted within: tables with the same key and number of buckets are joined
file by file, without an exchange. ``write_ranges`` writes rows in order of a running place, so that a range of places is found by the
minima and maxima that Parquet keeps of row groups and pages, which stand in for an offset index.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LAYOUT = "_layout.json"


def _layout_file(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/" + _LAYOUT)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def _quoted(columns: list[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def save_bucketed(df: DataFrame, path: str, key: str, order: list[str], buckets: int) -> DataFrame:
    """Write ``df`` below ``path`` in one file for each bucket of ``key``, sorted by key and order, and return the table.

    A key's rows lie in one file, so a key must be no larger than a file may be (an utterance is). The layout is written beside the
    files, hidden from readers, so that another session can ``open_bucketed``.
    """
    spark, name = df.sparkSession, f"noria_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key, *order).option("path", path).saveAsTable(name)
    there, fs = _layout_file(spark, path)
    out = fs.create(there, True)
    out.write(bytearray(json.dumps({"key": key, "order": order, "buckets": buckets, "schema": df.schema.jsonValue()}).encode()))
    out.close()
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``save_bucketed`` wrote, its layout known to the planner."""
    there, fs = _layout_file(spark, path)
    stream = fs.open(there)
    layout = json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))  # a schema
    stream.close()
    name = f"noria_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(layout["schema"]))
    ordered = _quoted([layout["key"], *layout["order"]])
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{layout['key']}`) SORTED BY ({ordered}) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def frames_of(index: DataFrame, frames: DataFrame, key: str = "utt_id") -> DataFrame:
    """Rows of the index with each of their frames: those numbered from 0 up to the index's ``frames``. By key, so that two bucketed tables need no exchange."""
    other = frames.withColumnRenamed(key, "_of")
    # a hint, as broadcasting one side would scan it whole for every task
    joined = index.hint("merge").join(other, index[key] == F.col("_of"))
    return joined.where((F.col("frame") >= 0) & (F.col("frame") < F.col("frames"))).drop("_of")


def write_ranges(df: DataFrame, path: str, at: str, row_group_bytes: int = 16 << 20, page_rows: int = 1 << 12) -> None:
    """Write ``df`` in order of ``at``, a running place: files are ranges of places, so are their row groups and pages."""
    ordered = df.repartitionByRange(at).sortWithinPartitions(at)
    ordered.write.mode("overwrite").option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", page_rows).parquet(path)


def read_range(spark: SparkSession, path: str, first: int, stop: int, at: str = "at") -> DataFrame:
    """The rows at places first to stop (exclusive). The bounds go down to the scan, which skips row groups and pages that lie elsewhere."""
    return spark.read.parquet(path).where((F.col(at) >= first) & (F.col(at) < stop))


def read_ranges(spark: SparkSession, path: str, wanted: DataFrame, size: int, at: str = "at") -> DataFrame:
    """wanted (first, frames, ...) with each of their rows: places first to first + frames (exclusive), by an equi-join on runs of ``size`` places.

    A wanted range is cut where runs begin, so a long one is many rows, and no row meets a range that ends before its run.
    """
    run = F.explode(F.sequence(F.floor(F.col("first") / size), F.floor((F.col("first") + F.col("frames") - 1) / size)))
    parts = wanted.where("frames > 0").withColumn("_run", run)
    rows = spark.read.parquet(path).withColumn("_of", F.floor(F.col(at) / size))
    joined = parts.join(rows, F.col("_run") == F.col("_of"))
    return joined.where((F.col(at) >= F.col("first")) & (F.col(at) < F.col("first") + F.col("frames"))).drop("_run", "_of")
