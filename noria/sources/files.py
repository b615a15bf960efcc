"""Reading and writing rows: JSON lines, JSON documents, logs, listings and whole tables.

All paths go through Spark's file systems; nothing is opened on the driver's disk.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, lines that don't parse give null fields."""
    return spark.read.schema(schema).json(path)


def iter_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> Iterator[Row]:
    """The rows one partition at a time, for small tables that the driver must walk."""
    return read_jsonl(spark, path, schema).toLocalIterator(prefetchPartitions=True)


def write_rows(df: DataFrame, path: str, form: str = "json", partition_by: list[str] | None = None) -> int:
    """Write and return the number of rows, counted while they are written. Readers see all files or none."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy(*(partition_by or [])).format(form).save(path)
    return seen.get["n"]


def write_once(df: DataFrame, path: str, form: str = "parquet") -> bool:
    """Write unless the output is complete already; whether it was written."""
    spark = df.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return False
    df.write.mode("overwrite").format(form).save(path)
    return True


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole-file JSON documents."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime and name (the path relative to the folder) of the files below a folder; their contents are not read."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime", F.substring("path", len(root) + 1, 1 << 20).alias("name"))


def newest(spark: SparkSession, path: str, pattern: str) -> str | None:
    """The last file by name, None if there is none."""
    row = listing(spark, path, pattern).agg(F.max_by("path", F.regexp_extract("path", "([^/]*)$", 1)).alias("p")).first()
    return row["p"]


def with_existing(rows: DataFrame, files: DataFrame, path: str = "audio_path") -> DataFrame:
    """The rows whose file is in the listing, by its path relative to the listing's folder; a semi join, not a look at each file."""
    names = files.select(F.col("name").alias("_name")).distinct()
    return rows.join(names, F.regexp_replace(path, r"^(\./)+", "") == F.col("_name"), "left_semi")


#: Bytes at the end of a log that are looked at.
TAIL_BYTES = 200_000


def tail(spark: SparkSession, path: str, n: int) -> list[str]:
    """The last n lines of the last TAIL_BYTES of a log; bytes that aren't UTF-8 become U+FFFD. The rest of the file isn't read."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.open(there)
    try:
        stream.seek(max(0, fs.getFileStatus(there).getLen() - TAIL_BYTES))
        held = spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
    finally:
        stream.close()
    lines = bytes(held).decode("utf-8", "replace").splitlines()
    return lines[-n:] if n > 0 else []


class Layout:
    """Where the tables of a corpus lie below one root."""

    SPLITS = {"train": "train", "dev": "valid", "valid": "valid", "test": "test"}

    def __init__(self, root: str):
        self.root = PurePosixPath(root)

    def raw(self, split: str) -> str:
        return f"{self.root}/raw/metadata/{split}.jsonl"

    def work(self, name: str, split: str | None = None) -> str:
        return f"{self.root}/work/{name}" + (f"/split={self.SPLITS[split]}" if split else "")
