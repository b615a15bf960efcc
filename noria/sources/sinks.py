"""Small artefacts and their folders: JSON documents, tokenizer tables, WAV files, metrics, snapshots.

Files go through Spark's file systems. A file appears whole: it is written beside its place and renamed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noria.functions import alphabet as A
from noria.operators import metrics

from .config import dump


def _file_system(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file with this text. It takes the place of an older one in one step, so that a reader finds the old or the new."""
    there, fs = _file_system(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    overwrite = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    how = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = overwrite
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(there).toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(there), how)


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """An indented JSON document."""
    write_text(spark, path, dump(value) + "\n")


def write_tokenizer(spark: SparkSession, path: str) -> int:
    """The vocabulary as a JSON document of token to id; its size."""
    vocabulary = A.vocabulary()
    write_json(spark, path, {"model": "characters", "vocab": {t: i for i, t in enumerate(vocabulary)}})
    return len(vocabulary)


def read_tokenizer(spark: SparkSession, path: str) -> DataFrame:
    """id and token of a tokenizer file."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "model string, vocab map<string, int>").alias("d"))
    return doc.select(F.explode("d.vocab").alias("token", "id")).select("id", "token")


def append_metrics(rows: DataFrame, path: str) -> None:
    """Append (run, tag, step, value) to a metrics table; values that are missing or not finite are left out."""
    metrics.finite(rows.select("run", "tag", F.col("step").cast("long").alias("step"), F.col("value").cast("double").alias("value"))).write.mode("append").partitionBy("run").parquet(path)


def write_wav(rows: DataFrame, folder: str) -> int:
    """Write name, rate and samples of each row as ``folder``/name.wav, from the executors; how many files there are.

    ``folder`` is on a file system that executors mount; a task that runs again replaces its own files.
    """
    from .wav import encode

    def run(batches):
        import os

        import numpy as np
        import pyarrow as pa

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, rate, samples in zip(*(batch.column(c) for c in ("name", "rate", "samples")), strict=True):
                target = os.path.join(folder, name.as_py() + ".wav")
                with open(f"{target}.{os.getpid()}.tmp", "wb") as f:
                    f.write(encode(np.asarray(samples.values, float), rate.as_py()))
                os.replace(f.name, target)
            yield pa.RecordBatch.from_arrays([batch.column("name")], names=["name"])

    return rows.select("name", "rate", "samples").mapInArrow(run, "name string").count()


def make_folders(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        there, fs = _file_system(spark, path)
        fs.mkdirs(there)


def data_root(spark: SparkSession, *candidates: str) -> str:
    """The first of the folders that exists."""
    for path in candidates:
        there, fs = _file_system(spark, path)
        if fs.exists(there):
            return path
    raise FileNotFoundError(f"none of {candidates} exists")


def export(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], about: Mapping[str, Any]) -> dict[str, Any]:
    """A snapshot: each table as Parquet and, last, info.json with row counts, so a folder with it is complete."""
    info = {**about, "tables": {}}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
        info["tables"][name] = {"rows": spark.read.parquet(f"{folder}/{name}").count(), "columns": table.columns}
    write_json(spark, f"{folder}/info.json", info)
    return info


class Registry(dict):
    """Names to functions, with the keyword arguments that each gets when it is made."""

    def register(self, name: str, **fixed: Any) -> Callable:
        def put(f: Callable) -> Callable:
            self[name] = (f, fixed)
            return f

        return put

    def make(self, name: str, **more: Any):
        if name not in self:
            raise KeyError(f"{name!r} is none of {sorted(self)}")
        f, fixed = self[name]
        return f(**{**fixed, **more})


def run_steps(steps: list[tuple[str, Callable[[], bool], Callable[[], Any]]]) -> list[str]:
    """Run each (name, done, function) that isn't done yet, in order; the names of those that ran."""
    ran = []
    for name, done, step in steps:
        if not done():
            step()
            ran.append(name)
    return ran
