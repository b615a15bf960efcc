"""Tables of named parameters: matching, overlays, prefixes and layers. A row is (key, shape, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noria.operators.ordering import last_by


def matched(base: DataFrame, other: DataFrame, on: list[str], value: str = "value", protected: list[str] | None = None, key: str | None = None, order: str | None = None) -> DataFrame:
    """``base`` with ``value`` from ``other`` where all of ``on`` agree, but for keys with a protected prefix. Of several rows of ``other`` the last counts, as ``last_by`` has it."""
    there = last_by(other, on, value, order).withColumnRenamed(value, "_other")
    held = F.lit(False)
    for prefix in protected or []:
        held |= F.col(key or on[0]).startswith(prefix)
    return base.join(there, on, "left").withColumn(value, F.when(held, F.col(value)).otherwise(F.coalesce("_other", value))).drop("_other")


def overlay(base: DataFrame, newer: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Rows of ``newer`` replace those of ``base`` with the same key."""
    return matched(base, newer, [key], value)


def with_prefix(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """The rows whose key has the prefix, which is taken off."""
    return df.where(F.col(key).startswith(prefix)).withColumn(key, F.substr(F.col(key), F.lit(len(prefix) + 1)))


def selected_layers(of: Column, n: Column) -> Column:
    """Of ``of`` layers the bottom half (rounded up) and the top half of n, as an array."""
    bottom = F.sequence(F.lit(0).cast("long"), F.ceil(n / 2) - 1)
    top = F.when(n >= 2, F.sequence(of - F.floor(n / 2), (of - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(bottom, top)


def renamed_layers(keys: DataFrame, key: str, layers: list[int], pattern: str = r"^layers\.(\d+)\.(.*)$") -> DataFrame:
    """Keys of the chosen layers as ``new``, numbered by their place in ``layers``; keys of other layers go."""
    place = F.array_position(F.array(*[F.lit(n) for n in layers]), F.regexp_extract(key, pattern, 1).cast("int"))
    rows = keys.where(F.col(key).rlike(pattern)).withColumn("_place", place).where("_place > 0")
    return rows.withColumn("new", F.concat(F.lit("layers."), (F.col("_place") - 1).cast("string"), F.lit("."), F.regexp_extract(key, pattern, 2))).drop("_place")


def newest(df: DataFrame, per: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group by ``order``: retention of the newest checkpoints."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def retained(df: DataFrame, per: list[str], kind: str, order: list[Column], keep: dict[str, int]) -> DataFrame:
    """Of each group the newest files of each kind that ``keep`` names, as many as it says (three checkpoints, one optimizer); other kinds stay."""
    place = F.row_number().over(Window.partitionBy(*per, kind).orderBy(*order))
    most = F.create_map(*[x for k, n in keep.items() for x in (F.lit(k), F.lit(n))])
    return df.withColumn("_n", place).where(F.col("_n") <= F.coalesce(F.try_element_at(most, F.col(kind)), F.col("_n"))).drop("_n")


def sanity(values: DataFrame, value: str, digest: Column, expected_digest: Column, window: Column, expected_window: Column) -> DataFrame:
    """One row (n, largest) of the numbers in an array column, or an error: no number may be infinite or NaN, not all may be zero, and the table's
    digest and window (aggregates, or literals) must be what is expected."""
    x = F.col(value)
    bad = F.sum(F.size(F.filter(x, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))))
    one = values.agg(
        F.sum(F.size(x)).alias("n"), F.max(F.array_max(F.transform(x, lambda v: F.abs(v)))).alias("largest"), bad.alias("_bad"),
        digest.alias("_digest"), expected_digest.alias("_wanted"), window.alias("_window"), expected_window.alias("_asked"),
    )
    held = checked(one, finite=F.col("_bad") == 0, some_not_zero=F.col("largest") > 0, same_digest=F.col("_digest") == F.col("_wanted"), same_window=F.col("_window") == F.col("_asked"))
    return held.select("n", "largest")


def unexpected(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``found`` that ``known`` lacks."""
    return found.select(key).distinct().join(known.select(key), key, "left_anti")


def checked(df: DataFrame, **tests: Column) -> DataFrame:
    """A table of one row, or an error that names the first test that doesn't hold."""
    for name, test in tests.items():
        df = df.where(F.coalesce(test, F.lit(False)) | F.raise_error(F.lit(f"check failed: {name}")).cast("boolean"))
    return df


def scalars(df: DataFrame, value: str) -> DataFrame:
    """Only rows whose array has one element, as that element."""
    return df.where(F.size(value) == 1).withColumn(value, F.element_at(value, 1))


def limited(df: DataFrame, n: int) -> DataFrame:
    """The first n rows, all for 0."""
    return df.limit(n) if n else df


def first_batches(df: DataFrame, batch: str, n: int) -> DataFrame:
    """The rows of the first n batches, numbered from 0; all for 0."""
    return df.where((F.col(batch) >= 0) & (F.col(batch) < n)) if n else df


def save_step(df: DataFrame, path: str, step: int) -> None:
    """Write a checkpoint's rows under its step; a step written again replaces its own rows only."""
    df.write.mode("overwrite").parquet(f"{path}/step={step}")


def load_step(spark: SparkSession, path: str, step: int | None = None) -> DataFrame:
    """The rows of a step, of the latest if none is given; only that step's files are read."""
    rows = spark.read.parquet(path)
    if step is None:
        step = rows.agg(F.max("step").alias("s")).first()["s"]
    return rows.where(F.col("step") == step).drop("step")
