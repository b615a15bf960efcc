"""One place for session settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Inputs of fewer bytes than this may be a row group or two, whatever their number of rows.
SMALL_INPUT = 64 << 20


def session(name: str = "noria", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with ANSI types and adaptive plans. On a cluster leave master and partitions to its settings."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over all cores where its input, by the planner's figures, is too small for the scan to do so; a larger one as it is, without a shuffle.

    For work that costs much more than moving its rows does, as text functions.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_INPUT else df
