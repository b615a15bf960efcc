"""Running numbers and sums over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noria.storage import stored

#: Bits of a row's place within its partition, as ``monotonically_increasing_id`` has them.
_PLACE_BITS = 33


def running_number(df: DataFrame, order: list[str | Column], name: str, weight: Column | None = None) -> DataFrame:
    """Number of rows (or sum of weight) before each row in the given total order.

    A global window would sort everything in one task. Here rows are range-partitioned by the order and
    sorted within partitions; each row's partition and place there are written with it, once, so that all that
    follows reads the same partitions. Then only one row per partition meets in the sum of offsets. Rows that tie are
    numbered in any order, each differently. Null weights count as 0; an empty table stays empty.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    rows = df if weight is None else df.withColumn("_w", F.coalesce(weight, F.lit(0)))
    rows = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("_part", F.shiftright("_at", _PLACE_BITS))
    size = F.count(F.lit(1)) if weight is None else F.sum("_w")
    totals = rows.groupBy("_part").agg(size.alias("_size"))
    offsets = totals.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_base"))
    if weight is None:
        within = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    else:
        before = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_before", F.coalesce(F.sum("_w").over(before), F.lit(0)))
        within = F.col("_before")
    out = rows.join(offsets, "_part").withColumn(name, F.col("_base") + within)
    return out.drop("_w", "_at", "_part", "_before", "_base")


def number_within(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Number of rows of the same keys before each row in the given order, however many rows a key has.

    A window by key would sort a hot key's rows in one task. Here rows are range-partitioned by keys and order together and written once with
    their places, so that a hot key fills many partitions; then one row for each key and partition says how many rows the key has in partitions before.
    Rows that tie are numbered in any order, each differently; null keys are one key.
    """
    rows = stored(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("_part", F.shiftright("_at", _PLACE_BITS))
    parts = rows.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_of")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*[f"_key_{k}" for k in keys]).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    same = rows["_part"] == parts["_of"]
    for k in keys:
        same &= rows[k].eqNullSafe(parts[f"_key_{k}"])
    found = rows.join(parts, same).withColumn(name, F.col("_base") + F.col("_at") - F.col("_first"))
    return found.select(*df.columns, name)


def last_by(df: DataFrame, keys: list[str], value: str, order: str | None = None) -> DataFrame:
    """keys and value of the last row of each key: by the column ``order``, else as rows come in the table. Of equal places the larger value counts."""
    place = F.col(order) if order else F.monotonically_increasing_id()
    return df.select(*keys, value, place.alias("_place")).groupBy(*keys).agg(F.max_by(value, F.struct("_place", value)).alias(value))
