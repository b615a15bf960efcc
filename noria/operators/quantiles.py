"""Exact quantiles, as interpolated between two order statistics, of groups of any size.

Spark's ``percentile`` holds a group's distinct values in one task. Here that is left to groups of at most ``limit`` rows. In a larger one each wanted
rank is searched by narrowing an open range of values: the range's rows are summed up by a mergeable sketch of bounded size, the two of its values
on both sides of the rank become the next range, and exact counts say whether the rank is one of them or between them. Each round leaves about a
hundredth of the rows, ties at the range's ends aside, which need no further search; what is at most ``limit`` rows is sorted. The sketch decides only where to
look, so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noria.storage import stored

#: Rows of a group, or of a range, that one task may sort.
LIMIT = 1 << 16
#: Values that the sketch of a range gives, and its accuracy: ranks are off by a ten-thousandth of the rows at most.
GRID, ACCURACY = 256, 10_000


def _within(x: Column, low: Column, high: Column) -> Column:
    return (low.isNull() | (x > low)) & (high.isNull() | (x < high))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= a[k].eqNullSafe(b[f"_of_{k}"])
    return out


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_of_{k}" for k in keys})


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, fractions: list[float], limit: int = LIMIT) -> DataFrame:
    """keys and q, an array with the quantile of each fraction (in [0, 1]); nulls don't count, a group without values has no row. Without keys there is one group.

    NaN is larger than all numbers.
    """
    if not fractions or not all(0 <= f <= 1 for f in fractions):
        raise ValueError("fractions lie between 0 and 1")
    rows = rows.select(*keys, F.col(value).cast("double").alias("_x")).where("_x IS NOT NULL")
    if not keys:
        keys, rows = ["_all"], rows.withColumn("_all", F.lit(0))
        return exact_quantiles(rows, keys, "_x", fractions, limit).select("q")
    rows = stored(rows, "values")
    sizes = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    listed = F.array(*[F.lit(float(f)) for f in fractions])
    large = sizes.where(F.col("_n") > limit)
    if large.isEmpty():
        return rows.groupBy(*keys).agg(F.percentile("_x", listed).alias("q"))
    small = _semi(rows, sizes.where(F.col("_n") <= limit), keys)
    place = F.explode(F.transform(listed, lambda f: F.struct(f.alias("f"), (f * (F.col("_n") - 1)).alias("h"))))
    wanted = large.select(*keys, place.alias("w")).select(*keys, "w.f", "w.h", F.floor("w.h").alias("_k"))
    ranks = wanted.select(*keys, F.explode(F.array("_k", F.ceil("h"))).alias("_rank")).distinct()
    found = _order_statistics(_semi(rows, large, keys), _joined(ranks, large, keys), keys, limit)
    low = _joined(wanted, found.withColumnRenamed("_rank", "_low").withColumnRenamed("_value", "_below"), keys).where("_low = floor(h)")
    both = _joined(low, found.withColumnRenamed("_rank", "_high").withColumnRenamed("_value", "_above"), keys).where("_high = ceil(h)")
    part = F.col("h") - F.floor("h")
    each = both.withColumn("_q", F.when(part == 0, F.col("_below")).otherwise((1 - part) * F.col("_below") + part * F.col("_above")))
    mapped = each.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("f", "_q"))).alias("_m"))  # a fraction each
    big = mapped.select(*keys, F.transform(listed, lambda f: F.element_at("_m", f)).alias("q"))
    return big.unionByName(small.groupBy(*keys).agg(F.percentile("_x", listed).alias("q")))


def _semi(rows: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
    other = _renamed(of.select(*keys), keys)
    return rows.join(other, _same(rows, other, keys), "left_semi")


def _joined(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join by keys, null or not; the left's keys stay. Columns of the right must have names of their own."""
    other = _renamed(other, keys)
    return rows.join(other, _same(rows, other, keys)).drop(*[f"_of_{k}" for k in keys])


def _order_statistics(rows: DataFrame, ranks: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """keys, _rank and _value: the value of each rank (from 0) of its group. ranks: keys, _rank and _n, the group's rows."""
    nothing = F.lit(None).cast("double")
    todo = ranks.select(*keys, "_rank", nothing.alias("_low"), nothing.alias("_high"), F.lit(0).cast("long").alias("_before"), F.col("_n").alias("_inside"))
    done = None
    grid = [k / GRID for k in range(GRID + 1)]
    while True:
        todo = stored(todo, "ranks")
        wide = todo.where(F.col("_inside") > limit)
        if wide.isEmpty():
            break
        near = todo.where(F.col("_inside") <= limit)
        ranges = wide.select(*keys, "_low", "_high").distinct()
        seen = _joined(rows, ranges, keys).where(_within(F.col("_x"), F.col("_low"), F.col("_high")))
        sketch = stored(seen.groupBy(*keys, "_low", "_high").agg(F.percentile_approx("_x", grid, ACCURACY).alias("_grid")), "sketch").withColumnsRenamed({"_low": "_l", "_high": "_h"})
        at = (F.col("_rank") - F.col("_before")) * F.lit(float(GRID)) / F.col("_inside")
        split = _joined(wide, sketch, keys).where(F.col("_l").eqNullSafe(F.col("_low")) & F.col("_h").eqNullSafe(F.col("_high")))
        # values on both sides of the rank; the sketch's own ends are the range's first and last value
        left = F.when(F.floor(at) >= 2, F.element_at("_grid", F.floor(at).cast("int"))).otherwise(F.element_at("_grid", 1))
        right = F.when(F.ceil(at) < GRID, F.element_at("_grid", F.ceil(at).cast("int") + 2)).otherwise(F.element_at("_grid", -1))
        split = stored(split.select(*keys, "_rank", "_low", "_high", "_before", left.alias("_left"), right.alias("_right")), "split")
        # exact counts over the old range
        x = F.col("_x")
        counted = _joined(rows, split.select(*keys, "_low", "_high", "_left", "_right").distinct(), keys).where(_within(x, F.col("_low"), F.col("_high")))
        counted = counted.groupBy(*keys, F.col("_left").alias("_a"), F.col("_right").alias("_b"), F.col("_low").alias("_l"), F.col("_high").alias("_h")).agg(
            F.count_if(x < F.col("_left")).alias("_under"),
            F.count_if(x == F.col("_left")).alias("_at_left"),
            F.count_if((x > F.col("_left")) & (x < F.col("_right"))).alias("_between"),
            F.count_if((x == F.col("_right")) & (x > F.col("_left"))).alias("_at_right"),
            F.count_if(x > F.greatest("_left", "_right")).alias("_over"),
        )
        known = _joined(split, counted, keys).where("_a <=> _left AND _b <=> _right AND _l <=> _low AND _h <=> _high")
        first = F.col("_before") + F.col("_under")
        rank, left_stop = F.col("_rank"), first + F.col("_at_left")
        inner_stop = left_stop + F.col("_between")
        state = (
            F.when(rank < first, F.struct(F.col("_low").alias("_low"), F.col("_left").alias("_high"), F.col("_before").alias("_before"), F.col("_under").alias("_inside"), nothing.alias("_value")))
            .when(rank < left_stop, F.struct(nothing.alias("_low"), nothing.alias("_high"), first.alias("_before"), F.lit(0).cast("long").alias("_inside"), F.col("_left").alias("_value")))
            .when(rank < inner_stop, F.struct(F.col("_left").alias("_low"), F.col("_right").alias("_high"), left_stop.alias("_before"), F.col("_between").alias("_inside"), nothing.alias("_value")))
            .when(rank < inner_stop + F.col("_at_right"), F.struct(nothing.alias("_low"), nothing.alias("_high"), inner_stop.alias("_before"), F.lit(0).cast("long").alias("_inside"), F.col("_right").alias("_value")))
            .otherwise(F.struct(F.col("_right").alias("_low"), F.col("_high").alias("_high"), (inner_stop + F.col("_at_right")).alias("_before"), F.col("_over").alias("_inside"), nothing.alias("_value")))
        )
        known = stored(known.select(*keys, "_rank", state.alias("s")).select(*keys, "_rank", "s.*"), "known")
        settled = known.where("_value IS NOT NULL").select(*keys, "_rank", "_value")
        done = settled if done is None else done.unionByName(settled)
        todo = near.unionByName(known.where("_value IS NULL").drop("_value"))
    ranges = todo.select(*keys, "_low", "_high").distinct()
    held = _joined(rows, ranges, keys).where(_within(F.col("_x"), F.col("_low"), F.col("_high")))
    held = held.groupBy(*keys, F.col("_low").alias("_l"), F.col("_high").alias("_h")).agg(F.array_sort(F.collect_list("_x")).alias("_sorted"))  # limit values at most
    last = _joined(todo, held, keys).where("_l <=> _low AND _h <=> _high")
    last = last.select(*keys, "_rank", F.element_at("_sorted", (F.col("_rank") - F.col("_before") + 1).cast("int")).alias("_value"))
    return last if done is None else last.unionByName(done)
