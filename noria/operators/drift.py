"""Statistics of drift: generated vectors drawn to a data vector and pushed off each other by a kernel.

Rows are (group, slot, v): slot 0 is the group's data vector, the others are its generated ones. Every statistic is per
pair of a generated vector and a vector of its group, found by an equi-join on the group; the group is the only shuffle
key, the windows that follow are finer and stay in place. A group has as many rows as the model draws (64 or so), never more.
Groups without a data vector, or without a generated one, have no rows in the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noria.functions import vectors as ve

#: Least squared distance, kernel weight and mean squared force, below which they count as this much.
EPS_DISTANCE, EPS_KERNEL, EPS_FORCE = 1e-8, 1e-6, 1e-8
#: Added to the scaled distance of a vector from itself, so that it has no part in its own kernel.
SELF = 100.0


def distances(rows: DataFrame, others: DataFrame, eps: float = EPS_DISTANCE) -> DataFrame:
    """group, i, j, x, y and d for each row (slot i, vector x) and each of the others of its group (slot j, vector y)."""
    a = rows.select("group", F.col("slot").alias("i"), F.col("v").alias("x"))
    b = others.select(F.col("group").alias("_group"), F.col("slot").alias("j"), F.col("v").alias("y"))
    d = F.sqrt(F.greatest(ve.squared_distance(F.col("x"), F.col("y")), F.lit(eps)))
    return a.join(b, F.col("group") == F.col("_group")).drop("_group").withColumn("d", d)


def kernel(rows: DataFrame, temp: float = 10.0, min_scale: float = 1e-3, min_temp: float = 1e-3) -> DataFrame:
    """A row per pair (i generated, j any): group, i, j, x, y, scale, mass (log share of j in the kernel of i against an even one) and weight.

    scale: the group's mean distance times n / (n - 1), for its n vectors; distances count in units of it. weight: the root of the
    product of two softmaxes, over the partners of i and over the generated vectors of j.
    """
    of_group, of_i, of_j = Window.partitionBy("group"), Window.partitionBy("group", "i"), Window.partitionBy("group", "j")
    pairs = distances(rows.where("slot > 0"), rows).withColumn("_n", F.count(F.lit(1)).over(of_i)).withColumn("_data", F.min("j").over(of_group))
    pairs = pairs.where("_n > 1 AND _data = 0")
    scale = F.greatest(F.avg("d").over(of_group) * F.col("_n") / (F.col("_n") - 1), F.lit(min_scale))
    pairs = pairs.withColumn("scale", scale)
    own = F.when(F.col("i") == F.col("j"), SELF).otherwise(0.0)
    pairs = pairs.withColumn("_logit", -(F.col("d") / F.col("scale") + own) / max(temp, min_temp))

    def log_share(over) -> Column:
        top = F.max("_logit").over(over)
        return F.col("_logit") - F.col("_top") - F.log(F.sum(F.exp(F.col("_logit") - F.col("_top"))).over(over)), top

    by_i, top = log_share(of_i)
    pairs = pairs.withColumn("_top", top).withColumn("_row", by_i)
    by_j, top = log_share(of_j)
    pairs = pairs.withColumn("_top", top).withColumn("_column", by_j)
    weight = F.sqrt(F.greatest(F.exp(F.col("_row")) * F.exp(F.col("_column")), F.lit(EPS_KERNEL)))
    return pairs.select("group", "i", "j", "x", "y", "scale", (F.col("_row") + F.log(F.col("_n") - 1)).alias("mass"), weight.alias("weight"))


def _times(v: Column, by: Column) -> Column:
    return F.transform(v, lambda e: e * by)


def _summed(weighted: Column) -> Column:
    """Sum of w v over an array of structs (w, v); null for none."""
    first = _times(F.element_at(weighted, 1)["v"], F.element_at(weighted, 1)["w"])
    rest = F.slice(weighted, F.lit(2), F.greatest(F.size(weighted) - 1, F.lit(0)))
    return F.when(F.size(weighted) > 0, F.aggregate(rest, first, lambda s, r: F.zip_with(s, r["v"], lambda a, b: a + b * r["w"])))


def forces(pairs: DataFrame, normalise: str | None = "batch") -> DataFrame:
    """Of each generated vector, from ``kernel``: group, slot, log_mass (of the data vector), force (array), scale, x (in units of the scale) and rms.

    Attraction: the data vector's weight times the sum of those of the generated ones; repulsion from each of them: its weight times the
    data vector's. normalise: by the root mean square of the group's force (group), by the mean of these over all groups (batch), or None.
    """
    data = F.col("j") == 0
    unit = F.sqrt(F.size("x").cast("double")) / F.col("scale")
    each = pairs.groupBy("group", "i").agg(
        F.max(F.when(data, F.col("mass"))).alias("log_mass"),
        F.max(F.when(data, F.col("weight"))).alias("_pull"),
        F.sum(F.when(~data, F.col("weight"))).alias("_push"),
        F.max_by("y", data).alias("_data"),
        F.first("x").alias("x"),
        F.first(unit).alias("_unit"),
        F.first("scale").alias("scale"),
        F.array_sort(F.collect_list(F.when(~data, F.struct("j", F.col("weight").alias("w"), F.col("y").alias("v"))))).alias("_others"),
    )
    # attraction to the data minus repulsion from the others, both from where the vector is: the weights of both sum to the same
    attraction, repulsion = F.col("_pull") * F.col("_push"), _summed(F.col("_others"))
    drawn = F.zip_with(_times(F.col("_data"), attraction), _times(repulsion, F.col("_pull")), lambda a, b: a - b)
    balance = attraction - F.col("_pull") * F.aggregate("_others", F.lit(0.0), lambda s, r: s + r["w"])
    force = F.zip_with(drawn, F.col("x"), lambda f, x: f - balance * x)
    rows = each.withColumn("force", _times(force, F.col("_unit"))).withColumn("x", _times(F.col("x"), F.col("_unit")))
    mean_square = ve.total(F.transform("force", lambda f: f * f)) / F.size("force")
    rows = rows.withColumn("rms", F.sqrt(F.greatest(F.avg(mean_square).over(Window.partitionBy("group")), F.lit(EPS_FORCE))))
    if normalise == "group":
        rows = rows.withColumn("force", _times(F.col("force"), 1 / F.col("rms")))
    elif normalise == "batch":
        mean = rows.groupBy("group").agg(F.first("rms").alias("rms")).agg(F.avg("rms").alias("_mean"))  # one row
        rows = rows.join(F.broadcast(mean)).withColumn("force", _times(F.col("force"), 1 / F.col("_mean")))
    elif normalise is not None:
        raise ValueError(f"normalise: {normalise}")
    return rows.select("group", F.col("i").alias("slot"), "log_mass", "force", "scale", "x", "rms")


def drift(rows: DataFrame, temp: float = 10.0, normalise: str | None = "batch", min_scale: float = 1e-3) -> DataFrame:
    """``forces`` of rows (group, slot, v)."""
    return forces(kernel(rows, temp, min_scale), normalise)


def drift_metrics(found: DataFrame) -> DataFrame:
    """One row from ``drift``: loss (mean squared force of each group, averaged), temp_loss (minus the mean over groups of the largest log mass) and std_mean (norm of the sample deviation of the generated vectors, averaged)."""
    per = found.groupBy("group").agg(F.avg(ve.total(F.transform("force", lambda f: f * f)) / F.size("force")).alias("loss"), F.max("log_mass").alias("most"))
    spread = found.select("group", F.posexplode("x").alias("dim", "e")).groupBy("group", "dim").agg(F.var_samp("e").alias("var")).groupBy("group").agg(F.sqrt(F.sum("var")).alias("std"))
    return per.join(spread, "group").agg(F.avg("loss").alias("loss"), (-F.avg("most")).alias("temp_loss"), F.avg("std").alias("std_mean"))


def chance_mass(n: int) -> float:
    """The log mass of an even kernel over n generated vectors and the data vector: what ``mass`` is when nothing tells them apart."""
    return math.log(n) - math.log(n + 1)
