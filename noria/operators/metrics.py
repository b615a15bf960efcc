"""Series of metrics and losses as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noria.functions import vectors as ve
from noria.operators import blocks
from noria.operators.ordering import number_within


def finite(df: DataFrame, value: str = "value") -> DataFrame:
    """Only numbers that are there, not NaN and not infinite."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))


def series(df: DataFrame) -> DataFrame:
    """tag, steps and values in order of step, from (tag, step, value)."""
    return df.groupBy("tag").agg(F.sort_array(F.collect_list(F.struct("step", "value"))).alias("s")).select("tag", "s.step", "s.value")


def smoothed(df: DataFrame, keys: list[str], order: str, value: str, k: int) -> DataFrame:
    """Means of k values in a row, full windows only."""
    numbered = number_within(df, keys, [order], "_n")
    return blocks.moving_mean(numbered, keys, value, k, "smooth", "_n").drop("_n")


def ema(values: Column, decay: float) -> Column:
    """The last state of s = d s + (1 - d) x over an ordered array, from its first value."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1), lambda s, x: decay * s + (1 - decay) * x)


def ema_steps(df: DataFrame, keys: list[str], order: list[str], value: str, decay: float, size: int = blocks.SIZE) -> DataFrame:
    """Rows with i, their number within the keys, and ema, the state s = d s + (1 - d) x after each, from the first value; of series of any length."""
    rows = number_within(df, keys, order, "i")
    first = F.col("i") == 0
    rows = rows.withColumn("_by", F.when(first, 0.0).otherwise(decay)).withColumn("_plus", F.when(first, F.col(value)).otherwise((1 - decay) * F.col(value)))
    return blocks.affine_scan(rows, keys, "_by", "_plus", F.lit(0.0), "ema", size=size).drop("_by", "_plus")


def masked_mse(df: DataFrame, keys: list[str], order: str, error: str, mask: str) -> DataFrame:
    """Mean squared error under the mask shifted right by one (its first value stays); the denominator is one at least."""
    w = Window.partitionBy(*keys).orderBy(order)
    m = F.coalesce(F.lag(mask).over(w), F.col(mask)).cast("double")
    return df.withColumn("_m", m).groupBy(*keys).agg((F.sum(F.col("_m") * F.col(error) * F.col(error)) / F.greatest(F.lit(1.0), F.sum("_m"))).alias("loss"))


def eos_loss(df: DataFrame, keys: list[str], order: str, logit: str, mask: str) -> DataFrame:
    """Binary loss of the end: the first invalid place should fire, valid ones should not; shifted-mask mean."""
    w = Window.partitionBy(*keys).orderBy(order)
    m = F.coalesce(F.lag(mask).over(w), F.col(mask)).cast("double")
    x = F.col(logit)
    loss = F.when(F.col(mask), ve.softplus(x)).otherwise(ve.softplus(-x))
    return df.withColumn("_m", m).withColumn("_l", loss).groupBy(*keys).agg((F.sum(F.col("_m") * F.col("_l")) / F.greatest(F.lit(1.0), F.sum("_m"))).alias("loss"))


def mean_of_means(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Every batch counts alike in its rank, every rank alike in the end."""
    batches = df.groupBy(outer, inner).agg(F.avg(value).alias("m"))
    return batches.groupBy(outer).agg(F.avg("m").alias("m")).agg(F.avg("m").alias("metric"))


def learning_rate(step: Column, steps: int, peak: float, warmup: int, floor: float, cosine: bool) -> Column:
    """The rate at a step: linear warm-up, then constant or a cosine down to the floor."""
    late = (step - warmup) / max(1, steps - warmup)
    down = F.lit(floor) + (F.lit(peak) - floor) * 0.5 * (1 + F.cos(F.least(late, F.lit(1.0)) * 3.141592653589793))
    return F.when(step < warmup, peak * (step + 1) / warmup).otherwise(down if cosine else F.lit(peak))


def learning_rates(spark, steps: int, peak: float, warmup: int, floor: float, cosine: bool) -> DataFrame:
    """step and lr of all steps."""
    return spark.range(steps).select(F.col("id").alias("step"), learning_rate(F.col("id"), steps, peak, warmup, floor, cosine).alias("lr"))


def due(step: Column, every: int, start: Column | None = None, verbose: int = 0) -> Column:
    """Whether a step is one of every so many, or one of the first ``verbose`` after the start."""
    begun = F.lit(0) if start is None else start
    return (step % every == 0) | ((F.lit(verbose) > 0) & (step - begun <= verbose))


def sample_statistics(rows: DataFrame, length: str, margin: float = 0.1) -> DataFrame:
    """One row: the mean length, and the share of rows within ``margin`` of the longest."""
    longest = rows.agg(F.max(length).alias("_most"))  # one row
    value = F.col(length)
    return rows.join(F.broadcast(longest)).agg(F.avg(value).alias("mean"), F.avg((value >= F.col("_most") - margin).cast("double")).alias("at_limit"))


def real_time(df: DataFrame, keys: list[str], audio: str, wall: str, ready: str, began: str) -> DataFrame:
    """Per group: seconds of audio over seconds taken, and the latency of the first chunk."""
    factor = F.sum(audio) / F.greatest(F.sum(wall), F.lit(1e-9))
    return df.groupBy(*keys).agg(factor.alias("factor"), (F.min(ready) - F.min(began)).alias("latency"))


def rates(df: DataFrame, keys: list[str], seconds: str, steps: str, audio: str) -> DataFrame:
    """Steps and seconds of audio a second between log points; nothing for a group's first point. steps: a running count; audio: since the last point."""
    w = Window.partitionBy(*keys).orderBy(steps)
    took = F.greatest(F.col(seconds) - F.lag(seconds).over(w), F.when(F.lag(seconds).over(w).isNotNull(), F.lit(1e-6)))
    return df.withColumn("_took", F.when(F.lag(seconds).over(w).isNotNull(), took)).withColumn("steps_per_second", (F.col(steps) - F.lag(steps).over(w)) / F.col("_took")).withColumn("audio_per_second", F.col(audio) / F.col("_took")).drop("_took")


def rebuffer(chunks: Column, first: float, later: float) -> Column:
    """Sizes emitted when chunk sizes come in: at ``first`` for the first time, then at ``later``; the rest at the end."""
    state = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("held"))

    def step(s: Column, x: Column) -> Column:
        held = s["held"] + x
        full = held >= F.when(F.size(s["out"]) == 0, first).otherwise(later)
        return F.struct(F.when(full, F.concat(s["out"], F.array(held))).otherwise(s["out"]).alias("out"), F.when(full, 0.0).otherwise(held).alias("held"))

    return F.aggregate(chunks, state, step, lambda s: F.when(s["held"] > 0, F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"]))
