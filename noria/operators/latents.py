"""Frames of latent vectors: their store, stitch windows, prompts, normalisation and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noria.functions import vectors as ve
from noria.functions.arabic import let


def write_store(frames: DataFrame, path: str) -> None:
    """(utt_id, frame, latent) sorted within files by utt_id, so that a read of some ids skips row groups."""
    frames.select("utt_id", "frame", "latent").repartitionByRange("utt_id", "frame").sortWithinPartitions("utt_id", "frame").write.mode("overwrite").parquet(path)


def read_store(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The frames of utterances first to last; the bounds are pushed down to the scan."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where(F.col("utt_id") >= first)
    return rows if last is None else rows.where(F.col("utt_id") <= last)


def sequences(frames: DataFrame) -> DataFrame:
    """utt_id and latents, an utterance's frames in order."""
    return frames.groupBy("utt_id").agg(F.sort_array(F.collect_list(F.struct("frame", "latent"))).alias("s")).select("utt_id", F.col("s.latent").alias("latents"))


def frame_count(samples: Column, rate: float, sample_rate: int, encoded: Column) -> Column:
    """Frames that audio of so many samples fills: one at least, no more than were encoded."""
    return F.least(F.greatest(F.lit(1).cast("long"), F.floor(samples * rate / sample_rate)), encoded)


def stitch_window(samples: Column, start: Column, size: int, fill: float = 0.0) -> Column:
    """``size`` samples from ``start`` on, filled up at the end."""
    return ve.pad(F.slice(samples, (start + 1).cast("int"), F.lit(size)), F.lit(size), fill)


def with_blocks(cuts: DataFrame, blocks: DataFrame, row: str = "stitch_row") -> DataFrame:
    """Each cut with its stitch block, by row number; cuts without one go."""
    return cuts.join(blocks, row)


def trimmed(length: Column, chance: Column, rate: float, most: float = 0.5) -> Column:
    """A prompt's length after a random trim of up to ``most`` seconds (rounded to frames, half to even) that leaves a second, or what there was of it. chance: uniform in [0, 1)."""
    if most <= 0:
        return length.cast("long")
    drop = F.floor(chance * (round(most * rate) + 1))
    return F.greatest(length - drop, F.least(length, F.lit(int(rate)))).cast("long")


def standardised(latent: Column, mean: Column, std: Column) -> Column:
    return F.zip_with(F.zip_with(latent, mean, lambda x, m: x - m), std, lambda x, s: x / s)


def restored(latent: Column, mean: Column, std: Column) -> Column:
    """The inverse of ``standardised``."""
    return F.zip_with(F.zip_with(latent, std, lambda x, s: x * s), mean, lambda x, m: x + m)


def assembled(*parts: Column) -> Column:
    """A struct of the parts in a row (``sequence``) and where each begins (``offsets``); a null part is empty."""
    parts = [F.coalesce(p, F.array().cast("array<double>")) for p in parts]
    begins, at = [], F.lit(0)
    for p in parts:
        begins.append(at)
        at = at + F.size(p)
    return F.struct(F.concat(*parts).alias("sequence"), F.array(*begins).alias("offsets"))


def collated(rows: DataFrame, batch: str) -> DataFrame:
    """Per batch: targets and prompts in order of id, padded to the longest, flags of what is real, and prompt sizes of one at least."""
    own = rows.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct("id", "target", "prompt"))).alias("m"))

    def padded(name: str) -> Column:
        widest = F.array_max(F.transform(F.col("m"), lambda r: F.greatest(F.size(r[name]), F.lit(1))))
        return let(widest, lambda n: F.transform(F.col("m"), lambda r: ve.pad(r[name], n)))

    width = F.array_max(F.transform(F.col("m"), lambda r: F.greatest(F.size(r["target"]), F.lit(1))))
    real = let(width, lambda n: F.transform(F.col("m"), lambda r: ve.mask(F.size(r["target"]), n)))
    sizes = F.transform(F.col("m"), lambda r: F.greatest(F.size(r["prompt"]), F.lit(1)))
    return own.select(batch, F.col("m.id").alias("ids"), padded("target").alias("targets"), real.alias("mask"), padded("prompt").alias("prompts"), sizes.alias("prompt_sizes"))


def flow_point(noise: Column, data: Column, t: Column, sigma: float = 1e-5) -> Column:
    """The point between noise and data at time t."""
    return F.zip_with(noise, data, lambda a, b: (1 - (1 - sigma) * t) * a + t * b)


def flow_loss(predicted: Column, noise: Column, data: Column, sigma: float = 1e-5) -> Column:
    """Mean squared error of a predicted velocity."""
    target = F.zip_with(noise, data, lambda a, b: b - (1 - sigma) * a)
    return ve.squared_distance(predicted, target) / F.size(data)


def combined_loss(flow: Column, eos: Column, weight: float) -> Column:
    return flow + weight * eos


def relative_deviation(warm: Column, cold: Column) -> Column:
    """Norm of the difference over the norm of the warm vector."""
    return F.sqrt(ve.squared_distance(warm, cold)) / (F.sqrt(ve.total(F.transform(warm, lambda x: x * x))) + 1e-8)


def calibrated(deviations: DataFrame, factor: float = 3.0, least: float = 1e-3, margin: int = 4) -> DataFrame:
    """One row: ``stitch``, the frames to replace after a cut, and ``floor``.

    deviations: (frame, deviation, settled) of all items. The floor is the largest deviation of settled frames; the
    stitch reaches past the last other frame whose largest deviation is above ``factor`` floors.
    """
    per = deviations.groupBy("frame").agg(F.max(F.when(F.col("settled"), F.col("deviation"))).alias("calm"), F.max(F.when(~F.col("settled"), F.col("deviation"))).alias("most"))
    one = per.agg(F.coalesce(F.max("calm"), F.lit(0.0)).alias("floor"), F.collect_list(F.struct("frame", "most")).alias("frames"))  # an utterance's frames at most
    above = F.transform(F.filter("frames", lambda r: r["most"] > F.greatest(factor * F.col("floor"), F.lit(least))), lambda r: r["frame"])
    return one.select((F.coalesce(F.array_max(above), F.lit(-1)) + 1 + margin).cast("long").alias("stitch"), "floor")


def logit_normal(u: Column, v: Column, mean: float = 0.0, std: float = 1.0) -> Column:
    """A time in (0, 1) whose log-odds are normal, from two uniforms in [0, 1)."""
    z = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)
    return 1 / (1 + F.exp(-(z * std + mean)))


def ordered_pair(s: Column, t: Column) -> Column:
    return F.struct(F.least(s, t).alias("s"), F.greatest(s, t).alias("t"))


def skip_weight(chance: Column, keep: float, equal: float = 0.0, training: bool = True) -> Column:
    """Weight of the distilled part of a loss whose other part weighs ``equal``: (1 - equal) / keep for a step that has it, 0 for one that skips it, so that
    expectations stay. Outside training no step skips it and it weighs 1 - equal."""
    if not training:
        return F.lit(1.0 - equal)
    return F.when(chance < keep, (1 - equal) / keep).otherwise(0.0)


def skipped_loss(diagonal: Column, distilled: Column, chance: Column, keep: float, equal: float, training: bool = True) -> Column:
    """The loss of both parts; ``distilled`` isn't needed (and may be null) where it is skipped."""
    weight = skip_weight(chance, keep, equal, training)
    return equal * diagonal + F.when(weight > 0, weight * distilled).otherwise(0.0)
