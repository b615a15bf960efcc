"""Long recordings as tables of blocks, so that one recording is spread over tasks.

A block is a row (key, total, at, lead, samples): the recording's number of samples, the number of the block's first own sample, and
its samples, of which the first ``lead`` belong to the block before; what follows its own may belong to the block behind. Blocks of
one recording begin at multiples of one size. Nothing here brings a recording together again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noria.functions import resampling

BLOCKS = "key string, total long, at long, lead long, samples array<double>"
_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of positive integers, in as many steps as Euclid needs for 32 bits."""
    pair = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.struct(s["b"].alias("a"), F.when(s["b"] == 0, s["a"]).otherwise(s["a"] % s["b"]).alias("b"))
    keep = lambda s, i: F.when(s["b"] == 0, s).otherwise(step(s, i))
    return F.aggregate(F.sequence(F.lit(1), F.lit(48)), pair, keep, lambda s: s["a"])


def reach(up: Column, down: Column) -> Column:
    """How many inputs to each side an output of a resampling needs, one more for good measure."""
    return F.ceil(F.lit(resampling.CROSSINGS) * F.greatest(up, down) / up) + 1


def cut_blocks(rows: DataFrame, key: str, samples: str, size: int, halo: int = 0) -> DataFrame:
    """Blocks of ``size`` samples of an array column, reaching ``halo`` samples into both neighbours; null and empty arrays have none."""
    rows = rows.select(F.col(key).cast("string").alias("key"), F.size(samples).cast("long").alias("total"), F.col(samples).cast("array<double>").alias("_s")).where("total > 0")
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(size).cast("long"))))
    lead = F.least(F.col("at"), F.lit(halo).cast("long"))
    return rows.select("key", "total", "at", lead.alias("lead"), F.slice("_s", (F.col("at") - lead + 1).cast("int"), (lead + size + halo).cast("int")).alias("samples"))


def own_samples(blocks: DataFrame, size: int) -> DataFrame:
    """The blocks without what belongs to their neighbours."""
    return blocks.select("key", "total", "at", F.lit(0).cast("long").alias("lead"), F.slice("samples", (F.col("lead") + 1).cast("int"), F.lit(size)).alias("samples"))


def resampled(blocks: DataFrame, size: int, source: int, target: int) -> DataFrame:
    """Blocks at another rate, equal to those of the whole recording resampled. size: own samples of a block; they must reach ``reach`` samples into their neighbours.

    Where size isn't a multiple of the ratio's denominator, blocks begin where their first own output does.
    """
    up, down = resampling.ratio(source, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, at, lead = (np.asarray(batch.column(k), np.int64) for k in (1, 2, 3))
            first = -(-at * up // down)
            stop = -(-np.minimum(at + size, total) * up // down)
            out = [resampling.resample_range(np.asarray(x.values, float), int(a - n), int(m), int(e), up, down) for x, a, n, m, e in zip(batch.column(4), at, lead, first, stop, strict=True)]
            columns = (batch.column(0), pa.array(-(-total * up // down)), pa.array(first), pa.array(np.zeros(len(at), np.int64)), pa.array(out, pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(list(columns), names=_NAMES)

    if up == down:
        return own_samples(blocks, size)
    return blocks.mapInArrow(run, BLOCKS)


def resample_column(rows: DataFrame, key: str, samples: str, source: int, target: int, size: int) -> DataFrame:
    """Blocks of an array column at another rate: cut with the halo that this needs, then resampled."""
    up, down = resampling.ratio(source, target)
    halo = 0 if up == down else resampling.phases(up, down)[1] + 1
    return resampled(cut_blocks(rows, key, samples, size, halo), size, source, target)


def energy(blocks: DataFrame, hop: int) -> DataFrame:
    """key, i and x: decibels of each full hop of samples, by its number in the recording. Blocks begin at multiples of ``hop`` and have no halo; the rest behind the last full hop is dropped."""
    at = F.transform(F.sequence(F.lit(0), (F.size("samples") / hop).cast("int") - 1), lambda k: F.struct((F.col("at") / hop).cast("long").alias("at"), k.alias("k")))

    def decibels(k: Column) -> Column:
        power = F.aggregate(F.slice("samples", k * hop + 1, F.lit(hop)), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / hop
        return 10 * F.log10(power + 1e-12)

    full = blocks.where(F.size("samples") >= hop).withColumn("_f", F.transform(at, lambda r: F.struct((r["at"] + r["k"]).alias("i"), decibels(r["k"]).alias("x"))))
    return full.select("key", F.inline("_f"))
