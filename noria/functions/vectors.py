"""Arrays of numbers as Column expressions. Sums run in array order and in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arabic import let


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def normalise(a: Column) -> Column:
    """Zero mean, unit sample variance."""


    def scaled(centred: Column) -> Column:
        return let(F.sqrt(total(F.transform(centred, lambda x: x * x)) / (F.size(centred) - 1) + 1e-7), lambda d: F.transform(centred, lambda x: x / d))

    return let(let(mean(a), lambda m: F.transform(a, lambda x: x - m)), scaled)


def log_softmax(a: Column) -> Column:


    def scaled(b: Column) -> Column:
        return let(F.log(total(F.transform(b, lambda y: F.exp(y)))), lambda z: F.transform(b, lambda x: x - z))

    return let(let(F.array_max(a), lambda top: F.transform(a, lambda x: x - top)), scaled)


def pad(a: Column, n: Column, value: float = 0.0) -> Column:
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(n - F.size(a), F.lit(0)).cast("int")))


def mask(size: Column, n: Column) -> Column:
    """n flags, true below size."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: i < size)


def pcm16(a: Column) -> Column:
    return F.transform(a, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767).cast("smallint"))


def peak_normalise(a: Column) -> Column:
    return let(F.greatest(F.lit(1.0), F.array_max(F.transform(a, lambda x: F.abs(x)))), lambda peak: F.transform(a, lambda x: x / peak))


def down_mix(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def guided(base: Column, with_condition: Column, scale: float) -> Column:
    return F.zip_with(base, with_condition, lambda x, y: x + scale * (y - x))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def stitched(stitch: Column, latents: Column, cut: Column, frames: Column) -> Column:
    """The first frames from the stitch block, the rest from the stored frames after the cut."""
    n = F.least(F.size(stitch), frames)
    return F.concat(F.slice(stitch, F.lit(1), n), F.slice(latents, cut + n + 1, F.greatest(frames - n, F.lit(0))))


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def digest(parts: Column) -> Column:
    """SHA-256 of sorted strings."""
    return F.sha2(F.array_join(F.array_sort(parts), "").cast("binary"), 256)
