"""Tracks of frames: energy, thresholds, silent runs, scans and the refinement of boundaries.

A track is rows (key, i, x), i counting from 0 without gaps. Tracks of any length are worked on in blocks (``noria.operators.blocks``); only what is
searched between two words is one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noria.operators import blocks
from noria.operators.quantiles import exact_quantiles


def _own(key: str | list[str]):
    return Window.partitionBy(*([key] if isinstance(key, str) else key))


def frame_energy(samples: DataFrame, key: str, hop: int) -> DataFrame:
    """Decibels of each full hop of samples (key, i, x); the rest at the end is dropped."""
    frames = samples.groupBy(key, F.expr(f"i div {hop}").alias("frame")).agg(F.avg(F.col("x") * F.col("x")).alias("power"), F.count(F.lit(1)).alias("n"))
    return frames.where(F.col("n") == hop).select(key, F.col("frame").alias("i"), (10 * F.log10(F.col("power") + 1e-12)).alias("x"))


def smooth3(track: DataFrame, key: str) -> DataFrame:
    """Centred mean of three; beyond the ends there are zeros."""
    w = blocks.block_window([key]).rowsBetween(-1, 1)
    return blocks.without_halo(blocks.with_halo(track, 1, 1).withColumn("x", F.sum("x").over(w) / 3))


def thresholds(track: DataFrame, key: str, hot: bool = False) -> DataFrame:
    """Silence threshold per key from the 5th and 90th percentile. hot: a key may have more frames than one task should sort."""
    parts = [0.05, 0.9]
    p = exact_quantiles(track, [key], "x", parts).withColumnRenamed("q", "p") if hot else track.groupBy(key).agg(F.percentile("x", F.array(*map(F.lit, parts))).alias("p"))
    low, high = F.element_at("p", 1), F.element_at("p", 2)
    return p.select(key, F.greatest(high - 35, F.least(low + 8, high - 15)).alias("threshold"))


def _best_run(found: DataFrame, keys: list[str], start: str, length: str) -> DataFrame:
    best = F.max_by(F.struct(F.col(start).alias("s"), F.col(length).alias("n")), F.when(F.col(length) > 0, F.struct(length, -F.col(start))))
    found = found.groupBy(*keys).agg(best.alias("b"))
    return found.select(*keys, F.coalesce("b.s", F.lit(0)).cast("long").alias("start"), F.coalesce("b.n", F.lit(0)).cast("long").alias("length"))


def longest_run(track: DataFrame, keys: list[str], flag: str, size: int = blocks.SIZE) -> DataFrame:
    """start and length of the longest run of flagged frames, the earliest of equals; (0, 0) if there is none."""
    none = track.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"))
    return _best_run(blocks.runs(track, keys, flag, size).unionByName(none), keys, "start", "length")


def _searched_run(frames: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """``longest_run`` where a group is the few frames between two words."""
    w = _own(keys).orderBy("i")
    islands = frames.withColumn("_n", F.row_number().over(w)).withColumn("_r", F.row_number().over(_own([*keys, flag]).orderBy("i")))
    runs = islands.groupBy(*keys, flag, (F.col("_n") - F.col("_r")).alias("_g")).agg(F.min("i").alias("_s"), F.count_if(flag).alias("_l"))
    return _best_run(runs, keys, "_s", "_l")


def first_minimum(track: DataFrame, keys: list[str]) -> DataFrame:
    return track.groupBy(*keys).agg(F.min_by("i", F.struct("x", "i")).alias("at"))


def speech_edges(track: DataFrame, key: str, flag: str, run: int, begin: Column, end: Column, size: int = blocks.SIZE) -> DataFrame:
    """first_start: after the last silence of ``run`` frames before ``begin``; last_end: where one starts from ``end`` on.

    ``begin`` and ``end`` are frame numbers per row, equal within a key. Without such a silence: 0 and the number of frames.
    """
    w = blocks.block_window([key])
    full = F.count(F.lit(1)).over(w.rowsBetween(-run, -1)) == run
    t = blocks.with_halo(track, run, run - 1, max(size, run))
    t = t.withColumn("_ahead", F.min(flag).over(w.rowsBetween(0, run - 1))).withColumn("_behind", F.min(flag).over(w.rowsBetween(-run, -1)) & full)
    found = blocks.without_halo(t).groupBy(key).agg(
        F.min(F.when(F.col("_ahead") & (F.col("i") >= end), F.col("i"))).alias("e"),
        F.max(F.when(F.col("_behind") & (F.col("i") <= begin), F.col("i"))).alias("b"),
        F.count(F.lit(1)).alias("n"),
    )
    return found.select(key, F.coalesce("b", F.lit(0)).alias("first_start"), F.coalesce("e", "n").alias("last_end"))


def refine(frames: DataFrame, keys: list[str], flag: str, min_run: int, hop: float, comma: float = 0.22, period: float = 0.55) -> DataFrame:
    """Boundaries between two words from the frames searched between them: word_end, word_start, mark.

    A silent run of ``min_run`` frames or more parts the words; else both meet in the first energy minimum.
    Pairs don't share fields, so all are done at once.
    """
    runs = _searched_run(frames, keys, flag).withColumnRenamed("start", "_s").withColumnRenamed("length", "_n")
    both = runs.join(first_minimum(frames, keys), keys)
    silent = F.col("_n") >= min_run
    middle = (F.col("at") + 0.5) * hop
    pause = F.col("_n") * hop
    return both.select(*keys, F.round(F.when(silent, F.col("_s") * hop).otherwise(middle), 3).alias("word_end"), F.round(F.when(silent, (F.col("_s") + F.col("_n")) * hop).otherwise(middle), 3).alias("word_start"), F.when(silent & (pause >= period), ".").when(silent & (pause >= comma), ",").otherwise("").alias("mark"))


def viterbi(emissions: Column, tokens: Column, blank: int = 0) -> Column:
    """Best log score of a forced alignment: emissions (frames of log scores), tokens (ids, each spoken once in order)."""
    none = F.lit(float("-inf"))
    start = F.transform(F.sequence(F.lit(0), F.size(tokens)), lambda j: F.when(j == 0, F.lit(0.0)).otherwise(none))

    def step(state: Column, e: Column) -> Column:
        stay = lambda j: F.element_at(state, j + 1) + F.element_at(e, blank + 1)
        move = lambda j: F.element_at(state, F.greatest(j, F.lit(1))) + F.element_at(e, F.element_at(tokens, F.greatest(j, F.lit(1))) + 1)
        return F.transform(F.sequence(F.lit(0), F.size(tokens)), lambda j: F.when(j == 0, stay(j)).otherwise(F.greatest(stay(j), move(j))))

    return F.aggregate(emissions, start, step, lambda s: F.element_at(s, -1))
