"""Timed words: quality, pause marks and places where an utterance may be cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noria.operators.quantiles import exact_quantiles

FRAME_RATE, MIN_CUT = 12.5, 1.0


def timed_words(words: DataFrame) -> DataFrame:
    """id, pos, word, start, end from id and ws (array): a stand-in for an aligner, by character offsets."""
    rows = words.select("id", F.posexplode("ws").alias("pos", "word"))
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0))
    there = F.length("word") > 0
    return rows.select("id", F.col("pos").cast("long").alias("pos"), "word", F.when(there, off / 10.0).alias("start"), F.when(there, (off + F.length("word")) / 10.0).alias("end"))


def quality(words: DataFrame) -> DataFrame:
    """timed, timed_ratio and ctc_score (-99 without a timed word) per utterance."""
    score = F.avg(F.when(F.col("start").isNotNull(), F.col("score")))
    return words.groupBy("id").agg(F.count("start").alias("timed"), F.round(F.count("start") / F.count(F.lit(1)), 4).alias("timed_ratio"), F.round(F.coalesce(score, F.lit(-99.0)), 4).alias("ctc_score"))


def keep_best(rated: DataFrame, drop_worst: float, min_timed: float = 0.9) -> DataFrame:
    """Rows at or above the exact quantile of ctc_score, with enough timed words."""
    if drop_worst <= 0:
        return rated.where(F.col("timed_ratio") >= min_timed)
    cut = exact_quantiles(rated, [], "ctc_score", [drop_worst]).select(F.element_at("q", 1).alias("cut"))
    return rated.join(F.broadcast(cut), (F.col("ctc_score") >= F.col("cut")) & (F.col("timed_ratio") >= min_timed), "left_semi")


def eligible_cuts(words: DataFrame, window: float = 5.0, tail: float = 0.5) -> DataFrame:
    """id, pos, cut, duration: middles of gaps a second from both ends, before ``window``; if none is, the first."""
    own = Window.partitionBy("id")
    w = own.orderBy("pos")
    pairs = words.withColumn("duration", F.max("end").over(own) + tail).withColumn("before", F.lag("end").over(w))
    pairs = pairs.withColumn("cut", (F.col("before") + F.col("start")) / 2)
    valid = pairs.where(F.col("cut").isNotNull() & (F.col("cut") >= MIN_CUT) & (F.col("cut") <= F.col("duration") - MIN_CUT))
    limit = F.lit(True) if window <= 0 else F.col("before") < window
    valid = valid.withColumn("within", limit).withColumn("any_within", F.max("within").over(own)).withColumn("k", F.row_number().over(w))
    return valid.where(F.when(F.col("any_within"), F.col("within")).otherwise(F.col("k") == 1)).select("id", "pos", "cut", "duration")


def cut_frames(cuts: DataFrame, rate: float = FRAME_RATE) -> DataFrame:
    """cut_frame (rounded half to even, within the utterance) and the utterance's frames."""
    frames = F.floor(F.col("duration") * rate)
    return cuts.withColumn("frames", frames).withColumn("cut_frame", F.least(F.greatest(F.rint(F.col("cut") * rate), F.lit(1.0)), frames - 1).cast("int"))


def first_per_frame(cuts: DataFrame) -> DataFrame:
    first = Window.partitionBy("id", "cut_frame").orderBy("pos")
    return cuts.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def index_rows(cuts: DataFrame) -> DataFrame:
    """One row per utterance that has a cut: frames, duration and its cuts in order."""
    return cuts.groupBy("id").agg(F.first("frames").alias("frames"), F.first("duration").alias("duration"), F.sort_array(F.collect_list(F.struct("cut_frame", "pos"))).alias("cuts"))


def cache_meta(index: DataFrame, words: DataFrame) -> DataFrame:
    """One row of totals; utterances without a cut are counted as skipped."""
    timed = words.where("end IS NOT NULL").select("id").distinct().agg(F.count(F.lit(1)).alias("all"))
    totals = index.agg(F.count(F.lit(1)).alias("utterances"), F.sum("frames").alias("frames"), F.sum(F.size("cuts")).alias("cuts"), F.round(F.sum("duration") / 3600, 3).alias("hours"))
    return totals.join(F.broadcast(timed)).select("utterances", "frames", "cuts", "hours", (F.col("all") - F.col("utterances")).alias("skipped_no_cut"))


def pause_marks(words: DataFrame, comma: float = 0.22, period: float = 0.55) -> DataFrame:
    """A stop or comma after words before a pause; the last word of an utterance always gets a stop."""
    own = Window.partitionBy("id")
    pause = F.lead("start").over(own.orderBy("pos")) - F.col("end")
    last = F.max("pos").over(own)
    marked = words.withColumn("_pause", pause).withColumn("_last", last).withColumn("_timed", F.max("end").over(own)).where("_timed IS NOT NULL")
    mark = F.when(F.col("pos") == F.col("_last"), ".").when(F.col("_pause") >= period, ".").when(F.col("_pause") >= comma, ",").otherwise("")
    twins = {c: F.concat(c, mark) for c in ("word", "diac") if c in words.columns}
    return marked.withColumns(twins).drop("_pause", "_last", "_timed")


def word_structs(words: DataFrame) -> DataFrame:
    """id and words, an array of structs word, start, end in order."""
    return words.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "start", "end"))).alias("words"))


def projected(words: Column, *fields: str) -> Column:
    """Only these fields of an array of structs."""
    return F.transform(words, lambda w: F.struct(*[w[f].alias(f) for f in fields]))


def worst(rated: DataFrame, n: int, score: str = "ctc_score", key: str = "id") -> DataFrame:
    """The n rows of least score."""
    return rated.orderBy(score, key).limit(n)


def quantile_line(rated: DataFrame, share: float, score: str = "ctc_score") -> DataFrame:
    """One row: the exact quantile of the score; none for an empty table."""
    return exact_quantiles(rated, [], score, [share]).select(F.element_at("q", 1).alias("line"))


def first_audio(index: DataFrame, manifest: DataFrame) -> DataFrame:
    """id and audio of the first row of the index in order of offset; an error if the manifest lacks it."""
    first = index.orderBy("offset").limit(1).select("id")
    found = first.join(manifest.select("id", "audio"), "id", "left")
    return found.withColumn("audio", F.coalesce("audio", F.raise_error(F.concat(F.lit("no audio for "), F.col("id").cast("string")))))
