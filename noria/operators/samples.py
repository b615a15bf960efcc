"""Training samples: lengths, shards, length buckets and seeded choices.

Random choices are uniforms from MD5 of a row's key and a seed: the same on any number of
executors, and the same again when a lost task is run anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noria.functions import arabic as ar

from .ordering import running_number


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("long") / 268435456.0


def lengths(rows: DataFrame, rate: float = 12.5, most: float = 20.0, trail: float = 0.2, prompt: float = 5.0) -> DataFrame:
    """target_len and prompt_len in frames from duration, cut and last_end in seconds."""
    end = F.when(F.col("last_end") > F.col("cut"), F.least(F.col("duration"), F.col("last_end") + trail)).otherwise(F.col("duration"))
    cut_frame = F.greatest(F.floor(F.col("cut") * rate), F.lit(1))
    stored = F.greatest(F.floor(F.col("duration") * rate), F.lit(2))
    target = F.least(F.greatest(F.floor(F.least(end - F.col("cut"), F.lit(most)) * rate), F.lit(1)), F.greatest(stored - cut_frame, F.lit(1)))
    cap = F.greatest(F.lit(1), F.floor(F.lit(prompt * rate)))
    return rows.withColumn("target_len", target.cast("long")).withColumn("prompt_len", F.least(cut_frame, cap).cast("long"))


def shards(df: DataFrame, order: list[str], world: int) -> DataFrame:
    """Strided sharding: rows r, r + world, ... of the order."""
    return running_number(df, order, "_n").withColumn("shard", F.col("_n") % world).drop("_n")


def buckets(rows: DataFrame, batch_size: int, pool_batches: int, seed: int | None = None, key: str = "id", length: str = "len") -> DataFrame:
    """pool and batch of each row: rows of similar length share a batch. With a seed the order is shuffled and short batches go."""
    order = [F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)] if seed is not None else [F.col(key)]
    pooled = running_number(rows, order, "_rn").withColumn("pool", F.expr(f"_rn div {batch_size * pool_batches}"))
    own = Window.partitionBy("pool").orderBy(length, "_rn")
    out = pooled.withColumn("_k", F.row_number().over(own)).withColumn("batch", F.expr(f"cast((_k - 1) div {batch_size} as long)"))
    if seed is not None:
        out = out.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("pool", "batch"))).where(F.col("_size") == batch_size).drop("_size")
    return out.drop("_rn", "_k")


def mix_mode(u: Column, plain: float = 0.55, partial: float = 0.30) -> Column:
    return F.when(u < plain, "plain").when(u < plain + partial, "partial").otherwise("full")


def subsample_marks(text: Column, key: Column, keep: float) -> Column:
    """Each letter keeps all of its marks with probability ``keep``, else none."""
    return F.array_join(F.transform(ar.clusters(text), lambda c, i: F.when(F.length(c) == 1, c).when(uniform(F.concat_ws(":", key, i.cast("string"))) < keep, c).otherwise(F.substring(c, 1, 1))), "")


def mixed_text(words: Column, key: Column, mode: Column, word_prob: Column) -> Column:
    """Words (struct word, diac): bare in plain mode, marked in full mode, marked by chance in partial mode."""
    return F.array_join(F.transform(words, lambda w, i: F.when(w["diac"].isNull() | (mode == "plain"), w["word"]).when((mode == "full") | (uniform(F.concat_ws(":", key, i.cast("string"))) < word_prob), w["diac"]).otherwise(w["word"])), " ")
