"""Frames of embeddings in stores: joins by utterance without an exchange, and ranges of places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noria.functions import vectors as ve
from noria.operators import store
from noria.operators.ordering import running_number
from noria.storage import new_path

from .registry import query
from .sequence_queries import _E, vectors

#: An utterance has as many of its vector's eight frames as its number says.
_FRAMES = f"{_E}, f AS (SELECT vec_id, f AS frame, v[8 * f + 1:8 * f + 8] AS x FROM e, range(8) r(f)), n AS (SELECT vec_id, 1 + vec_id % 8 AS frames FROM e)"
_PLACED = f"{_FRAMES}, p AS (SELECT *, row_number() OVER (ORDER BY vec_id, frame) - 1 AS place FROM f)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    eight = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("v", t * 8 + 1, F.lit(8)))
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("utt_id"), F.posexplode(eight).alias("frame", "latent"))


@query(f"WITH {_FRAMES} SELECT vec_id AS utt_id, CAST(frame AS INTEGER) AS frame, frames, round(list_sum(x), 4) + 0.0 AS s FROM n JOIN f USING (vec_id) WHERE frame < frames")
def q_bucketed_frames(spark, sf_dir):
    """Index and frames in four buckets each, joined bucket by bucket, opened anew from their layout."""
    index = vectors(spark, sf_dir).select(F.col("vec_id").alias("utt_id"), (1 + F.col("vec_id") % 8).alias("frames"))
    paths = [new_path(spark, "index"), new_path(spark, "frames")]
    store.save_bucketed(index, paths[0], "utt_id", [], 4)
    store.save_bucketed(frames(spark, sf_dir), paths[1], "utt_id", ["frame"], 4)
    joined = store.frames_of(store.open_bucketed(spark, paths[0]), store.open_bucketed(spark, paths[1]))
    return joined.select("utt_id", "frame", "frames", (F.round(ve.total(F.col("latent")), 4) + 0.0).alias("s"))


@query(f"WITH {_PLACED} SELECT n.vec_id AS utt_id, place AS \"at\", round(list_sum(x), 4) + 0.0 AS s FROM n JOIN p ON place >= n.vec_id * 7 AND place < n.vec_id * 7 + n.frames")
def q_range_frames(spark, sf_dir):
    """Frames by running place; each utterance asks for a range of places that isn't its own."""
    path = new_path(spark, "places")
    store.write_ranges(running_number(frames(spark, sf_dir), ["utt_id", "frame"], "at"), path, "at")
    wanted = vectors(spark, sf_dir).select(F.col("vec_id").alias("asked"), (F.col("vec_id") * 7).alias("first"), (1 + F.col("vec_id") % 8).alias("frames"))
    found = store.read_ranges(spark, path, wanted, 64)
    return found.select(F.col("asked").alias("utt_id"), "at", (F.round(ve.total(F.col("latent")), 4) + 0.0).alias("s"))


@query(f"WITH {_PLACED} SELECT vec_id AS utt_id, CAST(frame AS INTEGER) AS frame, place AS \"at\", round(list_sum(x), 4) + 0.0 AS s FROM p WHERE place >= 1001 AND place < 1501")
def q_range_read(spark, sf_dir):
    """Places 1001 to 1500 of all frames."""
    path = new_path(spark, "places")
    store.write_ranges(running_number(frames(spark, sf_dir), ["utt_id", "frame"], "at"), path, "at")
    return store.read_range(spark, path, 1001, 1501).select("utt_id", "frame", "at", (F.round(ve.total(F.col("latent")), 4) + 0.0).alias("s"))
