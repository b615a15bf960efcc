"""Embeddings as recordings, in blocks: resampling and energy."""

from __future__ import annotations

from pyspark.sql import functions as F

from noria.functions import models, resampling
from noria.operators import recordings, signal

from .registry import query
from .sequence_queries import _E, vectors


def _direct(up: int, down: int) -> str:
    """DuckDB: put zeros between the samples, filter, take every ``down``-th."""
    taps = resampling.low_pass(up, down)
    half = len(taps) // 2
    listed = ", ".join(repr(float(t)) for t in taps)
    return f"""WITH {_E}, h AS (SELECT CAST([{listed}] AS DOUBLE[]) AS h),
o AS (SELECT vec_id, v, unnest(range(0, CAST(ceil(len(v) * {up} / {down}.0) AS BIGINT))) AS m FROM e)
SELECT CAST(vec_id AS VARCHAR) AS key, CAST(m AS BIGINT) AS pos, round(list_sum(list_transform(range(0, len(v)), lambda k: CASE WHEN abs(m * {down} - k * {up}) <= {half} THEN v[k + 1] * h[{half} + 1 + m * {down} - k * {up}] ELSE 0.0 END)), 6) + 0.0 AS x FROM o, h"""


def _resample_query(name: str, source: int, target: int, size: int) -> None:
    def run(spark, sf_dir):
        blocks = recordings.resample_column(vectors(spark, sf_dir), "vec_id", "v", source, target, size)
        rows = blocks.select("key", "at", F.posexplode("samples").alias("p", "x"))
        return rows.select("key", (F.col("at") + F.col("p")).alias("pos"), (F.round("x", 6) + 0.0).alias("x"))

    run.__name__ = name
    query(_direct(*resampling.ratio(source, target)))(run)


_resample_query("q_resample_up", 16000, 24000, 16)
_resample_query("q_resample_down", 24000, 16000, 21)

_FRAMES = f"{_E}, b AS (SELECT CAST(vec_id AS VARCHAR) AS key, i, 10 * log10(list_sum(list_transform(v[i * 8 + 1:i * 8 + 8], lambda x: x * x)) / 8 + 1e-12) AS x FROM e, range(0, 8) r(i))"


@query(f"WITH {_FRAMES} SELECT key, i, round(sum(x) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3, 5) AS x FROM b")
def q_block_energy(spark, sf_dir):
    """Energy of hops of eight samples, block by block, smoothed over block edges."""
    blocks = recordings.cut_blocks(vectors(spark, sf_dir), "vec_id", "v", 24)
    track = recordings.energy(blocks, 8)
    return signal.smooth3(track, "key").select("key", "i", F.round("x", 5).alias("x"))


def _codec():
    """A stub for a codec: of every eight samples their mean and their peak. Padding has no part in a row's own frames."""
    import numpy as np

    def encode(padded, lengths):
        frames = padded.reshape(len(padded), -1, 8)
        real = np.arange(padded.shape[1])[None, :] < lengths[:, None]
        n = np.maximum(real.reshape(frames.shape).sum(-1), 1)
        return np.stack([frames.sum(-1) / n, np.abs(frames).max(-1)], axis=-1)

    return encode


@query(f"""WITH {_E}, r AS (SELECT vec_id, v[1:1 + CAST(vec_id % 64 AS BIGINT)] AS v FROM e), f AS (SELECT vec_id, i AS frame, v[8 * i + 1:8 * i + 8] AS x FROM r, range(8) t(i) WHERE 8 * i < len(v))
SELECT vec_id, CAST(frame AS INTEGER) AS frame, round(list_avg(x), 4) + 0.0 AS mean, round(list_max(list_transform(x, lambda y: abs(y))), 4) AS peak FROM f""")
def q_ragged_codec(spark, sf_dir):
    """Rows of 1 to 64 samples through a model in padded batches."""
    rows = vectors(spark, sf_dir).select("vec_id", F.slice("v", F.lit(1), (F.col("vec_id") % 64 + 1).cast("int")).alias("x"))
    done = models.ragged_model(rows, "x", "z", _codec, lambda n: -(-n // 8), multiple=8, batch_values=4096)
    frames = done.select("vec_id", F.posexplode("z").alias("frame", "f"))
    return frames.select("vec_id", "frame", (F.round(F.element_at("f", 1).cast("double"), 4) + 0.0).alias("mean"), F.round(F.element_at("f", 2).cast("double"), 4).alias("peak"))
