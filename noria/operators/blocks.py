"""Long ordered series in blocks, so that one key may hold all rows.

Rows are (keys, i, ...), i counting from 0 without gaps within a key. A block is ``size`` positions in a row; windows that look a
bounded way to either side run within a block that has its neighbours' edge rows (``with_halo``), runs of flagged rows are found in blocks and
joined at their edges (``runs``), and recurrences are composed as affine maps block by block (``affine_scan``). What meets by key alone is a row
or two for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noria.storage import stored

#: Positions of a block.
SIZE = 4096
#: Bytes of values that a scan steps through at once.
SCAN_BYTES = 8 << 20


def with_halo(rows: DataFrame, before: int, after: int, size: int = SIZE, at: str = "i") -> DataFrame:
    """Rows with ``_block`` and ``_own``: each in its own block, and again in a neighbour of which it is within ``before`` positions ahead of the first, or ``after`` behind the last."""
    if max(before, after) > size:
        raise ValueError("a halo reaches into one neighbour at most")
    block = F.floor(F.col(at) / size)
    place = F.col(at) - block * size
    copies = F.filter(F.array(block, F.when(place >= size - before, block + 1), F.when((place < after) & (block > 0), block - 1)), lambda b: b.isNotNull())
    return rows.withColumn("_block", F.explode(copies)).withColumn("_own", F.col("_block") == block)


def block_window(keys: list[str], at: str = "i"):
    """The window of a block of ``with_halo``, in order."""
    return Window.partitionBy(*keys, "_block").orderBy(at)


def without_halo(rows: DataFrame) -> DataFrame:
    return rows.where("_own").drop("_block", "_own")


def moving_mean(rows: DataFrame, keys: list[str], value: str, k: int, name: str, at: str = "i", size: int = SIZE) -> DataFrame:
    """Rows with the mean of k values up to their own, for those that have k."""
    w = block_window(keys, at).rowsBetween(-(k - 1), 0)
    return without_halo(with_halo(rows, k - 1, 0, max(size, k), at).withColumn(name, F.avg(value).over(w))).where(F.col(at) >= k - 1)


def runs(rows: DataFrame, keys: list[str], flag: str, size: int = SIZE, at: str = "i") -> DataFrame:
    """keys, start and length of each longest stretch of flagged rows; a null flag is none.

    Stretches are found within blocks. Of these, the ones that touch a block's edge, two in each block at most, are sorted by key and
    joined where one ends as the next begins.
    """
    block = F.floor(F.col(at) / size)
    flagged = rows.where(F.col(flag)).select(*keys, F.col(at).alias("_i"), block.alias("_block"))
    island = F.col("_i") - F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("_i"))
    found = flagged.withColumn("_island", island).groupBy(*keys, "_block", "_island").agg(F.min("_i").alias("start"), F.count(F.lit(1)).alias("length"))
    first, stop = F.col("_block") * size, F.col("start") + F.col("length")
    edge = (F.col("start") == first) | (stop == first + size)
    in_order = Window.partitionBy(*keys).orderBy("start")
    begins = F.coalesce(F.lag(stop).over(in_order) != F.col("start"), F.lit(True))
    chains = found.where(edge).withColumn("_new", begins.cast("long")).withColumn("_chain", F.sum("_new").over(in_order))
    joined = chains.groupBy(*keys, "_chain").agg(F.min("start").alias("start"), F.sum("length").alias("length"))
    return found.where(~edge).select(*keys, "start", "length").unionByName(joined.select(*keys, "start", "length"))


def _matrix(values: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(one row for each list, filled up with zeros; which places are real)."""
    size = np.asarray(values.value_lengths(), np.int64)
    real = np.arange(int(size.max(initial=0)))[None, :] < size[:, None]
    out = np.zeros(real.shape)
    out[real] = np.asarray(values.flatten(), float)
    return out, real


def _scan(a: pa.ListArray, b: pa.ListArray, start: np.ndarray) -> pa.ListArray:
    """States s = a s + b of each list, from its start."""
    (x, real), (y, _) = _matrix(a), _matrix(b)
    out, state = np.zeros(x.shape), start.astype(float)
    for t in range(x.shape[1]):
        state = x[:, t] * state + y[:, t]
        out[:, t] = state
    ends = np.concatenate([[0], np.cumsum(real.sum(1))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out[real]))


def affine_scan(rows: DataFrame, keys: list[str], a: str, b: str, start: Column, name: str, at: str = "i", size: int = SIZE) -> DataFrame:
    """Rows with the state s = a s + b after each, in order of position, from ``start`` (a column, equal within a key; a literal as a rule).

    A block of rows is itself a map s -> A s + B, so the states at the ends of blocks are the same recurrence over rows (key, block, A, B), which
    is solved first, in blocks again while a key has more than one. So there are as many rounds as ``size`` has to be multiplied by itself to
    reach the longest series: two for 16 million rows.
    """
    rows = stored(rows, "series")
    carried = _carried(rows.select(*keys, F.col(at).alias("_i"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"), start.cast("double").alias("_start")), keys, size)
    same = F.lit(True)
    for k in keys:
        same &= rows[k].eqNullSafe(carried[f"_key_{k}"])
    return rows.join(carried, same & (rows[at] == carried["_at"])).drop(*[f"_key_{k}" for k in keys], "_at").withColumnRenamed("_state", name)


def _carried(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """_key_*, _at and _state of rows (keys, _i, _a, _b, _start)."""
    own = [F.col(k).alias(f"_key_{k}") for k in keys]
    blocks = rows.groupBy(*own, F.floor(F.col("_i") / size).alias("_block")).agg(F.sort_array(F.collect_list(F.struct("_i", "_a", "_b"))).alias("_m"), F.first("_start").alias("_start"))  # size rows at most
    blocks = stored(blocks.select(*[f"_key_{k}" for k in keys], "_block", F.col("_m._i").alias("_at"), F.col("_m._a").alias("_a"), F.col("_m._b").alias("_b"), "_start"), "blocks")
    names = [f"_key_{k}" for k in keys]
    if blocks.where("_block > 0").isEmpty():
        begun = blocks
    else:
        whole = F.aggregate("_a", F.lit(1.0), lambda s, x: s * x), F.aggregate(F.arrays_zip("_a", "_b"), F.lit(0.0), lambda s, r: r["_a"] * s + r["_b"])
        ends = _carried(blocks.select(*names, F.col("_block").alias("_i"), whole[0].alias("_a"), whole[1].alias("_b"), "_start"), names, size)
        before = ends.select(*[F.col(f"_key_{n}").alias(f"_of_{n}") for n in names], (F.col("_at") + 1).alias("_next"), F.col("_state").alias("_begun"))
        same = F.col("_block") == F.col("_next")
        for n in names:
            same &= F.col(n).eqNullSafe(F.col(f"_of_{n}"))
        begun = blocks.join(before, same, "left").withColumn("_start", F.coalesce("_begun", "_start")).select(blocks.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = max(1, SCAN_BYTES // (8 * size))
            for k in range(0, batch.num_rows, n):
                some = batch.slice(k, n)
                start = np.asarray(some.column(len(names) + 4), float)
                states = _scan(some.column(len(names) + 2), some.column(len(names) + 3), start)
                yield pa.RecordBatch.from_arrays([*some.columns[: len(names) + 2], states], names=[*names, "_block", "_at", "_state"])

    types = dict(blocks.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*names, "_block", "_at")) + ", _state array<double>"
    states = begun.mapInArrow(run, schema)
    return states.select(*names, F.inline(F.arrays_zip("_at", "_state")))
