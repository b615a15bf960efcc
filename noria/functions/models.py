"""Where external models plug in: one load per worker, Arrow batches in and out."""

from __future__ import annotations

import importlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType


def model_column(load: Callable[[], Callable[[list], list]], result: DataType | None = None) -> Callable[[Column], Column]:
    """A column function for a model. load() runs once per worker and returns list -> list; None results are null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model(batch.tolist()), dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, StringType() if result is None else result)


def by_length(df: DataFrame, length: Column, partitions: int) -> DataFrame:
    """Rows of similar length together, so that model batches carry little padding."""
    return df.withColumn("_length", length).repartitionByRange(partitions, "_length").sortWithinPartitions("_length").drop("_length")


def through_model(df: DataFrame, key: str, chunks: Column, model: Callable[[Column], Column], joiner: str = " ") -> DataFrame:
    """key and text: each row's chunks go through the model one by one and are joined again in order.

    Chunks are rows of their own, so that a long text's are spread out. A row without chunks gives an empty text, one of
    whose chunks the model gives nothing for gives null.
    """
    rows = df.select(key, chunks.alias("_c"))
    parts = rows.select(key, F.posexplode("_c").alias("_at", "_chunk")).withColumn("_out", model(F.col("_chunk")))
    done = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_at", "_out"))).alias("_o"))
    whole = F.when(F.exists("_o", lambda r: r["_out"].isNull()), F.lit(None)).otherwise(F.array_join(F.col("_o._out"), joiner))
    return rows.select(key).join(done, key, "left").select(key, F.when(F.col("_o").isNull(), "").otherwise(whole).alias("text"))


def by_name(name: str) -> Callable:
    """The function that ``package.module:function`` names; an error that says so where it can't be imported."""
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError) as e:
        raise LookupError(f"no model {name!r}: {e}") from e


class Cache:
    """What ``load`` gives for a key, for the ``most`` keys used last; one for each worker."""

    def __init__(self, load: Callable[[Any], Any], most: int = 8):
        self.load, self.most, self.held = load, most, OrderedDict()

    def __call__(self, key: Any) -> Any:
        if key not in self.held:
            self.held[key] = self.load(key)
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        self.held.move_to_end(key)
        return self.held[key]


def generated(df: DataFrame, key: str, voice: str, chunks: str, load: Callable[[], tuple[Callable[[Any], Any], Callable[[Any, str], Iterator[list[float]]]]]) -> DataFrame:
    """key, chunk, part and samples: audio of each text chunk, part by part as the model gives it.

    load() runs once per worker and returns (state of a voice, generator of parts for a state and a text). Each chunk starts
    from the voice's own state, which is kept for the voices used last. A part is a row as soon as it is there.
    """
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state_of, speak = load()
        states = Cache(state_of)
        for batch in batches:
            for k in range(batch.num_rows):
                for c, text in enumerate(batch.column(2)[k].as_py() or ()):
                    for n, samples in enumerate(speak(states(batch.column(1)[k].as_py()), text)):
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([c], pa.int32()), pa.array([n], pa.int32()), pa.array([samples], pa.list_(pa.float32()))], names=[key, "chunk", "part", "samples"])

    return df.select(key, voice, chunks).mapInArrow(run, f"{key} {kind.simpleString()}, chunk int, part int, samples array<float>")


def _padded(rows: list[np.ndarray], multiple: int) -> np.ndarray:
    longest = -(-max(map(len, rows)) // multiple) * multiple
    out = np.zeros((len(rows), longest), np.float32)
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return out


def ragged_model(
    df: DataFrame, values: str, name: str, load: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], frames: Callable[[np.ndarray], np.ndarray], multiple: int = 1, batch_values: int = 1 << 20
) -> DataFrame:
    """df with ``name``, array<array<float>>: what a model makes of an array column, row by row, in padded batches.

    load() runs once per worker and returns f(padded (rows, longest), lengths) -> (rows, frames, features). Rows of an Arrow batch are sorted by
    length, so that a model batch of at most ``batch_values`` padded values holds rows of like length, padded with zeros to a multiple. ``frames``
    gives from lengths how many frames of the result are a row's own; a row has no more than the model made. Results come back in the rows' order and don't depend on how rows are
    batched, if the model's don't depend on padding. A model that gives nothing but zeros for rows that aren't empty is broken: an error. Null values give null, empty ones no frames.
    """
    at = df.columns.index(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            lists = batch.column(at)
            rows = [np.asarray(x.values, np.float32) if x.is_valid else None for x in lists]
            order = sorted((k for k, x in enumerate(rows) if x is not None and len(x)), key=lambda k: len(rows[k]))
            made: list[np.ndarray | None] = [None if x is None else np.zeros((0, 0), np.float32) for x in rows]
            begin = 0
            while begin < len(order):
                end = begin + 1
                while end < len(order) and (end + 1 - begin) * -(-len(rows[order[end]]) // multiple) * multiple <= batch_values:
                    end += 1
                own = [rows[k] for k in order[begin:end]]
                lengths = np.array(list(map(len, own)))
                out = np.asarray(model(_padded(own, multiple), lengths), np.float32)
                if out.size and not out.any() and any(x.any() for x in own):
                    raise ValueError("the model gives zeros only")
                for k, x, n in zip(order[begin:end], out, np.minimum(frames(lengths), out.shape[1]), strict=True):
                    made[k] = x[: int(n)]
                begin = end
            inner = [0 if x is None else len(x) for x in made]
            sizes = [s for x in made if x is not None for s in [x.shape[1]] * len(x)]
            flat = np.concatenate([np.zeros(0, np.float32), *(x.reshape(-1) for x in made if x is not None)])
            features = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat))
            result = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *inner]), pa.int32()), features, mask=pa.array([x is None for x in made]))
            yield pa.RecordBatch.from_arrays([*batch.columns, result], names=[*batch.schema.names, name])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(run, f"{schema}, `{name}` array<array<float>>")
