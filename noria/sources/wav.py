"""WAV files as rows: PCM of 8, 16 or 32 bits, mixed down and resampled; long recordings as blocks of samples."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noria.functions import resampling
from noria.operators import recordings

SCHEMA = "path string, rate int, samples array<float>, error string"


def decode(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, mono samples in [-1, 1]): the mean over channels."""
    with wave.open(io.BytesIO(data)) as w:
        rate, width, channels, raw = w.getframerate(), w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())
    return rate, mono(raw, width, channels)


def mono(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Samples in [-1, 1] of interleaved PCM: the mean over channels."""
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    else:
        raise ValueError(f"{8 * width} bits a sample")
    return x.reshape(-1, channels).mean(axis=1)


def encode(samples: np.ndarray, rate: int) -> bytes:
    """16-bit mono WAV."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def read_wav(spark: SparkSession, path: str, rate: int | None = None) -> DataFrame:
    """path, rate, samples and error of the WAV files below a folder; an unreadable file is a row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                got, x, error = None, None, None
                try:
                    got, x = decode(data.as_py())
                    if rate and got != rate:
                        got, x = rate, resampling.resample(x, got, rate)
                except (wave.Error, EOFError, ValueError) as e:
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([got], pa.int32()), pa.array([None if x is None else x], pa.list_(pa.float32())), pa.array([error], pa.string())], names=["path", "rate", "samples", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


#: Bytes of a file in which its header must end, and what is read from it.
_HEADER_BYTES = 1 << 16
_HEADER = "rate int, width int, channels int, data long, bytes long, error string"


def header(start: bytes, size: int) -> tuple[int, int, int, int, int]:
    """(rate, bytes a sample, channels, where the samples begin, how many bytes they have) from the first bytes of a file of ``size`` bytes."""
    if start[:4] != b"RIFF" or start[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(start):
        name, n = struct.unpack_from("<4sI", start, at)
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", start, at + 8)
        elif name == b"data":
            if form is None or form[0] not in (1, 0xFFFE) or form[5] not in (8, 16, 32) or not form[1]:
                raise ValueError(f"not PCM of 8, 16 or 32 bits: {form}")
            return form[2], form[5] // 8, form[1], at + 8, min(n, size - at - 8)
        at += 8 + n + n % 2  # chunks begin at even places
    raise ValueError("no samples")


def _headers(start: pd.Series, size: pd.Series) -> pd.DataFrame:
    rows = []
    for raw, n in zip(start, size, strict=True):
        try:
            rows.append((*header(raw, n), None))
        except (ValueError, struct.error) as e:
            rows.append((None, None, None, None, None, f"{type(e).__name__}: {e}"))
    out = pd.DataFrame(rows, columns=["rate", "width", "channels", "data", "bytes", "error"])
    return out.astype({c: "Int64" for c in ("rate", "width", "channels", "data", "bytes")})


def read_wav_blocks(spark: SparkSession, path: str, rate: int | None = None, hop: int = 1, seconds: float = 10.0) -> DataFrame:
    """Blocks (as ``noria.operators.recordings`` has them) of the WAV files below a folder, with rate and error; key is the path.

    Of each file only byte ranges are passed on, one for each block of about ``seconds``, and dealt out over all tasks, which decode, mix down
    and resample them. Blocks begin at multiples of ``hop`` samples of the result. A range reaches a little into its neighbours where the rate changes, so
    that blocks come out as the whole file would. An unreadable file is one row with an error; one without samples has no rows. Spark reads
    binary files of up to 2 GB.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path)
    files = files.select(F.col("path").alias("key"), "content", F.pandas_udf(_headers, _HEADER)(F.substring("content", 1, _HEADER_BYTES), "length").alias("h"))
    h, wanted = (lambda c: F.col("h")[c]), F.lit(rate) if rate else F.col("h")["rate"]
    files = files.withColumn("total", (h("bytes") / (h("width") * h("channels"))).cast("long")).withColumn("_g", F.greatest(recordings.gcd(h("rate"), wanted), F.lit(1)))
    files = files.withColumn("_up", (wanted / F.col("_g")).cast("int")).withColumn("_down", (h("rate") / F.col("_g")).cast("int"))
    step = F.col("_down").cast("long") * hop
    files = files.withColumn("_size", F.greatest(F.ceil(h("rate") * seconds / step), F.lit(1)) * step)
    places = F.when(F.col("total") > 0, F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.col("_size")))
    good = files.where("h.error IS NULL").select("*", F.explode(places).alias("at"))
    reach = F.when(F.col("_up") == F.col("_down"), 0).otherwise(recordings.reach(F.col("_up"), F.col("_down")))
    lead = F.least(F.col("at"), reach.cast("long"))
    stop = F.least(F.col("total"), F.col("at") + F.col("_size") + reach)
    frame = h("width") * h("channels")
    raw = F.substring("content", (h("data") + (F.col("at") - lead) * frame + 1).cast("int"), ((stop - F.col("at") + lead) * frame).cast("int"))
    ranges = good.select("key", h("rate").alias("rate"), h("width").alias("width"), h("channels").alias("channels"), "total", "at", F.col("_size").alias("size"), lead.alias("lead"), raw.alias("raw"))
    dealt = ranges.repartition("key", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x, source, target = mono(r["raw"], r["width"], r["channels"]), r["rate"], rate or r["rate"]
                size, total, at = min(r["size"], r["total"] - r["at"]), r["total"], r["at"]
                up, down = resampling.ratio(source, target)
                if up != down:
                    first, stop = at * up // down, resampling.outputs(at + size, up, down)
                    x = resampling.resample_range(x, at - r["lead"], first, stop, up, down).astype(np.float32)
                    total, at = resampling.outputs(total, up, down), first
                columns = ([r["key"]], [total], [at], [0], [x], [target], [None])
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float32()), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_BLOCK_NAMES)

    bad = files.where("h.error IS NOT NULL").select("key", *[F.lit(None).alias(c) for c in _BLOCK_NAMES[1:-1]], h("error").alias("error"))
    return dealt.mapInArrow(run, _BLOCKS).unionByName(bad)


_BLOCKS = recordings.BLOCKS.replace("array<double>", "array<float>") + ", rate int, error string"
_BLOCK_NAMES = [c.split()[0] for c in _BLOCKS.split(", ")]
