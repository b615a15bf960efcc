"""Token ids in one compressed file per shard: a wavelet matrix with rank and select.

A shard is a run of documents in ascending doc_id order. Its ids are kept as one bit-plane per bit,
highest first; after each plane the ids are parted, zeros before ones, keeping their order. Rank
directories over blocks of 512 bits give, from the compressed file alone, the id at a place (access),
how often an id occurs in a range (count) and where (occurrences), each in one step per plane. Planes are
compressed in chunks, so a lookup opens only the chunks that it touches.

Null text is empty: the end id alone. Null doc_ids come first. Repeated doc_ids are written each,
ordered by text hash; equal rows in any order. Very long texts are encoded whole and have a shard of their own. An empty table writes no shard. Extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import by_size, encoder
from .tables import clean_input
from .workers import tidy

MAGIC = b"WVM1"
BLOCK_BITS = 512
CHUNK_BYTES = 1 << 15
#: Bits of a plane that are parted at once; their places stay in the processor's cache.
RUN_BITS = 1 << 16
#: Ids at which a shard is closed; a longer document has a shard of its own.
SHARD_IDS = 1 << 21


def _sides(ones: np.ndarray, zeros: int) -> Iterator[tuple[slice, np.ndarray, slice, np.ndarray, slice]]:
    """For each run of a plane's bits: where it is, its zeros and where they go when parted, its ones and where they go.

    Places in short runs instead of masks over the plane: masks take several times as long on bits without a pattern.
    """
    low, high = 0, zeros
    for i in range(0, len(ones), RUN_BITS):
        run = ones[i : i + RUN_BITS]
        zero, one = np.flatnonzero(~run), np.flatnonzero(run)
        yield slice(i, i + len(run)), zero, slice(low, low + len(zero)), one, slice(high, high + len(one))
        low, high = low + len(zero), high + len(one)


class WaveletMatrix:
    """A sequence of unsigned integers below 2**bits."""

    def __init__(self, n: int, bits: int, zeros: list[int], ranks: list[np.ndarray], chunks: list[list[bytes]]):
        self.n, self.bits, self.zeros, self.ranks, self.chunks = n, bits, zeros, ranks, chunks
        self._open: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        pack = zstandard.ZstdCompressor(level=1)
        n, zeros, ranks, chunks = len(values), [], [], []
        spare = np.empty_like(values), np.empty_like(values)
        for b in range(bits - 1, -1, -1):
            ones = ((values >> values.dtype.type(b)) & values.dtype.type(1)).astype(bool)
            raw = np.packbits(ones, bitorder="little").tobytes()
            blocks = np.zeros(-(-n // BLOCK_BITS) * BLOCK_BITS // 8, np.uint8)
            blocks[: len(raw)] = np.frombuffer(raw, np.uint8)
            per = np.bitwise_count(blocks.view("<u8")).reshape(-1, BLOCK_BITS // 64).sum(axis=1, dtype=np.uint32)
            ranks.append(np.concatenate([[0], np.cumsum(per)]).astype(np.uint32))
            chunks.append([pack.compress(raw[i : i + CHUNK_BYTES]) for i in range(0, len(raw), CHUNK_BYTES)])
            zeros.append(int(n - ranks[-1][-1]))
            if not b:
                break
            parted = spare[b % 2]
            for here, zero, low, one, high in _sides(ones, zeros[-1]):
                values[here].take(zero, out=parted[low], mode="clip")
                values[here].take(one, out=parted[high], mode="clip")
            values = parted
        return cls(n, bits, zeros, ranks, chunks)

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1)
        out = [MAGIC, struct.pack("<QI", self.n, self.bits)]
        for zeros, rank, parts in zip(self.zeros, self.ranks, self.chunks, strict=True):
            directory = pack.compress(np.diff(rank.astype(np.int64)).astype("<u2").tobytes())
            out.append(struct.pack(f"<QII{len(parts)}I", zeros, len(directory), len(parts), *map(len, parts)))
            out += [directory, *parts]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, bits = struct.unpack_from("<QI", blob, 4)
        at, zeros, ranks, chunks = 16, [], [], []
        for _ in range(bits):
            zero, size, parts = struct.unpack_from("<QII", blob, at)
            sizes = struct.unpack_from(f"<{parts}I", blob, at + 16)
            at += 16 + 4 * parts
            per = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at : at + size]), "<u2")
            at += size
            zeros.append(zero)
            ranks.append(np.concatenate([[0], np.cumsum(per, dtype=np.int64)]).astype(np.uint32))
            chunks.append([])
            for s in sizes:
                chunks[-1].append(blob[at : at + s])
                at += s
        return cls(n, bits, zeros, ranks, chunks)

    def _chunk(self, plane: int, k: int) -> np.ndarray:
        if (plane, k) not in self._open:
            if len(self._open) > 64:
                self._open.clear()
            self._open[plane, k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.chunks[plane][k]), np.uint8)
        return self._open[plane, k]

    def _bit(self, plane: int, i: int) -> int:
        byte = i >> 3
        return int(self._chunk(plane, byte // CHUNK_BYTES)[byte % CHUNK_BYTES]) >> (i & 7) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones before place i."""
        block = i // BLOCK_BITS
        a, b = block * BLOCK_BITS >> 3, (i + 7) >> 3
        total = int(self.ranks[plane][block])
        if i % BLOCK_BITS:
            k = a // CHUNK_BYTES  # a chunk holds whole blocks
            part = np.unpackbits(self._chunk(plane, k)[a % CHUNK_BYTES : (b - 1) % CHUNK_BYTES + 1], bitorder="little")
            total += int(part[: i - block * BLOCK_BITS].sum())
        return total

    def __len__(self) -> int:
        return self.n

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.bits):
            bit = self._bit(p, i)
            value = value << 1 | bit
            i = self.zeros[p] + self._ones(p, i) if bit else i - self._ones(p, i)
        return value

    def _down(self, value: int, i: int) -> int:
        for p in range(self.bits):
            i = self.zeros[p] + self._ones(p, i) if value >> (self.bits - 1 - p) & 1 else i - self._ones(p, i)
        return i

    def count(self, value: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of value in [start, stop)."""
        if value >> self.bits:
            return 0
        return self._down(value, self.n if stop is None else stop) - self._down(value, start)

    def rank(self, value: int, i: int) -> int:
        return self.count(value, 0, i)

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence (from 0)."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        i = self._down(value, 0) + k
        for p in range(self.bits - 1, -1, -1):
            i = self._place(p, i - self.zeros[p], 1) if value >> (self.bits - 1 - p) & 1 else self._place(p, i, 0)
        return i

    def _place(self, plane: int, k: int, bit: int) -> int:
        """The place of the k-th such bit."""
        rank = self.ranks[plane].astype(np.int64)
        if not bit:
            rank = np.minimum(np.arange(len(rank)) * BLOCK_BITS, self.n) - rank
        block = int(np.searchsorted(rank, k, "right")) - 1
        a = block * BLOCK_BITS >> 3
        bits = np.unpackbits(self._chunk(plane, a // CHUNK_BYTES)[a % CHUNK_BYTES : a % CHUNK_BYTES + BLOCK_BITS // 8], bitorder="little")
        return block * BLOCK_BITS + int(np.flatnonzero(bits[: self.n - block * BLOCK_BITS] == bit)[k - int(rank[block])])

    def occurrences(self, value: int) -> Iterator[int]:
        return (self.select(value, k) for k in range(self.count(value)))

    def decode(self, dtype: np.dtype) -> np.ndarray:
        """All values, plane by plane from the last."""
        values, up = np.zeros(self.n, dtype), np.empty(self.n, dtype)
        unpack = zstandard.ZstdDecompressor()
        for p in range(self.bits - 1, -1, -1):
            plane = np.frombuffer(b"".join(unpack.decompress(c) for c in self.chunks[p]), np.uint8)
            ones = np.unpackbits(plane, count=self.n, bitorder="little").astype(bool)
            bit = dtype.type(1 << (self.bits - 1 - p))
            for here, zero, low, one, high in _sides(ones, self.zeros[p]):
                run = up[here]
                run[zero], run[one] = values[low], values[high] | bit
            values, up = up, values
        return values


SHARDS = "part int, seq int, n_ids long, doc_ids array<long>, lengths array<long>, matrix binary"
_DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _shard(part: int, seq: int, rows: list[tuple], bits: int) -> pa.RecordBatch:
    ids = np.concatenate([x for _, x in rows])
    blob = WaveletMatrix.build(ids, bits).to_bytes()
    columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([[d for d, _ in rows]], pa.list_(pa.int64())), pa.array([[len(x) for _, x in rows]], pa.list_(pa.int64())), pa.array([blob], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "seq", "n_ids", "doc_ids", "lengths", "matrix"])


def _writer(path: str, end_id: int, shard_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        bits = max(len(coder.edge) - 1, end_id).bit_length()
        end = np.array([end_id], coder.dtype)
        part, seq, rows, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for some in by_size(batch, 1):
                ids, offsets = coder.encode(some.column(1))
                for k, doc in enumerate(some.column(0).to_pylist()):
                    rows.append((doc, np.concatenate([ids[offsets[k] : offsets[k + 1]], end])))
                    held += len(rows[-1][1])
                    if held >= shard_ids:
                        yield _shard(part, seq, rows, bits)
                        seq, rows, held = seq + 1, [], 0
        if rows:
            yield _shard(part, seq, rows, bits)

    return tidy(write, "encoder")


def write_shards(docs: DataFrame, tokenizer: str, to: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Encode all texts and write their shards below ``to``, in ascending doc_id order by (part, seq).

    One range shuffle of the texts; a document's own row is never split, and each task holds one shard.
    """
    ordered = clean_input(docs, "doc_id", "text").withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(_writer(tokenizer, end_id, shard_ids), SHARDS).write.parquet(to)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``start``, the ids of all shards before.

    The running sum is taken in two steps, so no task sees more than the parts or one part's shards.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("size"))
    parts = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))
    within = shards.select("part", "seq", "n_ids").withColumn("before", F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids"))
    starts = within.join(parts, "part").select("part", "seq", (F.col("base") + F.col("before")).alias("start"))
    return shards.join(starts, ["part", "seq"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            matrix = WaveletMatrix.from_bytes(row["matrix"])
            ids = matrix.decode(np.dtype("<u2" if matrix.bits <= 16 else "<u4")).astype("<u4")
            raw, sizes = memoryview(ids.tobytes()), np.array(row["lengths"], np.int64)
            upto = np.concatenate([[0], np.cumsum(sizes)])
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(upto[:-1] + row["start"]), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shards' ids."""
    return shards.select("start", "doc_ids", "lengths", "matrix").mapInArrow(tidy(_read), _DOCUMENTS)
