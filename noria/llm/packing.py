"""Best-two-fit packing of documents into sequences of a fixed capacity.

Documents are encoded once, cut if they are too long, and packed by length: the plan needs only how
many pieces there are of each length, at most ``capacity`` counts however large the corpus is. The
plan fills a sequence greedily (longest piece that fits, again and again), then takes out its
smallest piece if two unpacked pieces fit the widened gap more tightly, and uses the same filling as
often as the counts allow. Each piece then finds its slot by its rank among the pieces of its length.
A piece's rank is its number within the task that cut it, plus the pieces of its length that tasks
before have, by a sum over one row per (task, length): no sort, and a length that half of the corpus shares is as
spread out as the tasks are. The driver sees at most ``capacity`` counts.

Null text is empty: its end id alone. A cut document's first piece is the shorter one. Repeated rows
are packed each; an empty table gives an empty result; very long texts are encoded whole, alone in their batch; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import by_size, encoder
from .tables import clean_input, stored
from .workers import tidy

#: Bytes of atoms that a worker remembers here, and bytes of text that it encodes at once: the pipeline's last stage comes when executors have grown.
MEMO_BYTES, BATCH_BYTES = 32 << 20, 1 << 20
#: task and number: the task that cut the piece, and how many of its length the task cut before.
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * (first > 0) + [(s, capacity) for s in range(first, n, capacity)]


def _cutter(path: str, end_id: int, capacity: int, with_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        coder.slots.most = MEMO_BYTES
        end, seen, task = np.array([end_id], "<u4"), [0] * (capacity + 1), TaskContext.get().partitionId()
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
        for batch in batches:
            for some in by_size(batch, 1, BATCH_BYTES):
                ids, offsets = coder.encode(some.column(1))
                ids, out = ids.astype("<u4"), []
                for k, doc in enumerate(some.column(0).to_pylist()):
                    raw = np.concatenate([ids[offsets[k] : offsets[k + 1]], end])
                    for i, (s, n) in enumerate(cut(len(raw), capacity)):
                        own = raw[s : s + n].tobytes()
                        out.append((doc, i, s, n, zlib.crc32(own), task, seen[n], own))
                        seen[n] += 1
                columns = list(zip(*out, strict=True)) if out else [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t, _ in zip(columns, types, names, strict=False)], names=names)

    return tidy(pieces, "encoder")


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece. with_ids: also the ids as little-endian unsigned 32-bit integers.

    (task, length, number) is a piece's key, so the rows of several calls can't be packed together.
    """
    return clean_input(docs, "doc_id", "text").mapInArrow(_cutter(tokenizer, end_id, capacity, with_ids), PIECES + ", ids binary" * with_ids)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Fillings and how often each is used. counts[n]: pieces of length n, 1 <= n <= capacity."""
    left, out = counts.astype(np.int64).copy(), []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return out
        filling, gap = [int(there[-1])], capacity - int(there[-1])
        left[filling[0]] -= 1
        while gap:
            fits = np.flatnonzero(left[: gap + 1])
            if not len(fits):
                break
            filling.append(int(fits[-1]))
            left[filling[-1]] -= 1
            gap -= filling[-1]
        if gap and len(filling) > 1:
            small = filling[-1]
            two = _best_two(left, gap + small)
            if two and sum(two) > small:
                left[small] += 1
                filling[-1:] = two
                for n in two:
                    left[n] -= 1
        # the same filling again, while its pieces last: greedy steps would choose it again
        sizes, each = np.unique(filling, return_counts=True)
        more = int((left[sizes] // each).min())
        left[sizes] -= more * each
        out.append((sorted(filling, reverse=True), 1 + more))


def _best_two(left: np.ndarray, room: int) -> list[int] | None:
    """The two unpacked lengths with the largest sum up to room."""
    sizes = np.flatnonzero(left[: room + 1])
    if not len(sizes):
        return None
    # for each a, the longest b <= min(a, room - a); b = a needs two of them
    k = np.searchsorted(sizes, np.minimum(sizes, room - sizes), "right") - 1
    alone = (k >= 0) & (sizes[np.maximum(k, 0)] == sizes) & (left[sizes] < 2)
    k = k - alone
    total = np.where(k >= 0, sizes + sizes[np.maximum(k, 0)], -1)
    best = int(total.argmax())
    return [int(sizes[best]), int(sizes[k[best]])] if total[best] > 0 else None


def slots(fillings: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset): piece of rank r goes to sequence + r - first rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for filling, times in fillings:
        offset = 0
        for n in filling:
            out.setdefault(n, []).append((used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def _placer(places: dict[int, np.ndarray], names: list[str]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            sizes, at = np.unique(length[order], return_index=True)
            for n, rows in zip(sizes.tolist(), np.split(order, at[1:]), strict=True):
                table = places[n]
                hit = np.searchsorted(table[:, 0], rank[rows], "right") - 1
                sequence[rows] = table[hit, 1] + rank[rows] - table[hit, 0]
                offset[rows] = table[hit, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return tidy(place)


def pack(cut_up: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to the rows of ``pieces``.

    Tasks get the plan's slots with their code: at most ``capacity`` lengths and a few fillings for each, whatever the corpus.
    The join with the sums by (task, length) is Spark's choice: broadcast while that table is below Spark's limit, else a shuffle.
    """
    cut_up = stored(cut_up, "pieces")
    per = stored(cut_up.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for row in per.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[row["length"]] = row["n"]
    places = slots(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task at most
    base = per.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut_up.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("number"))
    names = [c for c in cut_up.columns if c not in ("task", "number")]
    types = dict(cut_up.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in names) + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(_placer(places, names), schema)
