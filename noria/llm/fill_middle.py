"""Fill-in-the-middle transformation by a table-driven automaton over bytes.

Units are runs of ASCII letters and single other characters. One automaton reads each byte once: its state knows
whether a run of letters goes on and how much of a sentinel has been seen; a continuation byte of UTF-8 begins nothing.
Each transition emits whether a character begins, whether a unit begins and whether a sentinel ends; the transitions of a text,
counted, give its characters, its units and whether it holds a sentinel. A second pass over the emitted transitions
finds the bytes where the drawn units end.

The scan runs in lanes: a batch's texts, each behind a byte that no UTF-8 holds and that resets the automaton, are cut into lanes of
equal length that step together through the table. The state depends on the last few bytes only (as many as a sentinel has), so a
lane begins that many bytes early and needs nothing of its neighbour.

Draws are hashes of the seed and doc_id, so a task that runs again makes the same choice. Null text is empty and stays plain; so does
one that holds a sentinel, which couldn't be restored otherwise. A null doc_id draws by the seed alone. Repeated rows come out
alike. An empty table gives an empty result; very long texts are handled whole, alone in their batch; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .encoding import by_size, joined
from .tables import clean_input
from .workers import tidy

#: Before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: No byte of UTF-8: it parts texts.
RESET = 0xFF
BATCH_BYTES = 2 << 20
LANES = 2048
#: Bytes whose transitions are counted together.
COUNTED = 1 << 16
#: Flags of a transition.
CHARACTER, UNIT, SENTINEL = 1, 2, 4
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, text string"


class Automaton:
    """Tables of (state * 256 + byte): ``next`` state and ``emit`` flags. Sentinels are ASCII and none is part of another."""

    def __init__(self, sentinels: Sequence[str] = SENTINELS):
        whole = [s.encode("ascii") for s in sentinels]
        if not all(whole) or any(a in b for a in whole for b in whole if a is not b):
            raise ValueError("sentinels must not be empty or part of one another")
        seen = sorted({s[:k] for s in whole for k in range(len(s))}, key=lambda p: (len(p), p))
        states = [(p, run) for p in seen for run in (False, True)]
        number = {s: i for i, s in enumerate(states)}
        self.memory = max(map(len, whole))
        self.next, self.emit = np.zeros(len(states) * 256, np.int16), np.zeros(len(states) * 256, np.uint8)
        for (prefix, run), i in number.items():
            for byte in range(256):
                letter = chr(byte).isascii() and chr(byte).isalpha()
                read, flags = prefix + bytes([byte]), 0
                if byte != RESET and byte & 0xC0 != 0x80:
                    flags = CHARACTER | (UNIT if not (letter and run) else 0) | (SENTINEL if any(read.endswith(s) for s in whole) else 0)
                rest = next(read[k:] for k in range(len(read) + 1) if read[k:] in seen)
                self.next[i * 256 + byte], self.emit[i * 256 + byte] = number[rest, letter], flags

    def scan(self, data: np.ndarray) -> np.ndarray:
        """The flags of the transition at each byte, from the first state."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint8)
        steps = -(-n // LANES)
        lanes = -(-n // steps)
        early = self.memory
        padded = np.full(early + lanes * steps, RESET, np.uint8)
        padded[early : early + n] = data
        # row t holds byte t of every lane, which begins early
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, early + steps)[::steps].T)
        out, state = np.empty((steps, lanes), np.uint8), np.zeros(lanes, np.int64)
        after = self.next.astype(np.int64) * 256
        for t, row in enumerate(rows):
            state += row
            if t >= early:
                out[t - early] = self.emit[state]
            state = after[state]
        return out.T.reshape(-1)[:n]


def _counts(flags: np.ndarray, flag: int) -> list[int]:
    """Transitions with a flag in each run of COUNTED bytes."""
    return [int(np.count_nonzero(flags[k : k + COUNTED] & flag)) for k in range(0, len(flags), COUNTED)]


def _place(flags: np.ndarray, counts: list[int], nth: int) -> int:
    """Where the unit number ``nth`` (from 0) begins; the end if there are no more."""
    for k, n in enumerate(counts):
        if nth < n:
            return k * COUNTED + int(np.flatnonzero(flags[k * COUNTED : (k + 1) * COUNTED] & UNIT)[nth])
        nth -= n
    return len(flags)


def _draws(seed: int, doc: int | None) -> list[int]:
    text = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    return [int(text[k : k + 8], 16) for k in range(0, 32, 8)]


def _parted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(texts in UTF-8, each behind a RESET; where each begins, behind its RESET, and last the end plus one)."""
    data, offsets = joined(texts)
    at = offsets + np.arange(1, len(offsets) + 1)
    return np.insert(data, offsets[:-1], RESET), at


def _cut_all(auto: Automaton, batch: pa.RecordBatch, seed: int, rate: int, spm: int, marks: list[bytes]) -> list[tuple]:
    data, at = _parted(batch.column(1))
    flags = auto.scan(data)
    out = []
    for doc, begin, end in zip(batch.column(0).to_pylist(), at[:-1].tolist(), (at[1:] - 1).tolist(), strict=True):
        own = flags[begin:end]
        counts = _counts(own, UNIT)
        n = sum(counts)
        h1, h2, h3, h4 = _draws(seed, doc)
        if begin == end or h3 % 100 >= rate or sum(_counts(own, SENTINEL)):
            out.append((doc, n, "plain", None, None, data[begin:end].tobytes()))
            continue
        a, b = (_place(own, counts, c) for c in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = (data[begin + x : begin + y].tobytes() for x, y in ((0, a), (a, b), (b, end - begin)))
        form = "spm" if h4 % 100 < spm else "psm"
        parts = (marks[1], suffix, marks[0], prefix) if form == "spm" else (marks[0], prefix, marks[1], suffix)
        out.append((doc, n, form, sum(_counts(own[:a], CHARACTER)), sum(_counts(own[a:b], CHARACTER)), b"".join((*parts, marks[2], middle))))
    return out


def transform(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and text, the document with its middle moved to the end.

    rate: percent of documents that are transformed; spm: percent of these with the suffix first (form spm), the others have form psm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, marks = Automaton(sentinels), [s.encode() for s in sentinels]
        for batch in batches:
            for some in by_size(batch, 1, BATCH_BYTES):
                columns = list(zip(*_cut_all(auto, some, seed, rate, spm, marks), strict=True))
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                texts = pa.array(columns[5], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=False)), texts], names=[x.split()[0] for x in OUTPUT.split(", ")])

    return clean_input(docs, "doc_id", "text").mapInArrow(tidy(run), OUTPUT)


def restore(done: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """The rows of ``transform`` with restored, the text before it, read from form and text alone."""
    names = [x.split()[0] for x in OUTPUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, size = Automaton(sentinels), [len(s.encode()) for s in sentinels]
        for batch in batches:
            for some in by_size(batch, 5, BATCH_BYTES):
                data, at = _parted(some.column(5))
                ended = np.flatnonzero(auto.scan(data) & SENTINEL) + 1
                low = np.searchsorted(ended, at[:-1])
                back = []
                for k, form in enumerate(some.column(2).to_pylist()):
                    begin, end = int(at[k]), int(at[k + 1]) - 1
                    if form == "plain":
                        back.append(data[begin:end].tobytes())
                        continue
                    # the ends of the three sentinels: the second part ends where the third sentinel begins, and so on
                    e1, e2, e3 = ended[low[k] : low[k] + 3].tolist()
                    order = (1, 0) if form == "spm" else (0, 1)
                    parts = {order[0]: data[e1 : e2 - size[order[1]]], order[1]: data[e2 : e3 - size[2]], 2: data[e3:end]}
                    back.append(b"".join(parts[i].tobytes() for i in (0, 2, 1)))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(back, pa.binary()).cast(pa.string())], names=[*names, "restored"])

    return clean_input(done, *names).mapInArrow(tidy(run), OUTPUT + ", restored string")
