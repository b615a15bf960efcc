"""Unigram encoding over a double-array trie of pieces, and decoding.

Pieces and scores come from a SentencePiece model file. Viterbi finds the segmentation with the
largest sum of log scores; where no piece covers a character, its UTF-8 bytes are pieces (byte
fallback). A space is written as the marker U+2581, and one marker is put before the text; decoding
joins pieces and bytes, turns markers back into spaces and drops the first. A U+2581 of the text
itself is encoded as bytes, so every text comes back exactly.

A BPE model file has ranks in place of scores; they become log scores by Zipf's law, log(1 / (rank + 1)).
No piece of such files has a marker after another character, so a text's best segmentation is that
of its runs of markers with the word after each. A batch's distinct words are segmented together, one
place of all words after another, and remembered while the memo has room. Other files are segmented whole.

Null counts as empty: no pieces. An empty table gives an empty result; very long texts are handled whole, alone in
their batch; words of more than LONG bytes are segmented one by one. Repeated rows are encoded each; extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .encoding import by_size, joined
from .tables import clean_input
from .workers import Memo, held, tidy

MARK = "▁"
_RAW_MARK = MARK.encode()
#: Bytes of words that a worker remembers, with their pieces.
MEMO_BYTES = 48 << 20
#: Longest words, in bytes, that are segmented together, by group of lengths.
_GROUPS = (8, 12, 16, 24, 40, 64)
LONG = _GROUPS[-1]
#: A byte piece scores below every other piece.
BYTE_PENALTY = 10.0
_SIZE = np.array([1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4 for c in range(256)])


class DoubleArray:
    """A trie over bytes in two arrays: from s by byte c to base[s] + c + 1 if check there is s; value[s] >= 0 ends a key."""

    def __init__(self, keys: Sequence[tuple[bytes, int]]):
        keys = sorted(keys)
        size = 1 << 16
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        free, top, tries = 1, 1, 32
        stack = [(0, 0, len(keys), 0)]
        while stack:
            state, a, b, depth = stack.pop()
            if a < b and len(keys[a][0]) == depth:
                self.value[state] = keys[a][1]
                a += 1
            if a == b:
                continue
            groups, at = [], a
            while at < b:
                c, first = keys[at][0][depth], at
                while at < b and keys[at][0][depth] == c:
                    at += 1
                groups.append((c + 1, first, at))
            least = groups[0][0]
            while free < top and self.check[free] >= 0:
                free += 1
            # some places from the first free one on, else behind all that is used
            base = max(0, free - least)
            for base in range(base, base + tries):
                if base + 257 > len(self.check):
                    break
                if all(self.check[base + c] < 0 for c, _, _ in groups):
                    break
            else:
                base = max(base, top)
            if base + 257 > len(self.check) or any(self.check[base + c] >= 0 for c, _, _ in groups):
                base = max(base, top)
            while base + 258 > len(self.check):
                self.base += [0] * size
                self.check += [-1] * size
                self.value += [-1] * size
            self.base[state] = base
            for c, first, last in groups:
                self.check[base + c] = state
                top = max(top, base + c + 1)
                stack.append((base + c, first, last, depth + 1))
        self.base, self.check, self.value = (array("i", x) for x in (self.base, self.check, self.value))

    def prefixes(self, data: bytes, at: int) -> Iterator[tuple[int, int]]:
        """(end, value) of the keys that data has at a place."""
        base, check, value, s = self.base, self.check, self.value, 0
        for i in range(at, len(data)):
            t = base[s] + data[i] + 1
            if t >= len(check) or check[t] != s or t == 0:
                return
            s = t
            if value[s] >= 0:
                yield i + 1, value[s]


class Pieces:
    """pieces[i] with log score scores[i]; byte_ids[b] is the piece of byte b."""

    def __init__(self, pieces: Sequence[str], scores: Sequence[float], byte_ids: Sequence[int], usable: Sequence[bool]):
        self.pieces, self.scores, self.byte_ids = list(pieces), list(scores), list(byte_ids)
        used = [i for i, u in enumerate(usable) if u and self.pieces[i]]
        self.trie = DoubleArray([(self.pieces[i].encode(), i) for i in used])
        self.byte_score = min((self.scores[i] for i in used), default=0.0) - BYTE_PENALTY
        self.by_word = not any(MARK in self.pieces[i].lstrip(MARK) for i in used)
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        # what each piece decodes to, one after another
        told = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            told[i] = bytes([b])
        self.told, self.told_size = np.frombuffer(b"".join(told), np.uint8), np.array([len(t) for t in told], np.int64)
        self.told_start = np.cumsum(self.told_size) - self.told_size
        self.arrays = tuple(np.frombuffer(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value))
        self.score, self.byte_id = np.array(self.scores, np.float64), np.array(self.byte_ids, np.int32)
        self.words = Memo(MEMO_BYTES)
        self.start, self.size, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), bytearray()

    @classmethod
    def from_file(cls, path: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces, scores = [model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)]
        usable = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        ranks = [-scores[i] for i in range(n) if usable[i]]
        if ranks and all(r == int(r) and r >= 0 for r in ranks) and len(set(ranks)) == len(ranks):
            scores = [-math.log(1 - s) if u else s for s, u in zip(scores, usable, strict=True)]
        byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        return cls(pieces, scores, [byte_ids[b] for b in range(256)], usable)

    def segment(self, marked: bytes) -> tuple[int, ...]:
        """Viterbi over text in UTF-8 with markers; ties go to the longer last piece. A byte 0xFF stands for a literal U+2581."""
        n = len(marked)
        best, back = [-math.inf] * (n + 1), [(0, 0)] * (n + 1)
        best[0] = 0.0
        scores, base, check, value = self.scores, self.trie.base, self.trie.check, self.trie.value
        for i in range(n):
            here = best[i]
            if here == -math.inf:
                continue
            state = 0
            for at in range(i, n):  # as in DoubleArray.prefixes
                to = base[state] + marked[at] + 1
                if to >= len(check) or check[to] != state:
                    break
                state = to
                piece = value[state]
                if piece >= 0 and here + scores[piece] > best[at + 1]:
                    best[at + 1], back[at + 1] = here + scores[piece], (i, piece)
            lead = marked[i]
            size = 1 if lead < 0x80 or lead == 0xFF else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            s = here + self.byte_score * (3 if lead == 0xFF else size)
            if s > best[i + size]:
                best[i + size], back[i + size] = s, (i, -1)
        out: list[int] = []
        while n:
            i, piece = back[n]
            if piece >= 0:
                out.append(piece)
            else:
                raw = MARK.encode() if marked[i] == 0xFF else marked[i:n]
                out += [self.byte_ids[b] for b in reversed(raw)]
            n = i
        return tuple(reversed(out))

    def _marked(self, text: str) -> bytes:
        raw = text.encode()
        if MARK in text:
            raw = raw.replace(MARK.encode(), b"\xff")
        return raw.replace(b" ", MARK.encode())

    def encode(self, text: str | None) -> list[int]:
        """One text."""
        return list(self.segment(self._marked(" " + text))) if text else []

    def decode(self, ids: Sequence[int]) -> str:
        """One text."""
        data, _ = self.decode_batch(np.asarray(ids, np.int64), np.array([0, len(ids)]))
        return data.tobytes().decode(errors="replace")

    def segment_together(self, words: list[bytes]) -> list[bytes]:
        """As ``segment``, for marked words of at most LONG bytes without a literal U+2581; ids as 32-bit integers."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out: list[bytes] = [b""] * len(words)
        for low, up in zip((0, *_GROUPS[:-1]), _GROUPS, strict=True):
            of = np.flatnonzero((size > low) & (size <= up)).tolist()
            for k in range(0, len(of), 8_192):
                rows = of[k : k + 8_192]
                for i, ids in zip(rows, self._same_length([words[i] for i in rows], up), strict=True):
                    out[i] = ids
        return out

    def _same_length(self, words: list[bytes], most: int) -> list[bytes]:
        base, check, value = self.arrays
        n, size = len(words), np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(w.ljust(most, b"\0") for w in words), np.uint8).reshape(n, most)
        best, back, piece = np.full((n, most + 1), -np.inf), np.zeros((n, most + 1), np.int32), np.full((n, most + 1), -1, np.int32)
        best[:, 0] = 0.0

        def reach(rows: np.ndarray, to, s: np.ndarray, start: int, by) -> None:
            better = s > best[rows, to]
            rows, to, by = rows[better], to[better] if isinstance(to, np.ndarray) else to, by[better] if isinstance(by, np.ndarray) else by
            best[rows, to], back[rows, to], piece[rows, to] = s[better], start, by

        for i in range(most):
            every = np.flatnonzero((size > i) & (best[:, i] > -np.inf))
            if not len(every):
                continue
            rows, here, state = every, best[every, i], np.zeros(len(every), np.int64)
            for at in range(i, most):
                to = base[state] + text[rows, at] + 1
                on = (size[rows] > at) & (check[to] == state)
                rows, here, state = rows[on], here[on], to[on]
                if not len(rows):
                    break
                found = value[state]
                hit = found >= 0
                reach(rows[hit], at + 1, here[hit] + self.score[found[hit]], i, found[hit])
            step = _SIZE[text[every, i]]
            reach(every, i + step, best[every, i] + self.byte_score * step, i, -1)
        out, made = np.zeros((n, most), "<i4"), np.zeros(n, np.int64)
        at, left = size.copy(), np.zeros(n, np.int64)  # left: bytes of a character still to write
        live = np.arange(n)
        while len(live):
            place, raw = at[live], left[live] > 0
            by, start = piece[live, place], back[live, place]
            fresh = ~raw & (by < 0)
            left[live[fresh]] = (place - start)[fresh]
            raw |= fresh
            out[live, made[live]] = np.where(raw, self.byte_id[text[live, place - 1]], by)
            made[live] += 1
            at[live] = np.where(raw, place - 1, start)
            left[live] -= raw
            live = live[at[live] > 0]
        return [row[:m][::-1].tobytes() for row, m in zip(out, made.tolist(), strict=True)]

    def _found(self, distinct: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Where the ids of each distinct word lie, and the words that are new. Words begin with spaces."""
        find = self.words.known.get
        out = np.fromiter((find(w, -1) for w in distinct), np.int64, len(distinct))
        missing = np.flatnonzero(out < 0)
        if not len(missing):
            return out, []
        new = [distinct[i] for i in missing.tolist()]
        marked = [w.replace(b" ", _RAW_MARK) for w in new]
        odd = [len(m) > LONG or _RAW_MARK in w for w, m in zip(new, marked, strict=True)]
        quick = iter(self.segment_together([m for m, o in zip(marked, odd, strict=True) if not o]))
        encoded = [np.array(self.segment(self._marked(w.decode())), "<i4").tobytes() if o else next(quick) for w, o in zip(new, odd, strict=True)]
        n = len(self.words.known)
        while n + len(new) > len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        size = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        self.start[n : n + len(new)] = len(self.ids) // 4 + np.cumsum(size) - size
        self.size[n : n + len(new)] = size
        self.ids += b"".join(encoded)
        out[missing] = np.arange(n, n + len(new))
        return out, new

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text); null is empty."""
        data, offsets = joined(texts)
        full = np.diff(offsets) > 0
        if not self.by_word:
            parts = [np.array(self.encode(t), np.int32) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        # one space before each text that isn't empty
        data = np.insert(data, offsets[:-1][full], 0x20)
        offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        blank = data == 0x20
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[offsets[:-1][full]] = True
        first = np.flatnonzero(begins)
        coded = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.append(first, len(data))), pa.py_buffer(data)]).dictionary_encode()
        found, new = self._found(coded.dictionary.to_pylist())
        slot = found[np.asarray(coded.indices)]
        size = self.size[slot]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = np.frombuffer(bytes(self.ids), "<i4")[np.repeat(self.start[slot] - upto[:-1], size) + np.arange(upto[-1])]
        room = len(self.words.known)
        for word in new:
            if not self.words.add(word, room):
                del self.ids[int(self.start[room]) * 4 :]
                break
            room += 1
        return ids, upto[np.searchsorted(first, offsets)]

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, offsets by text)."""
        size = self.told_size[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        data = self.told[np.repeat(self.told_start[ids] - upto[:-1], size) + np.arange(upto[-1])]
        ends = upto[offsets]
        # the space that was put before the text
        lead = ends[:-1][ends[:-1] < ends[1:]]
        drop = lead[data[lead] == 0x20]
        return np.delete(data, drop), ends - np.searchsorted(drop, ends)


def loaded(path: str) -> Pieces:
    """This worker's pieces of a model file; a worker holds those of one."""
    known = held("pieces")
    if path not in known:
        known.clear()
        known[path] = Pieces.from_file(path)
    return known[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """key and ids (array of int) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path)
        for batch in batches:
            for some in by_size(batch, 1):
                ids, offsets = coder.encode_batch(some.column(1))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=[key, "ids"])

    rows = clean_input(docs, key, "text")
    return rows.mapInArrow(tidy(run, "pieces"), f"{key} {rows.schema[key].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """key and text of every row of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                parts = [np.zeros(0, np.int64) if x.values is None else np.asarray(x.values, np.int64) for x in some.column(1)]
                data, ends = coder.decode_batch(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
                texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    rows = clean_input(encoded, key, "ids")
    return rows.mapInArrow(tidy(run, "pieces"), f"{key} {rows.schema[key].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, n_bytes (byte pieces), ids_crc32 and whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path)
        is_byte = np.zeros(len(coder.pieces), bool)
        is_byte[coder.byte_ids] = True
        for batch in batches:
            for some in by_size(batch, 1):
                ids, offsets = coder.encode_batch(some.column(1))
                bytes_ = np.concatenate([[0], np.cumsum(is_byte[ids])])[offsets]
                (data, ends), (texts, wanted) = coder.decode_batch(ids, offsets), joined(some.column(1))
                raw, cuts = memoryview(ids.astype("<u4").tobytes()), offsets.tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                exact = [bool(np.array_equal(data[a:b], texts[c:d])) for a, b, c, d in zip(ends[:-1].tolist(), ends[1:].tolist(), wanted[:-1].tolist(), wanted[1:].tolist(), strict=True)]
                columns = [pa.array(np.diff(offsets)), pa.array(np.diff(bytes_)), pa.array(crc, pa.int64()), pa.array(exact, pa.bool_())]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], names=["doc_id", "n_pieces", "n_bytes", "ids_crc32", "exact"])

    return clean_input(docs, "doc_id", "text").mapInArrow(tidy(run, "pieces"), "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, exact boolean")
