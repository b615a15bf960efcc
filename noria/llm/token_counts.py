"""Token counts that follow edits.

A document is cut into leaves at the places where a pre-token starts whatever stands further off: a
single space or newline between two visible characters (a leaf is a word with its signs, as a rule). A
segment tree over the leaves, kept with the document, holds the characters and tokens of each
subtree. An edit finds its leaves by descending the tree and re-encodes only them and one neighbour on each
side, whose outer boundaries the edit can't change; then it updates the sums on the paths from these leaves to
the root. Nothing else of the tree is read or written.

``build`` makes the state of each document, ``edit`` applies edits to it and returns the new state, and
``count_edited`` does both in one pass. All edits of a document are applied in order by the task that has its
row, those of all documents of a batch in rounds, so that a round encodes once. Documents are independent, so
nothing but the edits is shuffled. An edit that makes more leaves than it found puts the rest into the last; a
later ``build`` cuts it anew.

Null text is empty, with one empty leaf. Edits of a null doc_id go to the rows without doc_id. Edits of unknown
documents are left out; places beyond the end are cut to it, a null place is 0, null new text is empty. Repeated rows are counted and
edited each; edits of equal seq are applied in order of place. An empty table gives an empty result; very long texts are handled whole, one at a
time; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import PieceEncoder, by_size, encoder, gaps, joined
from .tables import clean_input
from .workers import tidy

#: leaves: their number; chars and tokens: sums of the tree, level by level from the leaves to the root.
STATE = "doc_id long, text string, leaves int, chars array<int>, tokens array<int>"
_EDITED = STATE + ", n_tokens long, n_before long, n_encoded_chars long"


def levels(leaves: int) -> list[int]:
    """Where each level of a tree starts, and the end of the last: each has half the nodes of the one below."""
    out = [0, leaves]
    while leaves > 1:
        leaves = (leaves + 1) // 2
        out.append(out[-1] + leaves)
    return out


def tree(leaf_sums: np.ndarray) -> np.ndarray:
    """All sums of a tree, from those of its leaves (rows: characters, tokens)."""
    parts = [leaf_sums]
    while parts[-1].shape[1] > 1:
        parts.append(np.add.reduceat(parts[-1], np.arange(0, parts[-1].shape[1], 2), axis=1))
    return np.concatenate(parts, axis=1)


def cut_leaves(data: np.ndarray, offsets: np.ndarray, coder: PieceEncoder) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the leaves of texts in UTF-8, joined, as rows characters and tokens; the first leaf of each text). An empty text has one leaf."""
    at = gaps(data, offsets, coder.whole)
    starts = np.sort(np.concatenate([offsets[:-1], at]))
    first, size = coder.counts(data, offsets)
    tokens, chars = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ends = np.append(starts[1:], len(data))
    sums = np.stack([chars[ends] - chars[starts], tokens[np.searchsorted(first, ends)] - tokens[np.searchsorted(first, starts)]]).astype(np.int32)
    return sums, np.arange(len(offsets) - 1) + np.searchsorted(at, offsets[:-1])


class CountTree:
    """A document's text and its tree of (characters, tokens)."""

    def __init__(self, text: str, leaves: int, sums: np.ndarray):
        """sums: rows characters and tokens, as ``tree`` makes them; changed in place."""
        self.text, self.leaves, self.sums, self.at = text, leaves, sums, levels(leaves)
        self.encoded_chars = self.written = 0

    @property
    def total(self) -> int:
        return int(self.sums[1, -1])

    def find(self, place: int) -> tuple[int, int]:
        """(leaf, place where it starts) of a character; at or beyond the end, the last leaf."""
        node, before, chars = 0, 0, self.sums[0]
        for level in range(len(self.at) - 3, -1, -1):
            node *= 2
            left = int(chars[self.at[level] + node])
            if place >= before + left and node + 1 < self.at[level + 1] - self.at[level]:
                node, before = node + 1, before + left
        return node, before

    def region(self, start: int, stop: int, new: str) -> tuple[int, int, str]:
        """Apply an edit to the text: the first and last leaf to encode again, and what is their text now."""
        start = max(0, min(start, len(self.text)))
        stop = max(start, min(stop, len(self.text)))
        (a, begin), (b, last) = self.find(start), self.find(stop)
        size = self.sums[0]
        end = last + int(size[b])
        # one neighbour that isn't empty on each side: its outer boundary stays
        while a > 0:
            a -= 1
            begin -= int(size[a])
            if size[a]:
                break
        while b + 1 < self.leaves:
            b += 1
            end += int(size[b])
            if size[b]:
                break
        merged = self.text[begin:start] + new + self.text[stop:end]
        self.text = self.text[:begin] + merged + self.text[end:]
        self.encoded_chars += len(merged)
        return a, b, merged

    def put(self, a: int, b: int, parts: np.ndarray) -> None:
        """Give leaves a to b the sums of parts, and update the paths to the root."""
        room = b - a + 1
        if parts.shape[1] > room:
            parts = np.concatenate([parts[:, : room - 1], parts[:, room - 1 :].sum(axis=1, keepdims=True)], axis=1)
        self.sums[:, a : b + 1] = 0
        self.sums[:, a : a + parts.shape[1]] = parts
        self.written += room
        for level in range(len(self.at) - 2):
            a, b = a // 2, b // 2
            low, up = self.at[level], self.at[level + 1]
            own = self.sums[:, low + 2 * a : min(low + 2 * b + 2, up)]
            self.sums[:, up + a : up + b + 1] = np.add.reduceat(own, np.arange(0, own.shape[1], 2), axis=1)
            self.written += b - a + 1


def _apply(trees: list[CountTree], edits: list[list[dict]], coder: PieceEncoder) -> None:
    """The edits of each document in order; each round encodes what one edit of every document touches."""
    for k in range(max(map(len, edits), default=0)):
        rows = [i for i, e in enumerate(edits) if len(e) > k]
        touched = [trees[i].region(edits[i][k]["start"] or 0, edits[i][k]["stop"] or 0, edits[i][k]["new"] or "") for i in rows]
        sums, head = cut_leaves(*joined(pa.array([m for *_, m in touched], pa.large_string())), coder)
        for i, (a, b, _), low, up in zip(rows, touched, head.tolist(), [*head[1:].tolist(), sums.shape[1]], strict=True):
            trees[i].put(a, b, sums[:, low:up])


def _built(some: pa.RecordBatch, coder: PieceEncoder) -> list[CountTree]:
    """Trees of a batch whose second column is the text."""
    sums, head = cut_leaves(*joined(some.column(1)), coder)
    ends = [*head[1:].tolist(), sums.shape[1]]
    return [CountTree(t or "", up - low, tree(sums[:, low:up])) for t, low, up in zip(some.column(1).to_pylist(), head.tolist(), ends, strict=True)]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]), pa.int32()))


def _state(ids: pa.Array, trees: list[CountTree]) -> list[pa.Array]:
    return [ids, pa.array([t.text for t in trees], pa.string()), pa.array([t.leaves for t in trees], pa.int32()), _lists([t.sums[0] for t in trees]), _lists([t.sums[1] for t in trees])]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def build(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The STATE of each document; the last of ``tokens`` is its number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for some in by_size(batch, 1):
                yield pa.RecordBatch.from_arrays(_state(some.column(0), _built(some, coder)), names=_names(STATE))

    return clean_input(docs, "doc_id", "text").mapInArrow(tidy(run, "encoder"), STATE)


def edit(state: DataFrame, edits: DataFrame, tokenizer: str) -> DataFrame:
    """The state after edits (doc_id, seq, start, stop, new), with n_tokens, n_before and n_encoded_chars.

    start and stop are characters of the text as the edits before (by seq) left it.
    """
    wanted = clean_input(edits, "doc_id", "seq", "start", "stop", "new").groupBy(F.col("doc_id").alias("_edited")).agg(F.sort_array(F.collect_list(F.struct("seq", "start", "stop", "new"))).alias("edits"))
    rows = clean_input(state, *_names(STATE))
    rows = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["_edited"]), "left").select(*_names(STATE), "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for some in by_size(batch, 1):
                chars, tokens = ([np.asarray(x.values, np.int32) for x in some.column(c)] for c in (3, 4))
                trees = [CountTree(t or "", n, np.stack([a, b])) for t, n, a, b in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), chars, tokens, strict=True)]
                before = [t.total for t in trees]
                _apply(trees, [e or [] for e in some.column(5).to_pylist()], coder)
                extra = ([t.total for t in trees], before, [t.encoded_chars for t in trees])
                yield pa.RecordBatch.from_arrays([*_state(some.column(0), trees), *(pa.array(x, pa.int64()) for x in extra)], names=_names(_EDITED))

    return rows.mapInArrow(tidy(run, "encoder"), _EDITED)


def count_edited(docs: DataFrame, tokenizer: str, start, stop, new) -> DataFrame:
    """doc_id, n_before, n_tokens and n_encoded_chars of every document for one edit each, given by column expressions over ``docs``.

    As ``build`` and ``edit``, in one pass over the texts.
    """
    edits = F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), new.cast("string").alias("new"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for some in by_size(batch, 1):
                trees = _built(some, coder)
                before = [t.total for t in trees]
                _apply(trees, [[e] for e in some.column(2).to_pylist()], coder)
                columns = (before, [t.total for t in trees], [t.encoded_chars for t in trees])
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(x, pa.int64()) for x in columns)], names=["doc_id", "n_before", "n_tokens", "n_encoded_chars"])

    return docs.select("doc_id", "text", edits.alias("edit")).mapInArrow(tidy(run, "encoder"), "doc_id long, n_before long, n_tokens long, n_encoded_chars long")
