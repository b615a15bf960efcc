"""Byte-level BPE by forced boundaries.

A byte pair that occurs inside no token of the vocabulary can't be inside a token of any text, so
that between two such bytes a token ends for certain. Texts are cut there, the fragments are encoded
independently by the ``tokenizers`` library (each distinct one once per batch, or once per worker while the
memo has room), and their ids are joined. The table of pairs is 65,536 flags made from the vocabulary file;
added tokens, which the library finds in texts before anything else, count as tokens, so none is cut.

The library also splits texts into pre-tokens by a pattern, which must see in a fragment what it sees in the
whole text. Its classes go by single characters but for two rules. White space: a run before something visible
leaves its last character to the next pre-token; so no cut is made after white space. Contractions: ``'s``, ``'ll``
and the like; so none is made before or after an apostrophe. Nor is one made inside a character. What isn't cut
is merely a longer fragment.

Decoding joins the bytes of the ids and reads them as UTF-8, bytes that aren't become U+FFFD, as the library does.

Null text is empty, with no ids, as is a null list of ids. Repeated rows are handled each, and a null doc_id stays null. An empty table gives an
empty result; very long texts are encoded whole, alone in their batch; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .encoding import by_size
from .fragments import FragmentEncoder, TokenBytes, starts_of
from .tables import clean_input
from .workers import held, tidy

#: Bytes of fragments that a worker remembers.
MEMO_BYTES = 64 << 20
#: Bytes of text encoded at once.
BATCH_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: First bytes of characters that may be white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def forced_pairs(tokens: list[bytes]) -> np.ndarray:
    """For each pair of bytes (first * 256 + second) whether no token holds it."""
    never = np.ones(1 << 16, bool)
    for token in tokens:
        raw = np.frombuffer(token, np.uint8).astype(np.uint16)
        never[raw[:-1] * 256 + raw[1:]] = False
    return never


def forced_cuts(data: np.ndarray, offsets: np.ndarray, never: np.ndarray) -> np.ndarray:
    """Starts of the fragments of texts in UTF-8, joined."""
    left, right = data[:-1], data[1:]
    cut = never[(left.astype(np.uint16) << 8) | right]
    cut &= ~_SPACE[left] & (left != 0x27) & (right != 0x27) & ((right & 0xC0) != 0x80)
    for back in (2, 3):  # the character before may be white space of two or three bytes
        if len(data) > back:
            cut[back - 1 :] &= ~(_MAYBE_SPACE[data[: -back]] & (left[back - 1 :] >= 0x80))
    return np.union1d(np.flatnonzero(cut) + 1, starts_of(offsets))


class ForcedEncoder(FragmentEncoder):
    """path: a byte-level BPE of the tokenizers library, its truncation and padding unused."""

    def __init__(self, path: str):
        super().__init__(path, MEMO_BYTES)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bytes = TokenBytes.of_byte_level(self.tokenizer)
        size, start = self.bytes.size.tolist(), self.bytes.start.tolist()
        whole = self.bytes.blob.tobytes()
        self.never = forced_pairs([whole[a : a + n] for a, n in zip(start, size, strict=True)])

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return forced_cuts(data, offsets, self.never)


def _coder(path: str) -> ForcedEncoder:
    known = held("forced")
    if path not in known:
        known.clear()
        known[path] = ForcedEncoder(path)
    return known[path]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (array of int) of every document's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer)
        for batch in batches:
            for some in by_size(batch, 1, BATCH_BYTES):
                ids, offsets = coder.encode(some.column(1))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([some.column(0), lists], names=["doc_id", "ids"])

    return clean_input(docs, "doc_id", "text").mapInArrow(tidy(run, "forced"), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids with the text that they spell; null ids spell an empty text. An id beyond the vocabulary is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _coder(tokenizer).bytes
        for batch in batches:
            lists = batch.column(1)
            per = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            ids = np.asarray(lists.flatten(), np.int64)
            data, upto = table.gather(ids), np.concatenate([[0], np.cumsum(table.size[ids])])
            ends = upto[np.cumsum(per)].tolist()
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return clean_input(encoded, "doc_id", "ids").mapInArrow(tidy(run, "forced"), "doc_id long, ids array<int>, text string")
