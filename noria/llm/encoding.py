"""Whole-column encoding with the ``tokenizers`` library, each distinct atom of text once.

A text is cut into atoms whose ids, joined, are the text's ids. Cuts are made where both kinds of
tokenizer used here (byte-level BPE, which starts a pre-token at a space, and word BPE, which drops
white space) start a new pre-token whatever surrounds the place: at a single space or newline between two
visible characters, and, in runs of ASCII and Latin-1 text, where letters, digits and signs meet. What
lies between two such places and holds anything else (apostrophes, other scripts, several spaces, what may
start a special token) is one atom. Atoms repeat, so a batch's are dictionary-encoded, and each is
encoded once per batch or, while the memo has room, once per worker.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .workers import Memo, held

#: Bytes of atoms that a worker remembers.
MEMO_BYTES = 96 << 20
#: Bytes of text for one call of the library, whose results take many times as much.
CALL_BYTES = 1 << 16
_WORD = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+")
_JOINED = 200
#: Classes of bytes. A chunk of letters, digits and signs only is cut where they meet; others are whole.
_UNKNOWN, _LETTER, _DIGIT, _SIGN, _BLANK, _LINE, _WHOLE = range(7)
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = _LETTER
_CLASS[list(b"0123456789")] = _DIGIT
_CLASS[0x20], _CLASS[0x0A], _CLASS[ord("'")] = _BLANK, _LINE, _WHOLE
#: Second bytes, after 0xC3, of the letters of Latin-1.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
#: Lead bytes of characters that are neither white space nor combining Latin marks, by length.
_LEADS = {2: [*range(0xC4, 0xCC), *range(0xCE, 0xE0)], 3: [0xE0, *range(0xE4, 0xF0)], 4: [*range(0xF0, 0xF5)]}
_LEAD = np.zeros(256, np.uint8)
for _n, _leads in _LEADS.items():
    _LEAD[_leads] = _n


def _plain(kind: np.ndarray) -> np.ndarray:
    """Where letters, digits and signs are."""
    return (kind >= _LETTER) & (kind <= _SIGN)


def _kinds(data: np.ndarray, whole: bytes) -> np.ndarray:
    """The class of each byte."""
    classes, n = _CLASS, len(data)
    if whole:
        classes = _CLASS.copy()
        classes[list(whole)] = _WHOLE
    kind = classes.take(data)
    high = np.flatnonzero(data >= 0x80)
    byte = data[high]
    latin = high[byte == 0xC3]
    latin = latin[latin < n - 1]
    latin = latin[_LATIN[data[latin + 1]]]
    kind[latin], kind[latin + 1] = _LETTER, _LETTER
    lead = _LEAD[byte]
    for size in _LEADS:
        at = high[lead == size]
        for k in range(size):
            kind[np.minimum(at + k, n - 1)] = _WHOLE
    return kind


def _gaps(kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of single spaces and newlines between visible characters of one text."""
    gap, visible = (kind == _BLANK) | (kind == _LINE), _plain(kind) | (kind == _WHOLE)
    gap[1:] &= visible[:-1]
    gap[:-1] &= visible[1:]
    gap[offsets[offsets < len(kind)]] = False
    gap[offsets[offsets > 0] - 1] = False
    gap[-1] = False
    return np.flatnonzero(gap)


def gaps(data: np.ndarray, offsets: np.ndarray, whole: bytes = b"") -> np.ndarray:
    """Places in texts in UTF-8, joined, before which a token ends whatever stands further off."""
    return _gaps(_kinds(data, whole), offsets) if len(data) else np.zeros(0, np.int64)


def atoms(data: np.ndarray, offsets: np.ndarray, whole: bytes = b"") -> np.ndarray:
    """Starts of the atoms of texts in UTF-8, joined; offsets: where texts start and end. whole: bytes whose chunks aren't cut."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kinds(data, whole)
    gap = _gaps(kind, offsets)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[gap] = True
    cut[gap[kind[gap] == _LINE] + 1] = True
    starts = np.flatnonzero(cut[:n])
    plain = _plain(kind)
    plain[gap] = True
    mixed = np.zeros(len(starts), bool)
    mixed[np.searchsorted(starts, np.flatnonzero(~plain), "right") - 1] = True
    meet = (kind[1:] != kind[:-1]) & (kind[:-1] != _BLANK) & ~cut[1:n]
    meet = np.flatnonzero(meet) + 1
    cut[meet[~mixed[np.searchsorted(starts, meet, "right") - 1]]] = True
    return np.flatnonzero(cut[:n])


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets by text); null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _values(strings: pa.Array) -> list[bytes]:
    """As to_pylist() of large binary values without nulls, by slices of their joined bytes."""
    if not len(strings):
        return []
    at = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1].tolist()
    raw = strings.buffers()[2].to_pybytes()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


class PieceEncoder:
    """Encodes Arrow string columns. path: a file of the tokenizers library, with BPE of either kind."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        ends = self.tokenizer.model.end_of_word_suffix
        #: byte-level BPE marks a word's start, by its space; word BPE marks a word's end
        self.spaced = not ends
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.edge[i] = token.startswith("Ġ") if self.spaced else token.endswith(ends)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(set(t) & set(" \n") for t in special):
            raise ValueError("a special token with a space in it may cross atoms")
        self.whole = bytes({t.encode()[0] for t in special if t})
        self.slots = Memo(MEMO_BYTES)
        self.start, self.size, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), bytearray()

    def _encode_each(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for some in _calls(texts):
            out += [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """As _encode_each, for single words after a space: many in one text, cut at the tokens that begin or end a word."""
        joined = [words[i : i + _JOINED] for i in range(0, len(words), _JOINED)]
        out: list[bytes] = []
        for part in joined:
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            at = np.flatnonzero(self.edge[ids])
            cuts = np.append(at, len(ids)) if self.spaced else np.concatenate([[0], at + 1])
            if len(cuts) != len(part) + 1 or cuts[0] != 0 or cuts[-1] != len(ids):
                out += self._encode_each(part)
                continue
            raw, w = ids.tobytes(), self.dtype.itemsize
            cuts = (cuts * w).tolist()
            out += [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def _slots_of(self, distinct: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Where the ids of each distinct atom lie, and the atoms that are new."""
        out = np.fromiter(map(self.slots.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(out < 0)
        if not len(missing):
            return out, []
        new = [distinct[i] for i in missing.tolist()]
        texts = [p.decode() for p in new]
        word = np.fromiter((_WORD.fullmatch(t) is not None for t in texts), bool, len(texts))
        encoded: list[bytes] = [b""] * len(texts)
        for encode, which in ((self._encode_words, np.flatnonzero(word).tolist()), (self._encode_each, np.flatnonzero(~word).tolist())):
            for i, ids in zip(which, encode([texts[i] for i in which]), strict=True):
                encoded[i] = ids
        n, w = len(self.slots.known), self.dtype.itemsize
        while n + len(new) > len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        size = np.fromiter(map(len, encoded), np.int64, len(encoded)) // w
        self.start[n : n + len(new)] = len(self.ids) // w + np.cumsum(size) - size
        self.size[n : n + len(new)] = size
        self.ids += b"".join(encoded)
        out[missing] = np.arange(n, n + len(new))
        return out, new

    def _sought(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(starts of atoms, the slot of each, atoms that are new)."""
        first = atoms(data, offsets, self.whole)
        raw = pa.py_buffer(np.ascontiguousarray(data))
        coded = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.append(first, len(data))), raw]).dictionary_encode()
        found, new = self._slots_of(_values(coded.dictionary))
        return first, found[np.asarray(coded.indices)], new

    def _remember(self, new: list[bytes]) -> None:
        """Keep the new atoms that the memo has room for; the others were known to this batch only."""
        room = len(self.slots.known)
        for atom in new:
            if not self.slots.add(atom, room):
                del self.ids[int(self.start[room]) * self.dtype.itemsize :]
                return
            room += 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text); null is empty."""
        data, offsets = joined(texts)
        first, slot, new = self._sought(data, offsets)
        size = self.size[slot]
        upto = np.concatenate([[0], np.cumsum(size)])
        known = np.frombuffer(bytes(self.ids), self.dtype)
        ids = known[np.repeat(self.start[slot] - upto[:-1], size) + np.arange(upto[-1])]
        self._remember(new)
        return ids, upto[np.searchsorted(first, offsets)]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts of the atoms of texts in UTF-8, joined; the number of ids of each)."""
        first, slot, new = self._sought(data, offsets)
        size = self.size[slot]
        self._remember(new)
        return first, size


def _calls(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about CALL_BYTES characters."""
    some, held = [], 0
    for t in texts:
        some.append(t)
        held += len(t)
        if held >= CALL_BYTES:
            yield some
            some, held = [], 0
    if some:
        yield some


def by_size(batch: pa.RecordBatch, column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes of text; one longer text is alone."""
    length = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    upto, at = np.concatenate([[0], np.cumsum(length)]), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a tokenizer file; a worker holds one."""
    known = held("encoder")
    if path not in known:
        known.clear()
        known[path] = PieceEncoder(path)
    return known[path]
