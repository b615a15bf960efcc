"""Encoders whose texts are cut by rules of their own, and the bytes of token ids.

``FragmentEncoder`` is a ``PieceEncoder`` (distinct fragments are encoded once per batch, or once per
worker while its memo has room) that leaves the cuts to its subclasses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .encoding import PieceEncoder
from .workers import Memo

#: Ids gathered at once.
GATHER = 1 << 20


def letters_to_bytes() -> dict[str, int]:
    """The alphabet of byte-level BPE: bytes with a visible Latin-1 character stand for themselves, the others follow from 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(others)}


class TokenBytes:
    """The bytes of each id of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    @classmethod
    def of_byte_level(cls, tokenizer) -> TokenBytes:
        """Of a byte-level tokenizer; added tokens are their own text."""
        alphabet, added = letters_to_bytes(), tokenizer.get_added_tokens_decoder()
        out = [b""] * tokenizer.get_vocab_size()
        for token, i in tokenizer.get_vocab().items():
            out[i] = token.encode() if i in added else bytes(alphabet[c] for c in token)
        return cls(out)

    def gather(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, joined."""
        out, at = np.empty(int(self.size[ids].sum()), np.uint8), 0
        for k in range(0, len(ids), GATHER):
            some = ids[k : k + GATHER]
            size = self.size[some]
            upto = np.cumsum(size)
            n = int(upto[-1])
            out[at : at + n] = self.blob[np.repeat(self.start[some] - upto + size, size) + np.arange(n)]
            at += n
        return out


class FragmentEncoder(PieceEncoder):
    """memo: bytes of fragments that a worker remembers."""

    def __init__(self, path: str, memo: int):
        super().__init__(path)
        self.slots = Memo(memo)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the fragments of texts in UTF-8, joined, each text's own start among them unless it is empty."""
        raise NotImplementedError

    def _encode_words(self, words: list[str]) -> list[bytes]:
        return self._encode_each(words)

    def _sought(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        first = self.cuts(data, offsets) if len(data) else np.zeros(0, np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.append(first, len(data))), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        found, new = self._slots_of(coded.dictionary.to_pylist())
        return first, found[np.asarray(coded.indices)], new


def starts_of(offsets: np.ndarray) -> np.ndarray:
    """Where texts that aren't empty start."""
    return offsets[:-1][offsets[1:] > offsets[:-1]]
