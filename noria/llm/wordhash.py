"""Words, lines and windows of whole Arrow string columns as NumPy arrays.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; these are ASCII, so cutting UTF-8 by bytes
is exact. A short range of bytes is hashed by mixing its bytes, a longer one by XXH3. Windows are
hashed by halves: a hash of 2n words is a mixed combination of two hashes of n words, so no
algebraic identity between texts carries over to hashes, as it does with polynomials modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are handled at once; one longer text is handled alone.
BLOCK = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeds(n: int, stream: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    with np.errstate(over="ignore"):
        return _mixed((np.arange(1, n + 1, dtype=_U) + _U(stream << 32)) * _U(0x9E3779B97F4A7C15))


#: Seed of the hashes of byte ranges, and of the second, independent ones.
_SEED, _CHECK_SEED = 0x6C62272E, 0x07BB0142
_LEFT, _RIGHT, _CHECK_LEFT, _CHECK_RIGHT = (_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))

#: Masks of the first 0 to 8 bytes of an integer.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], _U)


def blocks(texts: pa.Array | pa.ChunkedArray, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first row, bytes, offsets) of runs of rows with about ``size`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    upto = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))])
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(upto, upto[row] + size, "right")) - 1)
        to = min(to, len(texts), row + 50_000)
        part = pc.fill_null(texts.slice(row, to - row), "").cast(pa.large_string())
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        whole = part.buffers()[2]
        data = np.frombuffer(whole, np.uint8) if whole is not None and whole.size else np.zeros(0, np.uint8)
        yield row, data[offsets[0] : offsets[-1]], offsets - offsets[0]
        row = to


def spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of words, and each text's first word with the number of words last."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~breaks[data]
    full = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[full] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow array; they are in order and don't overlap."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    upto = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    kept = data[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(upto), pa.py_buffer(np.ascontiguousarray(kept))])


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, check: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte range; the ranges are in order and don't overlap. check: another, independent hash.

    Up to 16 bytes are mixed as two integers and the length; longer ranges are hashed by XXH3.
    """
    if not len(starts):
        return np.zeros(0, _U)
    seed, left, right = (_CHECK_SEED, _CHECK_LEFT, _CHECK_RIGHT) if check else (_SEED, _LEFT, _RIGHT)
    size = ends - starts
    eight = np.ndarray((len(data) + 9,), "<u8", np.concatenate([data, np.zeros(16, np.uint8)]), strides=(1,))
    low = eight[starts] & _FIRST[np.minimum(size, 8)]
    high = eight[starts + np.minimum(size, 8)] & _FIRST[np.clip(size - 8, 0, 8)]
    out = _mixed(_mixed(low + left) * right + _mixed(high + right) * left + size.astype(_U))
    long = np.flatnonzero(size > 16)
    if len(long):
        coded, of = ranges(data, starts[long], ends[long]).dictionary_encode(), xxhash.xxh3_64_intdigest
        own = np.fromiter((of(w, seed) for w in coded.dictionary.to_pylist()), _U, len(coded.dictionary))
        out[long] = own[np.asarray(coded.indices)]
    return out


def windows(words: np.ndarray, first: np.ndarray, k: int, check: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the windows of k words that lie within one text. check: another, independent hash."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + k <= last)
    left, right = (_CHECK_LEFT, _CHECK_RIGHT) if check else (_LEFT, _RIGHT)
    with np.errstate(over="ignore"):
        power, size, out, done = words, 1, None, 0
        while True:
            if k & size:  # what is left of the window, smallest part first
                part = power[done : done + n - k + 1]
                out = _mixed(part + left) if out is None else _mixed(out * left + _mixed(part * right + _U(size)))
                done += size
            if 2 * size > k:
                return at, out[at]
            power = _mixed(power[:-size] * left + _mixed(power[size:] * right + _U(size)))
            size *= 2


def owners(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text of each word position."""
    return np.searchsorted(first, at, "right") - 1


def sorted_within(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sort each text's values; first has the texts' offsets."""
    out = values.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    return out


def distinct_within(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in order, and their offsets."""
    out = sorted_within(values, first)
    if not len(out):
        return out, np.zeros(len(first), np.int64)
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[first[:-1][first[:-1] < first[1:]]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[first]


def folded(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of each text's sequence of values, in two halves; 0 for none."""
    raw, cuts = memoryview(np.ascontiguousarray(values).tobytes()), (8 * first).tolist()
    both = [xxhash.xxh3_128_intdigest(raw[a:b], _SEED) if a < b else 0 for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    half = (1 << 64) - 1
    return np.fromiter((x >> 64 for x in both), _U, len(both)), np.fromiter((x & half for x in both), _U, len(both))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
