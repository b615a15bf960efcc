"""The costly text rules over batches of whole texts.

As chains of regular expressions these rules take the JVM microseconds a character: its classes of Arabic letters are
tested range by range, once for each rule. Here a slice of texts is one array of code points; one table gives each its
sign in an alphabet of single bytes, where Python's own functions and short patterns do the rest for all texts at once.
"""

from __future__ import annotations

import codecs
import ctypes
import functools
import re
import unicodedata
from collections.abc import Callable, Container, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import alphabet as A

#: Characters of the texts that are worked on at once; a longer text stands alone.
SLICE = 1 << 20
_ALL = 0x110000

# The alphabet of single bytes: white space and all that becomes a space, marks of sentences and clauses, letters from
# 0x80 on, marks from 0xC0 on; a line feed ends each text.
_DROP, _DIGIT, _END, _SPACE, _STOP, _COMMA, _LETTER, _MARK = 0, 1, 10, 32, 46, 44, 0x80, 0xC0
_SIGN = {c: _LETTER + i for i, c in enumerate(A.LETTERS)} | {c: _MARK + i for i, c in enumerate(A.MARKS)}
_READ = "".join({v: k for k, v in _SIGN.items()}.get(b, chr(b)) for b in range(256))
_MARKER, _SHADDA, _TA = _SIGN[A.MARKER], _SIGN[A.SHADDA], _SIGN[A.TA_MARBUTA]
_NO_SHADDA = [_SIGN[c] for c in A.NO_SHADDA]
_AS_SPACE = bytes.maketrans(bytes([_DIGIT]), b" ")


@functools.cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return None


def give_back() -> None:
    """Return freed memory to the system: workers wait for later tasks beside those of other steps."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim:
        trim(0)


def sliced(f: Callable[..., list], texts: list, *args) -> list:
    """f(texts, *args) by slices of about SLICE characters; nulls stay null and don't reach f."""
    out, asked, n = [None] * len(texts), [], 0

    def done() -> None:
        for i, y in zip(asked, f([texts[i] for i in asked], *args), strict=True):
            out[i] = y

    for i, t in enumerate(texts):
        if t is not None:
            if asked and n + len(t) > SLICE:
                done()
                asked, n = [], 0
            asked.append(i)
            n += len(t)
    if asked:
        done()
    give_back()
    return out


def pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch of rows in pieces of about two slices of bytes, for functions that remember the words of a piece."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)) // (2 * SLICE)
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if a < b)


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _bounds(texts: list[str]) -> list[int]:
    out = [0]
    for t in texts:
        out.append(out[-1] + len(t))
    return out


def _parts(whole, bounds: list[int]) -> Iterator:
    return (whole[a:b] for a, b in zip(bounds, bounds[1:]))


@functools.cache
def _exchange(old: str, new: str) -> np.ndarray:
    table = np.arange(_ALL, dtype=np.uint32)
    for a, b in zip(reversed(old), reversed(new), strict=True):
        table[ord(a)] = ord(b)
    return table


def exchanged(texts: list[str], old: str, new: str) -> list[str]:
    """Texts with each character of ``old`` as that of ``new`` at its place, as ``translate`` does; both are of one length."""
    out = _exchange(old, new)[_codes(texts)].tobytes().decode("utf-32-le", "surrogatepass")
    return list(_parts(out, _bounds(texts)))


@functools.cache
def _unified() -> np.ndarray:
    """What unifying makes of each code point; _ALL for what goes."""
    table = np.arange(_ALL, dtype=np.uint32)
    for a, b in zip(A.ARABIC_DIGITS + A.PERSIAN_DIGITS + A.LETTER_FROM + A.EGYPTIAN_SIGN, "0123456789" * 2 + A.LETTER_TO + A.MARKER, strict=True):
        table[ord(a)] = ord(b)
    for c in A.INVISIBLE + A.TATWEEL:
        table[ord(c)] = _ALL
    return table


@functools.cache
def _signs() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, unified: its sign, and whether cleaning drops it though it is no space, known sign or punctuation."""
    signs, foreign = np.full(_ALL + 1, _SPACE, np.uint8), np.ones(_ALL + 1, bool)
    for c in (*range(0x20000), *range(0xE0000, 0xE1000)):  # marks, digits, punctuation and white space are in these planes only
        kind = unicodedata.category(chr(c))
        if kind == "Mn":
            signs[c] = _DROP
        elif kind == "Nd":
            signs[c] = _DIGIT
        foreign[c] = kind != "Mn" and kind[0] != "P" and not chr(c).isspace()
    for chars, sign in ((A.SENTENCE_END, _STOP), (A.CLAUSE, _COMMA)):
        signs[[ord(c) for c in chars]] = sign
    for c, sign in _SIGN.items():
        signs[ord(c)] = sign
    signs[_ALL] = _DROP
    foreign[_ALL] = False
    foreign[[ord(c) for c in A.LETTERS + A.MARKS + A.SENTENCE_END + A.CLAUSE + A.SILENT]] = False
    return signs[_unified()], foreign[_unified()]


def _runs(at: np.ndarray) -> np.ndarray:
    """Where in ``at``, ascending places after the first, runs of neighbours begin."""
    return np.flatnonzero(np.diff(at, prepend=-1) > 1)


def _mark(signs: np.ndarray) -> None:
    """Marks in canonical order on letters, [~][shadda][last vowel] as far as the letter takes them; what goes is set to _DROP."""
    at = np.flatnonzero(signs >= _MARK)
    if not len(at):
        return
    begin, mark = _runs(at), signs[at]
    place = at[begin]
    letter = signs[place - 1]
    marker, shadda = (np.maximum.reduceat(mark == m, begin) for m in (_MARKER, _SHADDA))
    vowel = np.maximum.reduceat(np.where(mark < _SHADDA, np.arange(len(at)), -1), begin)
    signs[at] = _DROP
    for there, sign in ((marker & (letter != _TA), np.full(len(begin), _MARKER)), (shadda & ~np.isin(letter, _NO_SHADDA), np.full(len(begin), _SHADDA)), (vowel >= 0, mark[vowel])):
        there &= letter >= _LETTER
        signs[place[there]] = sign[there]
        place += there


def _tidy(signs: np.ndarray) -> np.ndarray:
    """Texts in signs, each between line feeds, in single spaces; of punctuation marks in a row one stays, a stop before a comma, right after a word."""
    stays = np.ones(len(signs), bool)
    stays[:-1] = (signs[:-1] != _SPACE) | (signs[1:] >= _LETTER)
    signs = signs[stays]  # each space is before a word
    stays = np.ones(len(signs), bool)
    start = np.flatnonzero(signs[:-1] == _END) + 1
    stays[start] = signs[start] != _SPACE
    at = np.flatnonzero((signs == _STOP) | (signs == _COMMA))
    if len(at):
        begin = _runs(at)
        stays[at] = False
        first, after = at[begin], at[np.append(begin[1:], len(at)) - 1] + 1
        signs[first] = np.maximum.reduceat(signs[at], begin)
        leads = signs[first - 1] == _END
        stays[first] = ~leads
        stays[after[leads]] = signs[after[leads]] != _SPACE
        tight = after[~leads & (signs[after] >= _LETTER)]
        signs, stays = np.insert(signs, tight, _SPACE), np.insert(stays, tight, True)
    return signs[stays]


def normal(texts: list[str], form: str | None, foreign: bool = False) -> list:
    """The whole front end: composition, letters, numbers, cleaning, marks, punctuation. foreign: pairs with the list of characters that cleaning drops."""
    from .numerals import expanded

    texts = [t if form is None or t.isascii() else unicodedata.normalize(form, t) for t in texts]
    table, strange = _signs()
    codes, bounds = _codes(texts), _bounds(texts)
    signs = table[codes]
    digits = np.flatnonzero(signs == _DIGIT)
    if len(digits):
        for i in np.unique(np.searchsorted(bounds, digits, "right") - 1):
            one = _unified()[codes[bounds[i] : bounds[i + 1]]]
            texts[i] = expanded(one[one < _ALL].tobytes().decode("utf-32-le", "surrogatepass"))
        codes, bounds = _codes(texts), _bounds(texts)
        signs = table[codes]
    data = b"\n" + b"\n".join(_parts(signs.tobytes(), bounds)) + b"\n"
    signs = np.frombuffer(bytearray(data.translate(_AS_SPACE, bytes([_DROP]))), np.uint8)
    _mark(signs)
    out = codecs.charmap_decode(_tidy(signs[signs != _DROP]).tobytes(), "strict", _READ)[0].split("\n")[1:-1]
    if not foreign:
        return out
    found: list[list[str]] = [[] for _ in texts]
    at = np.flatnonzero(strange[codes])
    for i, c in zip((np.searchsorted(bounds, at, "right") - 1).tolist(), _unified()[codes[at]].tolist()):
        found[i].append(chr(c))
    return list(zip(out, found))


def plain(text: str) -> str:
    """Without marks and punctuation, in single spaces."""
    for c in A.MARKS:
        text = text.replace(c, "")
    return " ".join(text.replace(",", " ").replace(".", " ").split())


def bare(text: str) -> str:
    """Without marks, in single spaces."""
    for c in A.MARKS:
        text = text.replace(c, "")
    return " ".join(text.split())


_RUN = re.compile(f"[{A.LETTERS}{A.MARKS}]+")


def words_with_ha(text: str) -> list[str]:
    """The distinct runs of letters and marks that have ه."""
    return [w for w in set(_RUN.findall(text)) if A.HA in w]


def restored(text: str, changing: Container[str]) -> str:
    """The last ه of each run of letters and marks in ``changing`` as ة."""

    def new(m: re.Match) -> str:
        word = m[0]
        if word not in changing:
            return word
        head, _, tail = word.rpartition(A.HA)
        return head + A.TA_MARBUTA + tail

    return _RUN.sub(new, text)


_AFTER_STOP, _AFTER_COMMA, _WORD = (re.compile(x, re.ASCII) for x in (r"\.\s", r",\s", r"\S+"))
_LAST_COMMAS = re.compile(r",+(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)")


@functools.cache
def _is_letter() -> np.ndarray:
    table = np.zeros(_ALL, bool)
    table[[ord(c) for c in A.LETTERS]] = True
    return table


def letters(texts: list[str]) -> list[int]:
    """How many letters each text has."""
    return [int(np.count_nonzero(x)) for x in _parts(_is_letter()[_codes(texts)], _bounds(texts))]


def _split(gap: re.Pattern, text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Places of the parts of text[start:end] that end before the last sign of each gap."""
    for m in gap.finditer(text, start, end):
        yield start, m.end() - 1
        start = m.end()
    yield start, end


def _merged(parts: Iterable[tuple[str, int]], most: int) -> list[tuple[str, int]]:
    """Neighbours (text, letters) joined by a space while they have at most ``most`` letters together."""
    out, now, n = [], [], 0
    for part, m in parts:
        if now and n + m > most:
            out.append((" ".join(now), n))
            now, n = [], 0
        now.append(part)
        n += m
    return [*out, (" ".join(now), n)] if now else out


def chunks(texts: list[str], most: int) -> list[list[str]]:
    """Each text's sentences, split after commas and then between words where they have more than ``most`` letters, merged again up to it; each ends in a stop."""
    before = memoryview(np.concatenate(([0], np.cumsum(_is_letter()[_codes(texts)], dtype=np.int64))))  # letters before each place
    out = []
    for text, at in zip(texts, _bounds(texts)):
        pieces: list[tuple[str, int]] = []
        for a, b in _split(_AFTER_STOP, text, 0, len(text)):
            sentence, n = text[a:b].strip(" "), before[at + b] - before[at + a]
            if n <= most:
                pieces += [(sentence, n)] * (sentence != "")
                continue
            for c, d in _split(_AFTER_COMMA, text, a, b):
                part, n = text[c:d].strip(" "), before[at + d] - before[at + c]
                if n <= most:
                    pieces += [(part, n)] * (part != "")
                else:
                    pieces += _merged(((m[0], before[at + m.end()] - before[at + m.start()]) for m in _WORD.finditer(text, c, d)), most)
        out.append([c if c.endswith(".") else _LAST_COMMAS.sub("", c) + "." for c, _ in _merged(pieces, most)])
    return out
