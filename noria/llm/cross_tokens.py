"""Alignment of two tokenizers over the same bytes.

Each text, with a space before it, is encoded by A (byte-level BPE) and B (SentencePiece, which adds that space itself). At a single space
between visible characters both end a token, so that texts are cut there and each distinct fragment is encoded and aligned once per block, or
once per worker while its memo has room. The tokens of new fragments are two tables of byte intervals in a DuckDB inside the task: groups
are window sums over the ends that both have; the first token of B that a token of A overlaps is found by an ASOF join, and where it ends
before A's does, the last by another and those between by a range join. A block of documents adds up what its fragments have, and
counts for each pair of ids how many of its documents hold it linked.

Spark merges the blocks' counts by pair, finds each A id's highest count, and gives every block back the counts of its own pairs; so what is shuffled is a
row for each block and pair, and no pair has more rows than there are blocks, however frequent it is. The only table broadcast has a row for
each id of A at most.

Blocks are bounded in bytes; a longer text is a block of its own, and a worker's memory follows the longest. Rows are written before block numbers are
used, so a task that runs again can't renumber them.

Null and empty texts, and texts whose tokens' bytes differ from the text (U+2581 in it, which B reads as a space), have no tokens: zeros and no
groups. Repeated rows are documents each; a null doc_id stays null. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import _calls, by_size, gaps, joined
from .fragments import TokenBytes, starts_of
from .tables import clean_input, stored
from .workers import held, tidy

#: Bytes of text of a block.
BLOCK_BYTES = 2 << 20
#: Bytes of fragments that are aligned at once.
PART_BYTES = 1 << 20
#: Bytes of fragments and of what is known about them that a worker remembers.
MEMO_BYTES = 96 << 20
COUNTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
#: pairs: places in the block's list of pairs, and links of each in the document. The block's first row has the list: a, b, and documents of the block that hold the pair.
_ALIGNED = COUNTS + ", groups string, block long, pairs array<int>, links array<int>, a array<int>, b array<int>, docs array<int>"
RESULT = COUNTS + ", n_best long, count_sum long"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


class Grown:
    """An array that is added to at its end and cut there."""

    def __init__(self, dtype: type):
        self._held, self.n = np.zeros(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self._held):
            self._held = np.concatenate([self._held, np.zeros_like(self._held)])
        self._held[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def values(self) -> np.ndarray:
        return self._held[: self.n]


class Aligner:
    """Both tokenizers, a DuckDB of one thread that never writes to disk, and what is known of fragments by number.

    sums: rows ok, n_a, n_b, n_groups, n_links; groups: their text, each with a semicolon behind; pairs: a << 32 | b, and links.
    """

    SUMS = 5

    def __init__(self, path_a: str, path_b: str):
        import duckdb

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.a.no_truncation()
        self.a.no_padding()
        ids = range(self.b.get_piece_size())
        pieces = [self.b.id_to_piece(i) for i in ids]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece that goes on behind a space may cross fragments")
        self.bytes_a = TokenBytes.of_byte_level(self.a)
        self.bytes_b = TokenBytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces, strict=True)])
        self.ids = max(len(self.bytes_a.size), len(self.bytes_b.size))
        self.digits = pa.array([f"{i}{end}" for end in ",|;" for i in range(self.ids)], pa.large_string())
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        self.known: dict[bytes, int] = {}
        self.sums = [Grown(np.int64) for _ in range(self.SUMS)]
        self.group_ends, self.pair_ends = Grown(np.int64), Grown(np.int64)
        self.group_ends.add(np.zeros(1, np.int64))
        self.pair_ends.add(np.zeros(1, np.int64))
        self.groups, self.pairs, self.links = Grown(np.uint8), Grown(np.int64), Grown(np.int32)

    def _learn(self, fragments: list[bytes]) -> None:
        """Encode and align fragments, each of which begins with a space."""
        texts, n = [f.decode() for f in fragments], len(fragments)
        encoded_a = [e.ids for some in _calls(texts) for e in self.a.encode_batch_fast(some, add_special_tokens=False)]
        encoded_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        length, ok, tokens = np.fromiter(map(len, fragments), np.int64, n), np.ones(n, bool), []
        for table, encoded in ((self.bytes_a, encoded_a), (self.bytes_b, encoded_b)):
            of = np.repeat(np.arange(n), np.fromiter(map(len, encoded), np.int64, n))
            ids = np.fromiter((i for x in encoded for i in x), np.int32, len(of))
            spelled, at = table.gather(ids).tobytes(), np.concatenate([[0], np.cumsum(np.bincount(of, table.size[ids], n).astype(np.int64))]).tolist()
            ok &= np.fromiter((spelled[x:y] == f for x, y, f in zip(at, at[1:], fragments)), bool, n)
            tokens.append((of, ids, table.size[ids]))
        ok &= length > 1  # the space before an empty text
        counted = []
        for name, (of, ids, size) in zip("ab", tokens, strict=True):
            there = ok[of]
            of, ids, size = of[there], ids[there], size[there]
            e = np.cumsum(size)  # fragments that count lie end to end, on both sides alike
            self.db.register("tokens", pa.table({"pos": np.arange(len(ids), dtype=np.int32), "fragment": of.astype(np.int32), "s": e - size, "e": e, "id": ids}))
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS FROM tokens")
            self.db.unregister("tokens")
            counted.append((of, ids))
        group = [self.db.execute(self.GROUPS.format(own=x, other=y)).fetchnumpy() for x, y in ("ab", "ba")]
        self.db.execute(self.FIRST)
        self.db.execute(self.LAST)
        linked = {k: np.asarray(v, np.int64) for k, v in self.db.execute(self.LINKS).fetchnumpy().items()}
        (of_a, ids_a), (of_b, ids_b) = counted
        sums = (ok, np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n), np.bincount(of_a, np.asarray(group[0]["shared"]), n), np.bincount(linked["fragment"], linked["links"], n))
        for held_so_far, x in zip(self.sums, sums, strict=True):
            held_so_far.add(np.asarray(x, np.int64))
        text, ends = self._spelled(of_a, ids_a, of_b, ids_b, group, n)
        self.group_ends.add(self.groups.n + ends)
        self.groups.add(text)
        self.pair_ends.add(self.pairs.n + np.cumsum(np.bincount(linked["fragment"], minlength=n)))
        self.pairs.add(linked["a"] << 32 | linked["b"])
        self.links.add(linked["links"])

    #: A token's group is the number of shared ends before its own.
    GROUPS = """
    WITH t AS (SELECT {own}.pos, {other}.e IS NOT NULL AS shared FROM {own} LEFT JOIN {other} ON {own}.e = {other}.e)
    SELECT shared, coalesce(sum(shared::INT) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS grp FROM t ORDER BY pos
    """
    #: Tables, not subqueries: the range join is chosen by their sizes.
    FIRST = "CREATE OR REPLACE TEMP TABLE low AS SELECT a.fragment, a.id, a.e, b.pos, b.id AS b, b.e AS stop FROM a ASOF JOIN b ON a.s >= b.s"
    LAST = "CREATE OR REPLACE TEMP TABLE span AS SELECT low.fragment, low.id, low.pos, b.pos AS high FROM (FROM low WHERE stop < e) low ASOF JOIN b ON low.e > b.s"
    LINKS = """
    WITH linked AS (SELECT fragment, id AS a, b FROM low UNION ALL SELECT span.fragment, span.id, b.id FROM span JOIN b ON b.pos > span.pos AND b.pos <= span.high)
    SELECT fragment, a, b, count(*) AS links FROM linked GROUP BY ALL ORDER BY ALL
    """

    def _spelled(self, of_a: np.ndarray, ids_a: np.ndarray, of_b: np.ndarray, ids_b: np.ndarray, group: list[dict], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Groups as text, `a1,a2|b1;...;`, of all fragments in one, and where each fragment's part ends."""
        ga, gb = (np.asarray(g["grp"]) for g in group)
        code = np.empty(len(ids_a) + len(ids_b), np.int64)
        code[np.arange(len(ga)) + np.searchsorted(gb, ga)] = ids_a + self.ids * np.asarray(group[0]["shared"], np.int64)
        code[np.arange(len(gb)) + np.searchsorted(ga, gb, "right")] = ids_b + 2 * self.ids * np.asarray(group[1]["shared"], np.int64)
        upto = np.cumsum(np.bincount(of_a, minlength=n) + np.bincount(of_b, minlength=n))
        if not len(code):
            return np.zeros(0, np.uint8), np.zeros(n, np.int64)
        text = self.digits.take(pa.array(code))
        at = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        return np.frombuffer(text.buffers()[2], np.uint8)[: at[-1]], at[upto]

    def numbers(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each fragment, fragments up to each text) of texts in UTF-8, joined, each beginning with a space."""
        at = gaps(data, offsets)
        first = np.union1d(at[data[at] == 0x20], starts_of(offsets))
        coded = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.append(first, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        for f in distinct:
            self.known.setdefault(f, len(self.known))
        new, size = [], 0
        for f in distinct:
            if self.known[f] >= self.sums[0].n:
                new.append(f)
                size += len(f)
                if size >= PART_BYTES:
                    self._learn(new)
                    new, size = [], 0
        if new:
            self._learn(new)
        found = np.fromiter((self.known[f] for f in distinct), np.int64, len(distinct))
        return found[np.asarray(coded.indices)], np.searchsorted(first, offsets)

    def forget(self) -> None:
        """Everything, once it takes more than the memo's bytes."""
        if 200 * len(self.known) + self.groups.n + 12 * self.pairs.n > MEMO_BYTES:
            self.known = {}
            for x in (*self.sums, self.groups, self.pairs, self.links):
                x.n = 0
            self.group_ends.n = self.pair_ends.n = 1


def _aligned(aligner: Aligner, texts: pa.Array, with_groups: bool) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, groups) of each text; and the texts' pairs as (text, a << 32 | b, links), by text."""
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.fill_null(texts, "").cast(pa.large_string()), pa.scalar(" ", pa.large_string()))
    data, offsets = joined(spaced)
    number, upto = aligner.numbers(data, offsets)
    n = len(texts)
    of = np.repeat(np.arange(n), np.diff(upto))
    ok = np.bincount(of, 1 - aligner.sums[0].values[number], n) == 0
    there = ok[of]
    number, of = number[there], of[there]
    sums = [np.bincount(of, x.values[number], n).astype(np.int64).tolist() for x in aligner.sums[1:]]
    spelled = pa.Array.from_buffers(pa.large_binary(), aligner.group_ends.n - 1, [None, pa.py_buffer(aligner.group_ends.values), pa.py_buffer(aligner.groups.values)]).take(pa.array(number))
    at = np.frombuffer(spelled.buffers()[1], np.int64, len(spelled) + 1, spelled.offset * 8) if len(spelled) else np.zeros(1, np.int64)
    text, ends = memoryview(spelled.buffers()[2] if len(spelled) else b""), at[np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])].tolist()
    rows = []
    for k, good in enumerate(ok.tolist()):
        own = text[ends[k] : ends[k + 1] - 1] if good else b""  # but for the last semicolon
        rows.append((*(x[k] for x in sums), hashlib.sha256(own).hexdigest() if good else "", bytes(own).decode() if with_groups else None))
    # pairs of each text: first its distinct fragments, then their pairs
    both, times = np.unique(of << 32 | number, return_counts=True)
    of, number = both >> 32, both & 0xFFFFFFFF
    start, size = aligner.pair_ends.values[number], aligner.pair_ends.values[number + 1] - aligner.pair_ends.values[number]
    place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    distinct, pair = np.unique(aligner.pairs.values[place], return_inverse=True)
    both, back = np.unique(np.repeat(of, size) << 32 | pair, return_inverse=True)
    links = np.bincount(back, aligner.links.values[place] * np.repeat(times, size), len(both)).astype(np.int64)
    aligner.forget()
    return rows, both >> 32, distinct[both & 0xFFFFFFFF], links


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, pa.int32()))


def _first(values: np.ndarray, n: int) -> pa.Array:
    """A list in the first of n rows."""
    return pa.array([values.astype(np.int32)] + [None] * (n - 1), pa.list_(pa.int32()))


def _blocks(path_a: str, path_b: str, with_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held("aligner")
        if (path_a, path_b) not in known:
            known.clear()
            known[path_a, path_b] = Aligner(path_a, path_b)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in by_size(batch, 1, BLOCK_BYTES):
                rows, doc, key, links = _aligned(known[path_a, path_b], some.column(1), with_groups)
                n = len(rows)
                pairs, place, docs = np.unique(key, return_inverse=True, return_counts=True)
                ends = np.cumsum(np.bincount(doc, minlength=n))
                types = (*[pa.int64()] * 4, pa.string(), pa.string())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                lists = [_lists(place, ends), _lists(links, ends), _first(pairs >> 32, n), _first(pairs & 0xFFFFFFFF, n), _first(docs, n)]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns, pa.array([block] * n, pa.int64()), *lists], names=_names(_ALIGNED))
                block += 1

    return tidy(run, "aligner")


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a block with what the corpus-wide counts of its pairs say."""
    place = np.asarray(right["place"])
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = np.asarray(right["n_docs"]), np.asarray(right["best"])
    pairs, links = (left[c].combine_chunks() for c in ("pairs", "links"))
    ends = np.cumsum(np.asarray(pc.list_value_length(pairs), np.int64))
    at, times = np.asarray(pairs.flatten(), np.int64), np.asarray(links.flatten(), np.int64)
    sums = [np.concatenate([[0], np.cumsum(x[at] * times)]) for x in (best, count)]
    out = [pa.array(np.diff(s[np.concatenate([[0], ends])]), pa.int64()) for s in sums]
    return pa.table([*(left[c] for c in _names(COUNTS)), *out], names=_names(RESULT))


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """The alignment of each document, with its block's pairs, as a stored table. with_groups: the groups themselves too, not only their hash."""
    return stored(clean_input(docs, "doc_id", "text").mapInArrow(_blocks(path_a, path_b, with_groups), _ALIGNED), "aligned")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b and n_docs: in how many documents a token of A with id a overlaps one of B with id b; best: no other b of this a has more."""
    counts = _block_pairs(blocks).groupBy("a", "b").agg(F.sum("docs").alias("n_docs"))
    top = counts.groupBy("a").agg(F.max("n_docs").alias("top"))  # a row for each id of A at most
    return counts.join(F.broadcast(top), "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("top")).cast("int").alias("best"))


def _block_pairs(blocks: DataFrame) -> DataFrame:
    return blocks.where("a IS NOT NULL").select("block", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("place", "_p")).select("block", "place", "_p.*")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """For each document RESULT: tokens of both, groups, links, links to a best partner, and the sum of its links' counts. path_a: byte-level BPE; path_b: a SentencePiece model."""
    blocks = aligned_blocks(docs, path_a, path_b)
    counts = stored(pair_counts(blocks), "pair-counts")
    known = _block_pairs(blocks).join(counts, ["a", "b"]).select(F.col("block").alias("of"), "place", "n_docs", "best")
    rows = blocks.select(*_names(COUNTS), "block", "pairs", "links")
    return rows.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_finish, RESULT)
