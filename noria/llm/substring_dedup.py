"""Substring dedup by relative Lempel-Ziv parsing.

The reference of a document are all documents with smaller ids. Its windows of FACTOR words are
indexed: each is owned by the place (doc_id, word) where it starts first. Reference documents are
kept in blocks of BLOCK + FACTOR - 1 words. A document is parsed greedily: at the first owned window
that no factor covers yet, a factor (start, source, source start, length) begins; it is compared word by
word with the source's block and grows as far as the words agree. Windows across the boundary of two
factors were looked up like all others: one that is owned and lies in no factor begins a factor of
its own, overlapping the one before, so a passage that several references share piecewise is found
whole. Factors of FACTOR words or more are the duplicate spans; every removed word has been compared.

Indexing each position of each document would multiply the corpus, so only windows that can match
are indexed. Windowed minima of hashes of ANCHOR words pick anchors in any text by its own words
alone: each window of FACTOR words holds one, and equal windows hold the same. Anchors that occur in
one document only (nearly all) rule their windows out, without loss. Documents whose whole sequences of
words are equal, by SHA-256, are settled before: they are one factor of the smallest. Counts per anchor and
window are combined before they are shuffled, and lookups treat hot ones apart. Windows are found by two independent
64-bit hashes; where they collide, the words differ and no factor begins.

Null and empty texts have no words. Repeated rows of a doc_id with the same words are the same document and share its
spans. Where an id has rows with different words, each of these texts is judged on its own, against the documents with smaller ids
only: ids give way to numbers of (id, words) in order of id then. A row without doc_id is left as it is. Very long texts
are parsed whole, their words of more than LONG_WORD bytes compared by SHA-256. An empty
table gives an empty result; extra columns are kept by ``drop_spans`` and otherwise not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from noria.operators.ordering import running_number

from .tables import clean_input, only_ids, stored, with_group_values
from .workers import tidy

FACTOR, ANCHOR = 50, 25
#: Anchor positions in a block of FACTOR words.
_RUN = FACTOR - ANCHOR + 1
#: Windows that start in one reference block.
BLOCK = 64
#: Bytes of a word that a reference block holds; longer words are held by their SHA-256.
LONG_WORD = 64


def anchor_places(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors: each block's first least hash of ANCHOR words."""
    at, grams = wh.windows(words, first, ANCHOR)
    if len(grams) < _RUN:
        return at[:0], grams[:0]
    least = np.lib.stride_tricks.sliding_window_view(grams, _RUN).argmin(axis=1) + np.arange(len(grams) - _RUN + 1)
    whole = at[_RUN - 1 :] - at[: len(at) - _RUN + 1] == _RUN - 1  # all within one text
    picked = np.unique(least[whole])
    return at[picked], grams[picked]


def _text_words(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, i: int, keep: np.ndarray | None = None) -> bytes:
    """The words of text i, or those to keep, joined by one space."""
    a, b = first[i], first[i + 1]
    if keep is None:
        return b" ".join(data[offsets[i] : offsets[i + 1]].tobytes().translate(_TO_SPACE).split())
    raw = data.tobytes() if a == b else data[starts[a] : ends[b - 1]].tobytes()
    base = starts[a] if a < b else 0
    return b" ".join([raw[s:e] for s, e in zip((starts[a:b][keep] - base).tolist(), (ends[a:b][keep] - base).tolist(), strict=True)])


_TO_SPACE = bytes(0x20 if 9 <= c <= 13 else c for c in range(256))
_OUTLINE = "doc_id long, n_words long, words_sha256 string, anchors array<long>"


def _outliner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in wh.blocks(batch.column(1)):
            starts, ends, first = wh.spans(data, offsets)
            words = wh.hashes(data, starts, ends)
            at, grams = anchor_places(words, first)
            cuts = np.searchsorted(at, first)
            grams, cuts = wh.distinct_within(grams, cuts)
            n = len(offsets) - 1
            sha = [hashlib.sha256(_text_words(data, offsets, starts, ends, first, i)).hexdigest() for i in range(n)]
            anchors = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(wh.signed(grams)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(np.diff(first).astype(np.int64)), pa.array(sha), anchors], names=[x.split()[0] for x in _OUTLINE.split(", ")])


_WINDOWS = "doc_id long, place int, b1 long, b2 long"


def _window_lister(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each document that hold a shared anchor."""
    for batch in batches:
        shared = batch.column(2)
        for row, data, offsets in wh.blocks(batch.column(1)):
            starts, ends, first = wh.spans(data, offsets)
            words = wh.hashes(data, starts, ends)
            at, grams = anchor_places(words, first)
            docs = wh.owners(first, at)
            cuts = np.searchsorted(docs, np.arange(len(offsets)))
            hit = np.zeros(len(at), bool)
            for i in range(len(offsets) - 1):
                a, b = cuts[i], cuts[i + 1]
                if a < b:
                    hit[a:b] = np.isin(wh.signed(grams[a:b]), np.asarray(shared[row + i].values))
            places, b1 = wh.windows(words, first, FACTOR)
            b2 = wh.windows(wh.hashes(data, starts, ends, check=True), first, FACTOR, check=True)[1]
            # windows that start up to _RUN - 1 words before a shared anchor
            edge = np.zeros(len(words) + 2, np.int64)
            np.add.at(edge, np.maximum(at[hit] - _RUN + 1, first[docs[hit]]), 1)
            np.add.at(edge, at[hit] + 1, -1)
            use = np.cumsum(edge)[places] > 0
            places, b1, b2 = places[use], b1[use], b2[use]
            of = wh.owners(first, places)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of + row)), pa.array((places - first[of]).astype(np.int32)), pa.array(wh.signed(b1)), pa.array(wh.signed(b2))], names=["doc_id", "place", "b1", "b2"])


_SEGMENTS = "doc_id long, segments array<struct<start: int, source: long, source_start: int, n: int>>"


def _segmenter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owned windows of each document as runs of n whose owners are consecutive windows of one source, too."""
    for batch in batches:
        lists = batch.column(1)
        own, upto = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
        doc = np.repeat(np.arange(batch.num_rows), np.diff(upto))
        place, source, at = (np.asarray(own.field(i), np.int64) for i in range(3))
        order = np.lexsort((place, doc))
        doc, place, source, at = doc[order], place[order], source[order], at[order]
        new = np.ones(len(place), bool)
        new[1:] = (np.diff(place) != 1) | (np.diff(at) != 1) | (np.diff(source) != 0) | (np.diff(doc) != 0)
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(place)))
        columns = [pa.array(place[head], pa.int32()), pa.array(source[head]), pa.array(at[head], pa.int32()), pa.array(n, pa.int32())]
        segments = pa.StructArray.from_arrays(columns, names=["start", "source", "source_start", "n"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.searchsorted(head, upto), pa.int32()), segments)], names=["doc_id", "segments"])


def _spoken(text: bytes) -> list[bytes]:
    """A text's words, long ones as their SHA-256 (after a tab, which no word has)."""
    return [w if len(w) <= LONG_WORD else b"\t" + hashlib.sha256(w).digest().hex().encode() for w in text.translate(_TO_SPACE).split()]


def _block_maker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted reference blocks of each source, as words joined by spaces."""
    out: list[tuple[int, int, bytes]] = []
    held = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["source", "block", "words"])

    for batch in batches:
        for doc, text, wanted in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            words = _spoken((text.as_py() or "").encode())
            for b in wanted.as_py():
                out.append((doc.as_py(), b, b" ".join(words[b * BLOCK : b * BLOCK + BLOCK + FACTOR - 1])))
                held += len(out[-1][2])
            if held > 1 << 22:
                yield made()
                out, held = [], 0
    if out:
        yield made()


def parse(words: list[bytes], segments: list[tuple[int, int, int, int]], blocks: dict[tuple[int, int], list[bytes]]) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, source, source start, length) of a document.

    segments (start, source, source start, n) say which windows are owned and by whom; blocks[source, i]
    are the words of a source from i * BLOCK on. A factor ends where the words differ or the block ends.
    """
    out: list[tuple[int, int, int, int]] = []
    end = 0
    for start, source, source_start, n in segments:
        # windows that end in the last factor need no look
        at = max(start, end - FACTOR + 1)
        while at < start + n:
            there = source_start + at - start
            block = blocks.get((source, there // BLOCK), ())
            theirs = block[there % BLOCK :]
            ours = words[at : at + len(theirs)]
            length = len(ours) if ours == theirs[: len(ours)] else next(i for i, (x, y) in enumerate(zip(ours, theirs, strict=False)) if x != y)
            if length < FACTOR:  # two hashes collided: no copy
                at += 1
                continue
            out.append((at, source, there, length))
            end = at + length
            at = end - FACTOR + 1
    return out


def covered(factors: list[tuple[int, int, int, int]], n_words: int) -> np.ndarray:
    """Which words lie in a factor."""
    edge = np.zeros(n_words + 1, np.int64)
    for start, _, _, length in factors:
        edge[start] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:-1] > 0


_CUT = "doc_id long, n_removed long, cut string, factors array<struct<start: int, source: long, source_start: int, length: int>>"
_FACTORS = pa.list_(pa.struct([("start", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32()), ("length", pa.int32())]))


def _span_cutter(whole_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in wh.blocks(batch.column(1)):
                starts, ends, first = wh.spans(data, offsets)
                n, removed, out, found = len(offsets) - 1, [], [], []
                for i in range(n):
                    words = _spoken(data[offsets[i] : offsets[i + 1]].tobytes())
                    blocks = {(b["source"], b["block"]): b["words"].split(b" ") for b in batch.column(3)[row + i].as_py()}
                    factors = parse(words, [tuple(s.values()) for s in batch.column(2)[row + i].as_py()], blocks)
                    gone = covered(factors, len(words))
                    removed.append(int(gone.sum()))
                    found.append([dict(zip(("start", "source", "source_start", "length"), f, strict=True)) for f in factors])
                    if whole_text:
                        out.append(_without(data, offsets, starts, ends, first, i, gone).decode())
                    else:
                        out.append(hashlib.sha256(_text_words(data, offsets, starts, ends, first, i, ~gone)).hexdigest())
                columns = [batch.column(0).slice(row, n), pa.array(removed, pa.int64()), pa.array(out, pa.string()), pa.array(found, _FACTORS)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_removed", "cut", "factors"])

    return run


def _without(data, offsets, starts, ends, first, i: int, gone: np.ndarray) -> bytes:
    """Text i without its removed words and the white space after each."""
    a, b = int(first[i]), int(first[i + 1])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    out, at = [], int(offsets[i])
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append(data[at : int(starts[a + s])].tobytes())
        at = int(starts[a + e]) if a + e < b else int(offsets[i + 1])
    return b"".join([*out, data[at : int(offsets[i + 1])].tobytes()])


def outline(docs: DataFrame) -> DataFrame:
    """n_words, SHA-256 of the words and anchors of each document, as a stored table."""
    return stored(clean_input(docs, "doc_id", "text").mapInArrow(tidy(_outliner), _OUTLINE), "outline")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """One text per doc_id in ``ids`` (doc_id, distinct)."""
    texts = only_ids(clean_input(docs, "doc_id", "text").where("doc_id IS NOT NULL"), ids)
    return texts.groupBy("doc_id").agg(F.max("text").alias("text"))


def _apart(docs: DataFrame, outlines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """(docs, outlines, None, None) as they are where no id has texts of different words. Else with numbers of (id, words) for doc_id, the docs as doc_id, text and row (the whole row), then what stands
    for each number (_number, _own_id), and the first number of its id for those that aren't the first (doc_id, floor)."""
    ids = outlines.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("words_sha256").alias("a"), F.max("words_sha256").alias("b"))
    if ids.where("a <> b").isEmpty():
        return docs, outlines, None, None
    texts = outlines.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_of"), F.col("words_sha256").alias("_words")).distinct()
    numbers = stored(running_number(texts, ["_of", "_words"], "_number"), "text-numbers")
    floors = numbers.groupBy(F.col("_of").alias("_id")).agg(F.min("_number").alias("floor"))
    later = numbers.join(floors, F.col("_of") == F.col("_id")).where("_number > floor").select(F.col("_number").alias("doc_id"), "floor")
    words = F.trim(F.regexp_replace(F.coalesce(docs["text"], F.lit("")), r"[\x20\x09-\x0D]+", " "))

    def numbered(df: DataFrame, *columns: str) -> DataFrame:
        found = df.join(numbers, (df["doc_id"] == numbers["_of"]) & (df["words_sha256"] == numbers["_words"]), "left")
        return found.select(F.col("_number").alias("doc_id"), *columns)

    rows = docs.select("doc_id", "text", F.sha2(words, 256).alias("words_sha256"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    outlines = stored(numbered(outlines, "n_words", "words_sha256", "anchors"), "numbered-outlines")
    return numbered(rows, "text", "row"), outlines, numbers.select("_number", F.col("_of").alias("_own_id")), stored(later, "later-texts")


def owned_windows(docs: DataFrame, outlines: DataFrame, later: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id and head of the documents that repeat a smaller one whole, segments of the owned windows of the others). later: as ``_apart`` has it."""

    def before(df: DataFrame, source: str) -> DataFrame:
        if later is None:
            return df.where(f"{source} < doc_id")
        return df.join(later, "doc_id", "left").where(f"{source} < coalesce(floor, doc_id)").drop("floor")

    long = outlines.where(f"n_words >= {FACTOR} AND doc_id IS NOT NULL")
    same = stored(long.groupBy("words_sha256").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n_docs")), "same-words")
    heads = stored(long.select("doc_id", "anchors").join(same.select(F.col("head").alias("doc_id")).distinct(), "doc_id", "left_semi"), "heads")
    repeats = with_group_values(long.select("doc_id", "words_sha256"), same.where("head < last").select("words_sha256", "head", "n_docs"), "words_sha256", "n_docs", long.count())
    copies = before(repeats, "head").groupBy("doc_id").agg(F.min("head").alias("head"))
    anchors = stored(heads.select(F.explode("anchors").alias("anchor"), "doc_id").distinct(), "anchors")
    shared = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_docs")).where("n_docs > 1")
    shared = stored(shared, "shared-anchors")
    by_doc = with_group_values(anchors, shared, "anchor", "n_docs", anchors.count()).groupBy("doc_id").agg(F.collect_list("anchor").alias("shared"))
    by_doc = stored(by_doc, "shared-by-document")  # at most a document's own anchors in each row
    windows = _texts_of(docs, by_doc.select("doc_id")).join(by_doc, "doc_id").select("doc_id", "text", "shared").mapInArrow(tidy(_window_lister), _WINDOWS)
    windows = stored(windows.select("doc_id", "place", F.struct("b1", "b2").alias("window")), "windows")
    index = windows.groupBy("window").agg(F.min(F.struct(F.col("doc_id").alias("source"), F.col("place").alias("at"))).alias("owner"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n_windows")).where("owner.source < last").drop("last")
    index = stored(index, "index")
    owned = before(with_group_values(windows, index, "window", "n_windows", windows.count()), "owner.source")
    own = owned.groupBy("doc_id").agg(F.collect_list(F.struct("place", "owner.source", "owner.at")).alias("own"))  # at most a document's own words
    return copies, stored(own.mapInArrow(tidy(_segmenter), _SEGMENTS), "segments")


def _cut(docs: DataFrame, segments: DataFrame, whole_text: bool) -> DataFrame:
    """doc_id, n_removed, cut and factors of the documents in ``segments``."""
    one = segments.select("doc_id", F.explode("segments").alias("s"))
    block = F.explode(F.sequence(F.expr(f"cast(s.source_start div {BLOCK} as int)"), F.expr(f"cast((s.source_start + s.n - 1) div {BLOCK} as int)")))
    needs = stored(one.select("doc_id", "s.source", block.alias("block")).distinct().select("doc_id", F.struct("source", "block").alias("key")), "needs")
    wanted = stored(needs.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs")), "wanted")
    sources = stored(wanted.groupBy(F.col("key.source").alias("doc_id")).agg(F.collect_list("key.block").alias("blocks")), "sources")
    made = _texts_of(docs, sources.select("doc_id")).join(sources, "doc_id").select("doc_id", "text", "blocks").mapInArrow(tidy(_block_maker), "source long, block int, words binary")
    made = stored(made.select(F.struct("source", "block").alias("key"), "words").join(wanted, "key"), "reference-blocks")
    near = with_group_values(needs, made, "key", "n_docs", needs.count()).groupBy("doc_id").agg(F.collect_list(F.struct("key.source", "key.block", "words")).alias("blocks"))
    rows = _texts_of(docs, segments.select("doc_id")).join(segments, "doc_id").join(near, "doc_id")
    return rows.select("doc_id", "text", "segments", "blocks").mapInArrow(tidy(_span_cutter(whole_text)), _CUT)


def factors(docs: DataFrame) -> DataFrame:
    """The parse: doc_id, start, source, source_start and length (in words) of every factor of FACTOR words or more."""
    docs, outlines, own, later = _apart(docs, outline(docs))
    copies, segments = owned_windows(docs, outlines, later)
    copies = stored(copies, "copies")
    whole = copies.join(outlines.groupBy("doc_id").agg(F.max("n_words").alias("n")), "doc_id").select("doc_id", F.lit(0).alias("start"), F.col("head").alias("source"), F.lit(0).alias("source_start"), F.col("n").cast("int").alias("length"))
    parts = _cut(docs, segments.join(copies, "doc_id", "left_anti"), False).select("doc_id", F.explode("factors").alias("f")).select("doc_id", "f.*")
    found = whole.unionByName(parts)
    if own is None:
        return found
    source = own.select(F.col("_number").alias("source"), F.col("_own_id").alias("_source_id"))
    named = found.join(own, found["doc_id"] == own["_number"]).join(source, "source")
    return named.select(F.col("_own_id").alias("doc_id"), "start", F.col("_source_id").alias("source"), "source_start", "length")


def removed_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every document."""
    docs, outlines, own, later = _apart(docs, outline(docs))
    copies, segments = owned_windows(docs, outlines, later)
    copies = stored(copies.select("doc_id"), "copies")
    # a document that repeats both in words and in parts of a smaller one is a copy
    cut = _cut(docs, segments.join(copies, "doc_id", "left_anti"), False).drop("factors")
    whole = copies.select("doc_id", F.lit(None).cast("long").alias("n_removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("cut"))
    found = outlines.select("doc_id", "n_words", "words_sha256").join(stored(cut.unionByName(whole).withColumn("hit", F.lit(True)), "cut"), "doc_id", "left")
    removed = F.when(F.col("hit").isNull(), F.lit(0).cast("long")).otherwise(F.coalesce("n_removed", "n_words"))
    if own is not None:
        found = found.join(own, found["doc_id"] == own["_number"], "left").withColumn("doc_id", F.col("_own_id"))
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.coalesce("cut", "words_sha256").alias("kept_sha256"))


def drop_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with duplicate spans cut out of ``text``; every row stays, emptied ones with an empty text."""
    columns, types = docs.columns, dict(docs.dtypes)
    docs, outlines, own, later = _apart(docs, outline(docs))
    copies, segments = owned_windows(docs, outlines, later)
    copies = stored(copies.select("doc_id"), "copies")
    cut = _cut(docs, segments.join(copies, "doc_id", "left_anti"), True).select("doc_id", "cut")
    cut = stored(cut.unionByName(copies.select("doc_id", F.lit("").alias("cut"))), "cut-texts").select(F.col("doc_id").alias("_cut_id"), F.col("cut").alias("_cut"))
    joined = docs.join(cut, docs["doc_id"] == cut["_cut_id"], "left")
    was = {c: docs[f"`{c}`"] if own is None else docs["row"][c] for c in columns}
    new = {"text": F.coalesce(cut["_cut"], was["text"])}
    if "n_chars" in columns:
        new["n_chars"] = F.when(cut["_cut"].isNull(), was["n_chars"]).otherwise(F.length(cut["_cut"]).cast(types["n_chars"]))
    return joined.select(*[(new | {k: v for k, v in was.items() if k not in new})[c].alias(c) for c in columns])
