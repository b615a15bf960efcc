"""Forced alignment of an utterance: best path through frames of log scores, and word spans from it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FRAMES = "array<struct<token: int, score: double>>"
#: Scores that a batch of rows holds padded, and bytes of its decisions; a row that takes more is alone, its states kept here and there only.
BATCH_SCORES = 1 << 21
DECISION_BYTES = 32 << 20


class Lattice:
    """The trellises of a batch of rows, stepped through together.

    emissions: (rows, frames, ids), tokens: (rows, most tokens), both padded; lengths and counts: what is real of each. Each frame
    stays (blank) or moves to the next token; where both are as good, it moves.
    """

    def __init__(self, emissions: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, counts: np.ndarray, blank: int = 0):
        self.emissions, self.lengths, self.tokens, self.counts, self.blank = emissions, lengths, tokens, counts, blank
        self.rows, self.steps = emissions.shape[:2]
        self.row = np.arange(self.rows)[:, None]

    def step(self, state: np.ndarray, t: int, moves: np.ndarray | None = None) -> np.ndarray:
        """The state after frame t, (rows, tokens + 1); rows that have ended keep theirs. moves: takes which tokens are reached by a move."""
        frame = self.emissions[:, t]
        stay = state + frame[:, self.blank][:, None]
        move = state[:, :-1] + frame[self.row, self.tokens]
        by_move = move >= stay[:, 1:]
        if moves is not None:
            moves[:] = np.packbits(by_move, axis=1)
        after = stay
        np.copyto(after[:, 1:], move, where=by_move)
        return np.where((t < self.lengths)[:, None], after, state)

    def first_state(self) -> np.ndarray:
        state = np.full((self.rows, self.tokens.shape[1] + 1), -np.inf)
        state[:, 0] = 0.0
        return state

    def paths(self, decision_bytes: int = DECISION_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """(whether a row can be aligned, the frame that speaks each token first).

        Decisions are a bit each. If they take more than ``decision_bytes``, states are kept every so many frames instead, and decisions made again
        from the last state before, block by block, as the way back comes to it.
        """
        width = -(-self.tokens.shape[1] // 8)
        each = max(1, self.rows * width)
        run = self.steps if self.steps * each <= decision_bytes else max(1, min(int(np.sqrt(self.steps)) + 1, decision_bytes // each))
        state, kept = self.first_state(), {}
        moves = np.zeros((min(run, self.steps), self.rows, width), np.uint8)
        for t in range(self.steps):
            if t % run == 0:
                kept[t] = state
            state = self.step(state, t, moves[t % run] if run >= self.steps else None)
        good = (self.counts > 0) & (self.lengths >= self.counts) & np.isfinite(state[np.arange(self.rows), self.counts])
        at, frames = np.where(good, self.counts, 0), np.zeros(self.tokens.shape, np.int64)
        rows = np.arange(self.rows)
        for begin in sorted(kept, reverse=True):
            if run < self.steps:
                state = kept.pop(begin)
                for t in range(begin, min(begin + run, self.steps)):
                    state = self.step(state, t, moves[t - begin])
            for t in range(min(begin + run, self.steps) - 1, begin - 1, -1):
                place = np.maximum(at - 1, 0)
                bit = moves[t - begin, rows, place >> 3] >> (7 - (place & 7)) & 1
                moved = np.flatnonzero((bit == 1) & (at > 0) & (t < self.lengths))
                frames[moved, place[moved]] = t
                at[moved] -= 1
        return good & (at == 0), frames


def best_paths(emissions: list[np.ndarray], tokens: list[np.ndarray], blank: int = 0, scores: int = BATCH_SCORES, decision_bytes: int = DECISION_BYTES) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Of each row (frames and scores of its tokens), None if it can't be aligned. Rows of like length are padded to one batch of at most ``scores`` scores."""
    out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(emissions)
    todo = sorted((k for k in range(len(emissions)) if len(tokens[k]) and len(emissions[k]) >= len(tokens[k])), key=lambda k: (emissions[k].shape[1], len(emissions[k])))
    begin = 0
    while begin < len(todo):
        ids, end, widest = emissions[todo[begin]].shape[1], begin, 0
        while end < len(todo) and emissions[todo[end]].shape[1] == ids:
            most = max(widest, len(tokens[todo[end]]))
            if end > begin and (end + 1 - begin) * len(emissions[todo[end]]) * max(ids, most) > scores:
                break
            widest, end = most, end + 1
        batch = todo[begin:end]
        lengths, counts = (np.array([len(x[k]) for k in batch]) for x in (emissions, tokens))
        padded, said = np.zeros((len(batch), lengths.max(), ids)), np.zeros((len(batch), widest), np.int64)
        for i, k in enumerate(batch):
            padded[i, : lengths[i]], said[i, : counts[i]] = emissions[k], tokens[k]
        good, frames = Lattice(padded, lengths, said, counts, blank).paths(decision_bytes)
        for i in np.flatnonzero(good).tolist():
            at = frames[i, : counts[i]]
            out[batch[i]] = (at, padded[i, at, said[i, : counts[i]]])
        begin = end
    return out


def best_path(emissions: np.ndarray, tokens: np.ndarray, blank: int = 0) -> list[tuple[int, float]] | None:
    """(frame, score) of each token of one row; None if there is no alignment."""
    found = best_paths([np.asarray(emissions, float)], [np.asarray(tokens, np.int64)], blank)[0]
    return None if found is None else [(int(f), float(x)) for f, x in zip(*found, strict=True)]


def _frames_of(lists: pa.Array) -> list[np.ndarray | None]:
    """(frames, ids) of each row of a column of arrays of arrays; null where a row, a frame or a score is."""
    out = []
    for row in lists:
        if not row.is_valid or row.values.null_count or row.values.flatten().null_count:
            out.append(None)
            continue
        flat, sizes = np.asarray(row.values.flatten(), float), np.asarray(row.values.value_lengths())
        if len(sizes) and (sizes != sizes[0]).any():
            raise ValueError("frames of one row have different numbers of scores")
        out.append(flat.reshape(len(sizes), int(sizes[0]) if len(sizes) else 0))
    return out


def aligned(emissions: Column, tokens: Column) -> Column:
    """Array of (frame, score) per token, null where the text can't be aligned. emissions: array<array<double>>. Rows are aligned in padded batches."""

    @F.arrow_udf(_FRAMES)
    def run(e: pa.Array, t: pa.Array) -> pa.Array:
        frames = _frames_of(e)
        said = [np.asarray(x.values, np.int64) if x.is_valid else None for x in t]
        there = [k for k, (f, x) in enumerate(zip(frames, said, strict=True)) if f is not None and x is not None]
        found = dict(zip(there, best_paths([frames[k] for k in there], [said[k] for k in there]), strict=True))
        paths = [found.get(k) for k in range(len(frames))]
        ends = np.cumsum([0] + [0 if p is None else len(p[0]) for p in paths])
        flat = [np.concatenate([np.zeros(0), *(p[i] for p in paths if p is not None)]) for i in (0, 1)]
        parts = pa.StructArray.from_arrays([pa.array(flat[0].astype(np.int32)), pa.array(flat[1])], ["token", "score"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts, mask=pa.array([p is None for p in paths]))

    return run(emissions, tokens)


def spoken_tokens(words: Column, table: dict[str, int], delimiter: int) -> Column:
    """token and word of each character of an array of words that the table knows; others are skipped. Words are parted by the delimiter, of word -1."""
    known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])

    def one(word: Column, i: Column) -> Column:
        ids = F.filter(F.transform(F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0)), lambda c: F.try_element_at(known, c)), lambda t: t.isNotNull())
        own = F.transform(ids, lambda t: F.struct(t.alias("token"), i.cast("int").alias("word")))
        gap = F.array(F.struct(F.lit(delimiter).alias("token"), F.lit(-1).alias("word")))
        return F.when(i > 0, F.concat(gap, own)).otherwise(own)

    return F.flatten(F.transform(words, one))


def token_frames(rows: DataFrame) -> DataFrame:
    """id, word_idx, frame and score of each aligned token, by position, from path (array of token frame and score) and owners (its tokens' words)."""
    zipped = rows.where("path IS NOT NULL").select("id", F.inline(F.arrays_zip(F.col("path.token").alias("frame"), F.col("owners").alias("word_idx"), F.col("path.score").alias("score"))))
    return zipped.select("id", "word_idx", "frame", "score")


def words_with_spans(words: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, word_idx, word) with start and end; null for a word of which no token was aligned."""
    return words.join(spans, ["id", "word_idx"], "left")


def job_counters(rows: DataFrame) -> DataFrame:
    """One row: aligned, failed, unreadable and diac_mismatch, from emissions, path and diac_ok."""
    read = F.col("emissions").isNotNull()
    return rows.agg(
        F.count_if(F.col("path").isNotNull()).alias("aligned"),
        F.count_if(read & F.col("path").isNull()).alias("failed"),
        F.count_if(~read).alias("unreadable"),
        F.count_if(F.col("path").isNotNull() & ~F.coalesce("diac_ok", F.lit(True))).alias("diac_mismatch"),
    )


def extended_edges(start: Column, end: Column, first: Column, last: Column, hop: float, duration: Column) -> tuple[Column, Column]:
    """(start, end) of an utterance's speech moved out to silent frames ``first`` and ``last``, within the audio; null stays null."""
    begin = F.when(start.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(start, first * hop)), 3))
    return begin, F.when(end.isNotNull(), F.round(F.least(duration, F.greatest(end, last * hop)), 3))


def word_spans(frames: DataFrame, seconds_per_frame: Column) -> DataFrame:
    """start and end in seconds of each word from (id, word_idx, frame); delimiters (word_idx < 0) don't count."""
    spoken = frames.where("word_idx >= 0").withColumn("_s", seconds_per_frame)
    return spoken.groupBy("id", "word_idx").agg(F.round(F.min(F.col("frame") * F.col("_s")), 3).alias("start"), F.round(F.max((F.col("frame") + 1) * F.col("_s")), 3).alias("end"))


def countdown(logits: Column, threshold: float, extra: int) -> Column:
    """Frames kept of a row that ends ``extra`` frames after the first logit above the threshold; all if none is."""
    fired = F.array_position(F.transform(logits, lambda x: x > threshold), True)
    return F.when(fired > 0, F.least(fired - 1 + extra, F.size(logits))).otherwise(F.size(logits)).cast("int")
