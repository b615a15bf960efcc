"""Quality rules by weak supervision.

Each rule looks at a few counts of a document and votes good (1), bad (0) or abstains (-1). Several
rules look at the same fault from different sides, so that agreement carries information: junk
that one rule sees, others see, too, and a lone bad vote is mostly an error of its rule.
Expectation-maximisation fits, without labels, a mixture of good documents and KINDS of junk: the share of
each and, for each rule, how often it votes bad on each when it votes. ``accuracies`` reads off how often rules are
right. The posterior probability of being good then decides, in place of all-must-pass filtering.

A fitted kind whose documents get less than AGREE bad votes on average is no junk, whatever it started as:
its documents count as good. Nothing else is fixed: shares and rates are free.

Counts come from one pass over the whole texts (NumPy on Arrow batches, no shuffle). A document
enters EM only through its pattern of votes, of which there are at most 3**len(RULES) (59,049), so a
map-side-combined count per pattern holds all documents and the driver sees only those counts.

Null or empty text: no words, counts 0, base_failed. Very long texts are counted whole, one at a time. Repeated rows are
judged alike. An empty table gives an empty result. Only the named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .tables import clean_input, stored, without_ids
from .workers import tidy

MIN_WORDS, REPEAT_WINDOW, REPEAT_SHARE = 20, 8, 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_digits", "n_stops", "n_letter_words", "n_distinct", "n_same_next")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
_SYMBOL, _LETTER, _UPPER, _DIGIT, _STOP = (np.zeros(256, bool) for _ in range(5))
for table, chars in ((_SYMBOL, "#*$%&|<>"), (_UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_LETTER, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), (_DIGIT, "0123456789"), (_STOP, ".,;:!?")):
    table[np.frombuffer(chars.encode(), np.uint8)] = True
_LETTER[0xC3:] = True  # lead bytes of letters beyond ASCII count as letters
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _seen_before(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether an earlier equal value of the same owner exists, whether any other does)."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    same = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    again, twice = np.zeros(len(v), bool), np.zeros(len(v), bool)
    again[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return again, twice


def count_block(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The COUNTS of each text of a block."""
    starts, ends, first = wh.spans(data, offsets)
    out = {"n_words": np.diff(first)}
    out["word_chars"] = _per_text(((data & 0xC0) != 0x80) & ~wh.SPACE[data], offsets)
    for name, table in (("n_symbols", _SYMBOL), ("n_letters", _LETTER), ("n_upper", _UPPER), ("n_digits", _DIGIT)):
        out[name] = _per_text(table[data], offsets)
    word = wh.hashes(data, starts, ends)
    out["n_stops"] = _per_text(_STOP[data[ends - 1]], first)
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LETTER[data], out=letters[1:])
    out["n_letter_words"] = _per_text(letters[ends] > letters[starts], first)
    out["n_distinct"] = np.diff(wh.distinct_within(word, first)[1])
    same = np.zeros(len(word), bool)
    same[1:] = word[1:] == word[:-1]
    same[first[:-1][first[:-1] < first[1:]]] = False
    out["n_same_next"] = _per_text(same, first)
    # lines: a text's first line starts at the text, others after a \n
    ls, le, lf = wh.spans(data, offsets, _LINE)
    spoken = np.searchsorted(starts, le) > np.searchsorted(starts, ls)  # a word starts inside the line
    lo = wh.owners(lf, np.arange(len(ls)))[spoken]
    line = wh.hashes(data, ls, le)[spoken]
    out["n_lines"] = np.bincount(lo, minlength=len(offsets) - 1)
    out["n_dup_lines"] = np.bincount(lo[_seen_before(line, lo)[0]], minlength=len(offsets) - 1)
    at, win = wh.windows(word, first, REPEAT_WINDOW)
    twice = at[_seen_before(win, wh.owners(first, at))[1]] if len(at) else at
    edge = np.zeros(len(word) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = _per_text(np.cumsum(edge)[:-1] > 0, first)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for row, data, offsets in wh.blocks(batch.column(1)):
            got = count_block(data, offsets)
            n = len(offsets) - 1
            yield pa.RecordBatch.from_arrays([ids.slice(row, n), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", *COUNTS])


def counts(docs: DataFrame) -> DataFrame:
    """One row of COUNTS per document."""
    return clean_input(docs, "doc_id", "text").mapInArrow(tidy(_count), SCHEMA)


def _vote(bad, good=None):
    """0 where bad, 1 where good, else -1. Without good: 1 where not bad."""
    return F.when(bad, 0).when(F.lit(True) if good is None else good, 1).otherwise(-1)


def rules() -> dict[str, F.Column]:
    """Votes over the COUNTS; texts of a few words abstain where a share says little."""
    c, n, chars = F.col, F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    long = c("n_words") >= 50
    return {
        "signs": _vote(c("n_symbols") * 4 >= n, c("n_symbols") * 20 <= n),
        "sign_share": _vote(c("n_symbols") * 12 >= chars, c("n_symbols") * 50 <= chars),
        "bare_words": _vote(c("n_letter_words") * 4 <= n * 3, c("n_letter_words") * 10 >= n * 9),
        "word_length": _vote((chars >= n * 7) | (chars <= n * 3), (chars >= n * 4) & (chars * 2 <= n * 13)),
        "stops": _vote(c("n_stops") * 20 <= n, (c("n_stops") * 50 >= n * 4) & (c("n_stops") * 2 <= n)),
        "variety": _vote(c("n_distinct") * 100 <= F.least(n, F.lit(1000)) * 30, c("n_distinct") * 10 >= F.least(n, F.lit(1000)) * 5),
        "doubled": _vote(c("n_same_next") * 10 >= n, c("n_same_next") * 50 <= n),
        "repeats": _vote(c("n_repeat_words") * 8 >= n, c("n_repeat_words") * 50 <= n),
        "lines": _vote((c("n_lines") >= 4) & (c("n_dup_lines") * 4 >= c("n_lines")), c("n_dup_lines") * 20 <= c("n_lines")),
        "capitals": _vote(long & (c("n_upper") * 3 >= c("n_letters")), c("n_upper") * 10 <= c("n_letters")),
    }


RULES = ("signs", "sign_share", "bare_words", "word_length", "stops", "variety", "doubled", "repeats", "lines", "capitals")
#: Kinds of junk by the rules that see each at the start of the fit.
KINDS = (("signs", "sign_share", "word_length", "stops"), ("signs", "sign_share", "bare_words"), ("variety", "doubled", "stops"), ("repeats", "lines", "variety"))
#: Bad votes that the documents of a kind of junk get on average, at least.
AGREE = 1.5


def fit(patterns: np.ndarray, weights: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over distinct vote patterns: (share of each class, bad[class, rule], which classes are junk). Class 0 is good, the others start as KINDS.

    bad is the probability of a bad vote of a rule that votes; an abstention says nothing. Every rate has
    one vote either way as a prior, so that no rate is 0 or 1.
    """
    m = patterns.shape[1] if patterns.ndim == 2 and patterns.size else len(RULES)
    bad = np.full((1 + len(KINDS), m), 0.05)
    for k, seen in enumerate(KINDS, 1):
        for r in seen:
            bad[k, RULES.index(r)] = 0.9
    share = np.array([0.8] + [0.2 / len(KINDS)] * len(KINDS))
    if not weights.sum():
        return share, bad, np.arange(len(share)) > 0
    is_bad, is_good = (patterns == 0).astype(float), (patterns == 1).astype(float)
    for _ in range(rounds):
        own = classes(patterns, share, bad) * weights[:, None]
        new_share = (own.sum(0) + 1) / (own.sum() + len(share))
        of_bad, of_good = own.T @ is_bad, own.T @ is_good
        new = (of_bad + 1) / (of_bad + of_good + 2)
        done = np.abs(new - bad).max() < 1e-9 and np.abs(new_share - share).max() < 1e-9
        share, bad = new_share, new
        if done:
            break
    own = classes(patterns, share, bad) * weights[:, None]
    junk = own.T @ is_bad.sum(axis=1) >= AGREE * own.sum(0)
    junk[0] = False
    return share, bad, junk


def classes(patterns: np.ndarray, share: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Posterior probability of each class for each pattern."""
    score = np.log(share) + (patterns == 0).astype(float) @ np.log(bad).T + (patterns == 1).astype(float) @ np.log1p(-bad).T
    score = np.exp(score - score.max(axis=1, keepdims=True))
    return score / score.sum(axis=1, keepdims=True)


def posterior(patterns: np.ndarray, share: np.ndarray, bad: np.ndarray, junk: np.ndarray) -> np.ndarray:
    """Probability of good for each pattern."""
    return classes(patterns, share, bad)[:, ~junk].sum(axis=1)


def accuracies(share: np.ndarray, bad: np.ndarray, junk: np.ndarray) -> dict[str, tuple[float, float]]:
    """For each rule that votes: how often it calls a good document good, and a bad one bad."""
    of = lambda which: (share[which, None] * bad[which]).sum(0) / max(share[which].sum(), 1e-12)
    return {r: (float(1 - g), float(b)) for r, g, b in zip(RULES, of(~junk), of(junk), strict=True)}


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """COUNTS, base_failed, the votes' pattern, p_good and kept for every document."""
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    rated = counts(docs).withColumns({"base_failed": (n < MIN_WORDS) | (100 * repeats > REPEAT_SHARE * n), "pattern": F.concat_ws(",", *[r.cast("string") for r in rules().values()])})
    rated = stored(rated, "quality")
    # rules judge only what passes the base rules: the others go in any case
    seen = rated.where(~F.col("base_failed")).groupBy("pattern").count().collect()  # at most 3**10 rows
    names = [r["pattern"] for r in seen]
    votes = np.array([[int(v) for v in x.split(",")] for x in names], dtype=int).reshape(len(names), len(RULES))
    fitted = fit(votes, np.array([r["count"] for r in seen], dtype=float))
    good = posterior(votes, *fitted) if names else []
    spark = docs.sparkSession
    verdicts = spark.createDataFrame([(x, float(g)) for x, g in zip(names, good, strict=True)], "pattern string, p_good double")
    return rated.join(F.broadcast(verdicts), "pattern", "left").withColumn("kept", ~F.col("base_failed") & (F.coalesce("p_good", F.lit(0.0)) >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns. Rows without doc_id stay."""
    return without_ids(docs, judge(docs, threshold).select("doc_id", "kept"))
