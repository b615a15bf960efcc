"""Alignment and models in padded batches against one row at a time."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noria.functions import models
from noria.operators import alignment


def plain_path(e, tokens):
    """The trellis by loops; of equal ways into a token the move is taken."""
    t, n = len(e), len(tokens)
    if not n or t < n:
        return None
    best = [[0.0] + [-np.inf] * n]
    for i in range(t):
        best.append([best[i][0] + e[i][0]] + [max(best[i][j] + e[i][0], best[i][j - 1] + e[i][tokens[j - 1]]) for j in range(1, n + 1)])
    if not np.isfinite(best[t][n]):
        return None
    out, j = [], n
    for i in range(t, 0, -1):
        if j and best[i - 1][j - 1] + e[i - 1][tokens[j - 1]] >= best[i - 1][j] + e[i - 1][0]:
            out.append((i - 1, float(e[i - 1][tokens[j - 1]])))
            j -= 1
    return None if j else out[::-1]


def lattices():
    rng, np_rng = random.Random(3), np.random.default_rng(3)
    rows = []
    for k in range(120):
        t, n, v = rng.randrange(1, 40), rng.randrange(0, 12), rng.choice((4, 6))
        e = np_rng.integers(-3, 1, (t, v)).astype(float) if k % 2 else np_rng.normal(size=(t, v))  # integers tie
        if k % 7 == 0:
            e[np_rng.integers(0, t), :] = -np.inf
        rows.append((e, np.array([rng.randrange(1, v) for _ in range(n)], np.int64)))
    return rows


@pytest.mark.parametrize("scores, decision_bytes", [(1 << 21, 1 << 25), (200, 1 << 25), (1 << 21, 40), (1, 1)])
def test_best_paths(scores, decision_bytes):
    rows = lattices()
    got = alignment.best_paths([e for e, _ in rows], [t for _, t in rows], 0, scores, decision_bytes)
    for (e, tokens), found in zip(rows, got, strict=True):
        want = plain_path(e, tokens.tolist())
        assert (found is None) == (want is None)
        if want is not None:
            assert list(zip(found[0].tolist(), found[1].tolist())) == want
    assert sum(f is None for f in got) > 10


def test_a_long_row_is_kept_here_and_there():
    rng = np.random.default_rng(1)
    e, tokens = rng.normal(size=(4000, 8)), rng.integers(1, 8, 900)
    whole = alignment.best_paths([e], [tokens])[0]
    parts = alignment.best_paths([e], [tokens], decision_bytes=1 << 14)[0]
    assert (whole[0] == parts[0]).all() and (np.diff(whole[0]) > 0).all()


def test_rows_step_together(monkeypatch):
    steps = []
    step = alignment.Lattice.step
    monkeypatch.setattr(alignment.Lattice, "step", lambda self, *a: steps.append(1) or step(self, *a))
    rng = np.random.default_rng(2)
    rows = [(rng.normal(size=(50, 5)), rng.integers(1, 5, 9)) for _ in range(100)]
    alignment.best_paths([e for e, _ in rows], [t for _, t in rows])
    assert len(steps) == 50  # not 5000


def test_aligned_column(spark):
    rows = lattices()
    flat = [(k, e.tolist(), t.tolist()) for k, (e, t) in enumerate(rows)] + [(900, None, [1]), (901, [[0.0, 1.0]], None), (902, [], [1]), (903, [[0.0, None]], [1]), (904, [None], [1])]
    df = spark.createDataFrame(flat, "k int, e array<array<double>>, t array<int>").repartition(3)
    got = {r["k"]: None if r["p"] is None else [(x["token"], x["score"]) for x in r["p"]] for r in df.select("k", alignment.aligned(F.col("e"), F.col("t")).alias("p")).collect()}
    want = {k: plain_path(e, t) if e and t and all(f is not None and None not in f for f in e) else None for k, e, t in flat}
    assert got == want


# models


def stubs():
    """(codec, broken codec, frames of lengths). Functions in a function, so that workers get them by value."""

    def codec():
        """Mean and peak of every eight samples. What pads a row has no part in its own frames."""

        def encode(padded, lengths):
            parts = padded.reshape(len(padded), -1, 8)
            real = np.arange(padded.shape[1])[None, :] < lengths[:, None]
            n = np.maximum(real.reshape(parts.shape).sum(-1), 1)
            return np.stack([parts.sum(-1) / n, np.abs(parts).max(-1)], axis=-1)

        return encode

    def zeros():
        return lambda padded, lengths: np.zeros((len(padded), padded.shape[1] // 8, 2))

    return codec, zeros, lambda lengths: -(-lengths // 8)


def test_ragged_model(spark):
    codec, _, frames = stubs()
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 1) for _ in range(n)]) for k, n in enumerate([0, 1, 7, 8, 9, 63, 64, 65, 300] + [rng.randrange(1, 200) for _ in range(60)])]
    rows += [(100, None)]
    df = spark.createDataFrame(rows, "k int, x array<double>")
    found = []
    for parts, size in itertools.product((1, 4), (8, 400, 1 << 20)):
        done = models.ragged_model(df.repartition(parts), "x", "z", codec, frames, multiple=8, batch_values=size)
        assert done.columns == ["k", "x", "z"]
        found.append({r["k"]: r["z"] for r in done.collect()})
    assert all(f == found[0] for f in found)
    assert found[0][100] is None and found[0][0] == []
    for k, x in rows[1:-1]:
        want = [[np.mean(x[i : i + 8]), np.max(np.abs(x[i : i + 8]))] for i in range(0, len(x), 8)]
        np.testing.assert_allclose(found[0][k], want, atol=1e-6)


def test_a_model_that_gives_zeros(spark):
    _, zeros, frames = stubs()
    df = spark.createDataFrame([(1, [1.0, 2.0])], "k int, x array<double>")
    with pytest.raises(Exception, match="zeros only"):
        models.ragged_model(df, "x", "z", zeros, frames, multiple=8).collect()
    silent = spark.createDataFrame([(1, [0.0, 0.0])], "k int, x array<double>")
    assert models.ragged_model(silent, "x", "z", zeros, frames, multiple=8).first()["z"] == [[0.0, 0.0]]
