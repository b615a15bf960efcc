"""Long series in blocks, numbers within hot keys and exact quantiles, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noria.operators import blocks, metrics, ordering, quantiles, signal

KEYS = [1, 2, None]


@pytest.fixture(scope="module")
def tracks():
    """Three keys, one of them null and one with most rows; values with ties."""
    rng = random.Random(8)
    sizes = {1: 900, 2: 1, None: 37}
    return {k: [(round(rng.gauss(0, 3), 1), rng.random() < 0.7) for _ in range(n)] for k, n in sizes.items()}


@pytest.fixture(scope="module")
def rows(spark, tracks):
    flat = [(k, i, x, f) for k, t in tracks.items() for i, (x, f) in enumerate(t)]
    random.Random(1).shuffle(flat)
    return spark.createDataFrame(flat, "k long, i long, x double, f boolean").repartition(5).cache()


def by_key(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r["k"], []).append(tuple(r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


def plain_runs(flags):
    found, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        if not f and start is not None:
            found.append((start, i - start))
            start = None
    return found


@pytest.mark.parametrize("size", [1, 2, 7, 64, 4096])
def test_runs(rows, tracks, size):
    want = {k: plain_runs([f for _, f in t]) for k, t in tracks.items()}
    assert by_key(blocks.runs(rows, ["k"], "f", size), "start", "length") == {k: v for k, v in want.items() if v}
    best = by_key(signal.longest_run(rows, ["k"], "f", size), "start", "length")
    assert best == {k: [max(v, key=lambda r: (r[1], -r[0]), default=(0, 0))] for k, v in want.items()}


def test_runs_of_all_and_none(spark):
    df = spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.lit(True).alias("f"))
    assert by_key(blocks.runs(df, ["k"], "f", 10), "start", "length") == {1: [(0, 100)]}
    assert blocks.runs(df.withColumn("f", F.lit(None).cast("boolean")), ["k"], "f", 10).count() == 0
    assert by_key(signal.longest_run(df.withColumn("f", ~F.col("f")), ["k"], "f", 10), "start", "length") == {1: [(0, 0)]}


@pytest.mark.parametrize("size", [3, 10, 4096])
def test_halo_windows_equal_whole_windows(rows, tracks, size):
    got = by_key(blocks.moving_mean(rows, ["k"], "x", 3, "m", size=size), "i", "m")
    for k, t in tracks.items():
        x = [v for v, _ in t]
        want = [(i, sum(x[i - 2 : i + 1]) / 3) for i in range(2, len(x))]
        assert len(got.get(k, [])) == len(want)
        for (i, m), (j, w) in zip(got.get(k, []), want):
            assert i == j and m == pytest.approx(w)


def test_speech_edges_over_block_edges(spark):
    rng = random.Random(6)
    tracks = {k: [rng.random() < 0.6 for _ in range(n)] for k, n in enumerate((1, 2, 5, 40, 41, 100))}
    df = spark.createDataFrame([(k, i, f) for k, t in tracks.items() for i, f in enumerate(t)], "k long, i long, f boolean")
    n = F.element_at(F.create_map(*[F.lit(x) for k, t in tracks.items() for x in (k, len(t))]), F.col("k").cast("int"))
    for size in (4, 16, 4096):
        got = by_key(signal.speech_edges(df, "k", "f", 3, F.floor(n / 3), F.floor(n / 2), size), "first_start", "last_end")
        for k, t in tracks.items():
            ahead = [i for i in range(len(t) // 2, len(t)) if all(t[i : i + 3])]
            behind = [i for i in range(3, len(t) // 3 + 1) if all(t[i - 3 : i])]
            assert got[k] == [(max(behind, default=0), min(ahead, default=len(t)))]


def test_halo_wider_than_a_block(rows):
    with pytest.raises(ValueError):
        blocks.with_halo(rows, 5, 0, 4)


@pytest.mark.parametrize("size", [2, 5, 30, 4096])
def test_affine_scan(rows, tracks, size):
    df = rows.withColumn("a", F.col("x") / 4).withColumn("b", F.col("x") + 1)
    got = by_key(blocks.affine_scan(df, ["k"], "a", "b", F.lit(2.0), "s", size=size), "i", "s")
    for k, t in tracks.items():
        s = 2.0
        for i, (x, _) in enumerate(t):
            s = x / 4 * s + x + 1
            assert got[k][i][0] == i and got[k][i][1] == pytest.approx(s, rel=1e-9, abs=1e-9)


def test_ema_steps(rows, tracks):
    got = by_key(metrics.ema_steps(rows.withColumnRenamed("i", "at"), ["k"], ["at"], "x", 0.8, size=16), "i", "ema")
    for k, t in tracks.items():
        s = t[0][0]
        for i, (x, _) in enumerate(t):
            s = s if i == 0 else 0.8 * s + 0.2 * x
            assert got[k][i][1] == pytest.approx(s)


def test_a_hot_key_fills_all_tasks(spark):
    df = spark.range(0, 200_000, numPartitions=3).select(F.lit("all").alias("k"), (-F.col("id")).alias("at"), F.lit(1.0).alias("x"))
    found = ordering.number_within(df, ["k"], ["at"], "i")
    assert found.where(F.col("i") != 199_999 + F.col("at")).count() == 0
    blocked = blocks.with_halo(found, 2, 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per = [r["n"] for r in blocked.repartition("k", "_block").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per) == 4 and max(per) < 0.5 * sum(per)


def test_numbers_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (None, None), ("a", 2), ("a", 2), ("a", 1)], "k string, at int").repartition(3)
    got = by_key(ordering.number_within(df, ["k"], ["at"], "i"), "i")
    assert got == {None: [(0,), (1,), (2,)], "a": [(0,), (1,), (2,)]}
    assert ordering.number_within(df.limit(0), ["k"], ["at"], "i").count() == 0


VALUES = {
    "normal": np.random.default_rng(1).normal(size=3000),
    "ties": np.random.default_rng(2).integers(0, 5, 3000).astype(float),
    "one": np.array([4.0]),
    "same": np.full(500, 7.0),
    "wide": np.concatenate([np.random.default_rng(3).lognormal(0, 60, 2000), [1e308, -1e308, 0.0, -0.0]]),
    "infinite": np.concatenate([np.arange(300.0), [np.inf] * 300, [-np.inf] * 300]),
    "half": np.concatenate([np.zeros(1500), np.random.default_rng(4).normal(size=1500)]),
    "few": np.arange(10.0),
}
FRACTIONS = [0.0, 0.03, 0.25, 0.5, 0.501, 0.9, 0.999, 1.0]


@pytest.fixture(scope="module")
def values(spark):
    flat = [(k, float(v)) for k, x in VALUES.items() for v in x] + [("nulls", None), (None, 3.0), (None, 5.0), ("normal", None)]
    random.Random(2).shuffle(flat)
    return spark.createDataFrame(flat, "k string, v double").repartition(4).cache()


@pytest.mark.parametrize("limit", [5, 100, 1 << 16])
def test_quantiles(values, limit):
    got = {r["k"]: r["q"] for r in quantiles.exact_quantiles(values, ["k"], "v", FRACTIONS, limit).collect()}
    assert set(got) == {*VALUES, None}
    assert got[None][3] == 4.0
    for k, x in VALUES.items():
        if k == "infinite":
            assert got[k][0] == -np.inf and got[k][-1] == np.inf and got[k][3] == pytest.approx(149.0, abs=1)
            continue
        np.testing.assert_allclose(got[k], np.quantile(x, FRACTIONS), rtol=1e-12)


def test_quantiles_of_the_whole(values):
    every = np.concatenate([x for k, x in VALUES.items() if k != "infinite"])
    some = values.where("k <> 'infinite' AND k IS NOT NULL")
    for limit in (50, 1 << 16):
        assert quantiles.exact_quantiles(some, [], "v", [0.03, 0.5], limit).first()["q"] == pytest.approx(np.quantile(every, [0.03, 0.5]).tolist())
    assert quantiles.exact_quantiles(some.limit(0), [], "v", [0.5]).count() == 0
    with pytest.raises(ValueError):
        quantiles.exact_quantiles(some, [], "v", [1.5])


def test_hot_thresholds_are_the_same(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, i, float(x)) for k in (1, 2) for i, x in enumerate(rng.normal(-40, 12, 400))], "k long, i long, x double")
    assert by_key(signal.thresholds(df, "k", hot=True), "threshold") == by_key(signal.thresholds(df, "k"), "threshold")
