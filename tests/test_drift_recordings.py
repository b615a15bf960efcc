"""Drift statistics, resampling and recordings in blocks against NumPy on whole arrays."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from noria.functions import resampling
from noria.operators import drift, recordings, signal
from noria.sources import wav


def plain_drift(data, made, temp, normalise=True):
    """log mass and force of one group by loops over its generated vectors."""
    n, dim = made.shape
    every = np.vstack([data, made])
    d = np.sqrt(np.maximum(((made[:, None] - every[None]) ** 2).sum(-1), 1e-8))
    scale = max(1e-3, d.mean() * (n + 1) / n)
    z = -d / scale
    for i in range(n):
        z[i, i + 1] -= 100.0
    z /= temp
    share = lambda a, axis: np.exp(a - a.max(axis, keepdims=True)) / np.exp(a - a.max(axis, keepdims=True)).sum(axis, keepdims=True)
    w = np.sqrt(np.maximum(share(z, 1) * share(z, 0), 1e-6))
    unit = np.sqrt(dim) / scale
    force = np.zeros_like(made)
    for i in range(n):
        force[i] = w[i, 0] * w[i, 1:].sum() * (data - made[i]) - sum(w[i, j + 1] * w[i, 0] * (made[j] - made[i]) for j in range(n))
    return np.log(share(z, 1)[:, 0]) + np.log(n), force * unit, made * unit


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(4)
    found = {g: rng.normal(size=(rng.integers(2, 9), 6)) * (1 + g) for g in range(12)}
    found[5][2] = found[5][1]  # two generated vectors at one place
    rows = [(g, s, v.tolist()) for g, vs in found.items() for s, v in enumerate(vs)]
    rows += [(50, 0, [1.0] * 6), (51, 1, [1.0] * 6), (51, 2, [2.0] * 6)]  # nothing generated; no data vector
    return found, spark.createDataFrame(rows, "group long, slot long, v array<double>")


@pytest.mark.parametrize("normalise", [None, "group", "batch"])
def test_drift(groups, normalise):
    found, rows = groups
    got = {(r["group"], r["slot"]): r for r in drift.drift(rows, 0.7, normalise).collect()}
    plain = {g: plain_drift(v[0], v[1:], 0.7) for g, v in found.items()}
    rms = {g: np.sqrt(max(1e-8, (f**2).mean())) for g, (_, f, _) in plain.items()}
    assert set(got) == {(g, s) for g, v in found.items() for s in range(1, len(v))}
    for g, (mass, force, x) in plain.items():
        by = {None: 1.0, "group": rms[g], "batch": np.mean(list(rms.values()))}[normalise]
        for s in range(len(mass)):
            r = got[g, s + 1]
            np.testing.assert_allclose([r["log_mass"], *r["force"], *r["x"]], [mass[s], *(force[s] / by), *x[s]], rtol=1e-9, atol=1e-9)


def test_drift_metrics(groups):
    found, rows = groups
    r = drift.drift_metrics(drift.drift(rows, 0.7, "group")).first()
    plain = [plain_drift(v[0], v[1:], 0.7) for v in found.values()]
    loss = np.mean([(f**2).mean() / max(1e-8, (f**2).mean()) for _, f, _ in plain])
    assert r["loss"] == pytest.approx(loss) and r["temp_loss"] == pytest.approx(-np.mean([m.max() for m, *_ in plain]))
    several = [np.linalg.norm(x.std(0, ddof=1)) for *_, x in plain if len(x) > 1]
    assert r["std_mean"] == pytest.approx(np.mean(several))  # a single vector has no deviation


def test_drift_shuffles_by_group_only(groups):
    plan = drift.kernel(groups[1])._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def direct(x, up, down):
    h = resampling.low_pass(up, down)
    filled = np.zeros(len(x) * up)
    filled[::up] = x
    half = len(h) // 2
    return np.convolve(filled, h)[half : half + len(filled)][::down]


RATIOS = [(16000, 24000), (24000, 16000), (44100, 16000), (160, 147), (147, 160), (1, 5), (5, 1)]


@pytest.mark.parametrize("source, target", RATIOS)
def test_resample_equals_direct_filtering(source, target):
    rng = np.random.default_rng(source)
    up, down = resampling.ratio(source, target)
    for n in (1, 2, 7, 500, 3001):
        x = rng.normal(size=n)
        np.testing.assert_allclose(resampling.resample_range(x, 0, 0, resampling.outputs(n, up, down), up, down), direct(x, up, down), atol=1e-9)
    assert resampling.low_pass(up, down).sum() == pytest.approx(up)


def test_a_tone_stays_a_tone():
    at = lambda rate, n: np.sin(2 * np.pi * 440 * np.arange(n) / rate)
    got = resampling.resample(at(44100, 44100), 44100, 16000)
    assert got.dtype == np.float32 and len(got) == 16000
    assert np.abs(got - at(16000, 16000))[200:-200].max() < 2e-3
    same = at(8000, 100)
    assert resampling.resample(same, 8000, 8000) is same


@pytest.mark.parametrize("size", [64, 100, 1000, 5000])
@pytest.mark.parametrize("source, target", [(3, 2), (2, 3), (441, 160), (5, 5)])
def test_blocks_resampled_as_a_whole(spark, size, source, target):
    rng = np.random.default_rng(size)
    whole = {str(k): rng.normal(size=n) for k, n in enumerate((1, 63, 64, 65, 999, 4000))}
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in whole.items()] + [("none", None), ("empty", [])], "id string, s array<double>")
    got = {}
    for r in recordings.resample_column(rows, "id", "s", source, target, size).orderBy("key", "at").collect():
        assert r["at"] == len(got.get(r["key"], [])) and r["lead"] == 0
        got.setdefault(r["key"], []).extend(r["samples"])
    assert set(got) == set(whole)
    up, down = resampling.ratio(source, target)
    for k, x in whole.items():
        np.testing.assert_allclose(got[k], direct(x, up, down) if up != down else x, atol=1e-9)


def write(path, x, rate, channels=1, extra=b""):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.repeat((x * 32767).astype("<i2"), channels).tobytes())
    raw = out.getvalue()
    if extra:  # another chunk before the samples
        raw = raw[:4] + (len(raw) + len(extra) + len(extra) % 2).to_bytes(4, "little") + raw[8:12] + b"LIST" + len(extra).to_bytes(4, "little") + extra + b"\0" * (len(extra) % 2) + raw[12:]
    path.write_bytes(raw)


@pytest.mark.parametrize("rate", [None, 16000, 8000])
def test_recordings_in_blocks_equal_whole_files(spark, tmp_path, rate):
    rng = np.random.default_rng(1)
    files = {"long": (rng.uniform(-0.5, 0.5, 120 * 8000), 8000, 1, b""), "stereo": (rng.uniform(-0.5, 0.5, 11025 * 7 + 3), 11025, 2, b"odd"), "short": (rng.uniform(-0.5, 0.5, 50), 8000, 1, b""), "none": (np.zeros(0), 8000, 1, b"")}
    for name, (x, r, channels, extra) in files.items():
        write(tmp_path / f"{name}.wav", x, r, channels, extra)
    (tmp_path / "bad.wav").write_bytes(b"RIFFnothing")
    hop = 80
    blocks = wav.read_wav_blocks(spark, str(tmp_path), rate, hop=hop, seconds=3.0).cache()
    named = {n: [] for n in files}
    for r in blocks.orderBy("key", "at").collect():
        name = r["key"].rsplit("/", 1)[-1][:-4]
        if name == "bad":
            assert r["error"] and r["samples"] is None
            continue
        assert r["at"] == len(named[name]) and r["at"] % hop == 0
        named[name] += r["samples"]
    whole = {r["path"].rsplit("/", 1)[-1][:-4]: r["samples"] for r in wav.read_wav(spark, str(tmp_path), rate).where("error IS NULL").collect()}
    for name in files:
        np.testing.assert_allclose(named[name], whole[name] or [], atol=1e-6)
    assert blocks.where("key LIKE '%long%'").count() >= 40
    track = recordings.energy(blocks.where("error IS NULL"), hop)
    smooth = {(r["key"].rsplit("/", 1)[-1][:-4], r["i"]): r["x"] for r in signal.smooth3(track, "key").collect()}
    x = np.array(whole["long"], float)
    power = (x[: len(x) // hop * hop].reshape(-1, hop) ** 2).mean(1)
    want = np.convolve(10 * np.log10(power + 1e-12), np.ones(3) / 3, "same")
    np.testing.assert_allclose([smooth["long", i] for i in range(len(want))], want, atol=1e-4)
    assert not any(n == "short" for n, _ in smooth) or rate == 16000


def test_blocks_of_one_file_are_dealt_out(spark, tmp_path):
    write(tmp_path / "one.wav", np.zeros(8000 * 200), 8000)
    blocks = wav.read_wav_blocks(spark, str(tmp_path), seconds=1.0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per = blocks.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in per) == 200 and len(per) == 4 and max(r["count"] for r in per) < 100


def test_headers():
    with pytest.raises(ValueError):
        wav.header(b"RIFF\0\0\0\0WAVEdata\4\0\0\0", 100)
    with pytest.raises(ValueError):
        wav.header(b"RIFF\0\0\0\0WAVE", 12)
    out = wav.encode(np.zeros(10), 8000)
    assert wav.header(out, len(out)) == (8000, 2, 1, 44, 20)
    assert wav.header(out, 50) == (8000, 2, 1, 44, 6)  # cut off
