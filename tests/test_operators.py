"""Operators against plain loops and hand-made inputs."""

import dataclasses
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from noria.functions import arabic as ar
from noria.functions import models
from noria.functions import vectors as ve
from noria.operators import alignment, cuts, manifest, metrics, ordering, samples, signal
from noria import storage
from noria.operators import latents, weights
from noria.operators import votes as vo
from noria.functions import resampling
from noria.sources import config, files, sinks, wav
from noria.streaming import incremental


def test_running_number(spark):
    rows = [(random.Random(i).randrange(40), i) for i in range(500)]
    got = ordering.running_number(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a", "b"], "n").collect()
    assert [r["n"] for r in sorted(got, key=lambda r: (r["a"], r["b"]))] == list(range(500))
    assert ordering.running_number(spark.createDataFrame([], "a int"), ["a"], "n").count() == 0


def test_running_number_of_many_partitions(spark):
    """Dense, in order and complete with a weight and a column that nothing uses, all columns written."""
    n = 1_000_000
    df = spark.range(0, n, 1, 8).select(F.xxhash64("id").alias("k"), "id", (F.col("id") % 5).alias("w"), F.repeat(F.lit("x"), 30).alias("unused"))
    for weight, name in ((None, "n"), (F.col("w"), "s")):
        out = storage.stored(ordering.running_number(df, ["k"], name, weight), "test-numbers")
        assert out.count() == n and out.columns == ["k", "id", "w", "unused", name]
        own = out.select("k", "w", name).toPandas().sort_values("k")
        want = np.arange(n) if weight is None else np.cumsum(own["w"].to_numpy()) - own["w"].to_numpy()
        assert (own[name].to_numpy() == want).all()
    batches = samples.buckets(df.select("id", F.col("w").alias("len"), "unused"), 8, 4, seed=7)
    assert batches.groupBy("pool").count().where("count <> 32").isEmpty()


def test_stored_tables_go(spark):
    storage.stored(spark.range(5), "test-clear")
    assert storage.clear(spark) >= 1 and storage.clear(spark) == 0


def test_signal_scans(spark):
    rng = random.Random(4)
    rows = [(k, i, float(rng.random() < 0.6)) for k in range(30) for i in range(rng.randrange(1, 25))]
    df = spark.createDataFrame(rows, "k int, i long, x double").withColumn("s", F.col("x") > 0)
    runs = {r["k"]: (r["start"], r["length"]) for r in signal.longest_run(df, ["k"], "s").collect()}
    edges = {r["k"]: (r["first_start"], r["last_end"]) for r in signal.speech_edges(df, "k", "s", 2, F.lit(6), F.lit(3)).collect()}
    for k in range(30):
        s = [x > 0 for kk, _, x in rows if kk == k]
        best, at = (0, 0), 0
        while at < len(s):
            n = 0
            while at + n < len(s) and s[at + n]:
                n += 1
            best = (at, n) if n > best[1] else best
            at += n + 1
        assert runs[k] == (best if best[1] else (0, 0))
        end = next((i for i in range(3, len(s)) if all(s[i : i + 2])), len(s))
        begin = next((i for i in range(min(6, len(s) - 1), 1, -1) if all(s[i - 2 : i])), 0)
        assert edges[k] == (begin, end)


def test_smooth3(spark):
    x = [1.0, 5.0, 2.0, 8.0]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "k int, i long, x double")
    assert [round(r["x"], 9) for r in signal.smooth3(df, "k").orderBy("i").collect()] == np.convolve(x, np.ones(3) / 3, "same").round(9).tolist()


def test_alignment(spark):
    rng = np.random.default_rng(1)
    for _ in range(20):
        e = np.log(rng.dirichlet(np.ones(5), 6))
        tokens = [2, 4, 1]
        score = spark.createDataFrame([(e.tolist(), tokens)], "e array<array<double>>, t array<int>").select(signal.viterbi(F.col("e"), F.col("t")).alias("s"), alignment.aligned(F.col("e"), F.col("t")).alias("p")).first() if _ == 0 else None
        best = max((sum(e[i, tokens[at.index(i)]] if i in at else e[i, 0] for i in range(6)), at) for at in ((a, b, c) for a in range(6) for b in range(a + 1, 6) for c in range(b + 1, 6)))
        path = alignment.best_path(e, np.array(tokens))
        assert [f for f, _ in path] == list(best[1])
        if score:
            assert abs(score["s"] - best[0]) < 1e-9 and [p["token"] for p in score["p"]] == list(best[1])
    assert alignment.best_path(np.zeros((2, 3)), np.array([1, 1, 1])) is None
    assert alignment.best_path(np.zeros((2, 3)), np.array([], int)) is None
    assert [f for f, _ in alignment.best_path(np.zeros((3, 3)), np.array([1]))] == [2]


def test_countdown(spark):
    df = spark.createDataFrame([([0.0, 2.0, 0.0, 0.0],), ([0.0, 0.0],), ([],)], "x array<double>")
    assert [r[0] for r in df.select(alignment.countdown(F.col("x"), 1.0, 2)).collect()] == [3, 2, 0]


def test_repeated_ids_on_the_right(spark):
    rows = spark.createDataFrame([("a", "old", 1), ("b", "old", 2), ("b", "older", 3)], "id string, text string, n int")
    texts = spark.createDataFrame([("a", "x", 1), ("a", "z", 3), ("a", "y", 2), ("c", "w", 1)], "id string, text string, seq int")
    got = sorted((r["id"], r["text"], r["n"]) for r in manifest.with_text(rows, texts, order="seq").collect())
    assert got == [("a", "z", 1), ("b", "old", 2), ("b", "older", 3)]
    in_order = manifest.with_text(rows, texts.coalesce(1)).where("id = 'a'").collect()
    assert [r["text"] for r in in_order] == ["y"]
    base = spark.createDataFrame([("k", 1.0), ("l", 2.0)], "key string, value double")
    other = spark.createDataFrame([("k", 5.0, 1), ("k", 4.0, 2)], "key string, value double, seq int")
    assert sorted(tuple(r) for r in weights.matched(base, other, ["key"], order="seq").collect()) == [("k", 4.0), ("l", 2.0)]
    raw = spark.createDataFrame([("a", "ابجد هوز حطي", 2.0, None, None, "train")], "id string, raw_text string, duration double, confidence double, promo boolean, split string")
    assert manifest.classify(raw, existing=spark.createDataFrame([("a",), ("a",)], "id string")).count() == 1


def test_trims_and_skips(spark):
    df = spark.createDataFrame([(n, c) for n in (1, 12, 14, 62) for c in (0.0, 0.5, 0.999)], "n int, c double")
    kept = {(r["n"], r["c"]): r["k"] for r in df.select("n", "c", latents.trimmed(F.col("n"), F.col("c"), 12.5).alias("k")).collect()}
    assert kept == {(n, c): max(n - int(c * 7), min(n, 12)) for n in (1, 12, 14, 62) for c in (0.0, 0.5, 0.999)} and kept[62, 0.999] == 56
    assert sorted(r["k"] for r in df.select(latents.trimmed(F.col("n"), F.col("c"), 12.5, 0.0).alias("k")).distinct().collect()) == [1, 12, 14, 62]
    w = df.select(latents.skip_weight(F.col("c"), 0.5, 0.75).alias("w")).distinct().collect()
    assert sorted(r["w"] for r in w) == [0.0, 0.5]
    loss = df.where("n = 1").select("c", latents.skipped_loss(F.lit(2.0), F.when(F.col("c") < 0.5, 8.0), F.col("c"), 0.5, 0.75).alias("l")).collect()
    assert {r["c"]: r["l"] for r in loss} == {0.0: 5.5, 0.5: 1.5, 0.999: 1.5}
    assert df.select(latents.skip_weight(F.col("c"), 0.5, 0.75, training=False)).distinct().collect()[0][0] == 0.25


def test_manifest_order(spark):
    rows = [("a", "ابجد هوز حطي", 2.0, None, None), ("b", "ابجد هوز حطي", 2.0, 0.1, True), ("c", "ابجد هوز حطي", 2.0, 0.1, False), ("d", "ابجد هوز حطي", 99.0, 1.0, False), ("e", "ابجد هوز حطي +", 2.0, 1.0, False), ("f", "ابجدهوز حطي", 2.0, 1.0, False), ("g", "ابجد هوز حطي", 19.0, 1.0, False), ("h", "ابجد هوز حطي", 1.5, 1.0, False), ("i", None, 2.0, 1.0, False), ("j", "ابجد هوز حطي", None, 1.0, False)]
    raw = spark.createDataFrame(rows, "id string, raw_text string, duration double, confidence double, promo boolean").withColumn("split", F.lit("train"))
    got = {r["id"]: r["reason"] for r in manifest.classify(raw, existing=spark.createDataFrame([("a",), ("g",)], "id string")).collect()}
    assert got["a"] is None and got["b"] == "promo" and got["c"] == "low_confidence" and got["d"] == "duration" and got["e"] == "unsupported_characters" and got["f"] == "too_few_words" and got["g"] == "implausible_rate" and got["h"] == "missing_audio" and got["j"] == "duration"
    assert manifest.stats(manifest.classify(raw)).first()["kept"] >= 2


def test_cuts_fall_back(spark):
    words = cuts.timed_words(spark.createDataFrame([("u", ["abcdefghijklmnopqrst"] * 6), ("v", ["ab", "cd"]), ("w", [""])], "id string, ws array<string>"))
    got = cuts.eligible_cuts(words, window=1.0).collect()
    assert [(r["id"], r["pos"]) for r in got] == [("u", 1)]
    assert cuts.eligible_cuts(words, window=0).where("id = 'u'").count() > 1


def test_buckets(spark):
    rows = spark.createDataFrame([(i, (i * 7919) % 31) for i in range(53)], "id int, len int")
    kept = samples.buckets(rows, 8, 2).groupBy("pool", "batch").count().collect()
    assert sum(r["count"] for r in kept) == 53
    shuffled = samples.buckets(rows, 8, 2, seed=1).groupBy("pool", "batch").count().collect()
    assert all(r["count"] == 8 for r in shuffled) and sum(r["count"] for r in shuffled) == 48


def test_subsample(spark):
    df = spark.createDataFrame([("مَدِينَةْ", "k")], "t string, k string")
    f = lambda p: df.select(samples.subsample_marks(F.col("t"), F.col("k"), p)).first()[0]
    assert f(1.0) == "مَدِينَةْ" and f(0.0) == "مدينة"


def test_rebuffer(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.3, 0.3, 0.1],), ([],)], "x array<double>")
    out = [r[0] for r in df.select(metrics.rebuffer(F.col("x"), 0.24, 0.5)).collect()]
    assert [round(v, 6) for v in out[0]] == [0.3, 0.6, 0.1] and out[1] == []


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, -4.0],)], "v array<double>")
    row = df.select(ve.peak_normalise(F.col("v")).alias("p"), ve.log_softmax(F.col("v")).alias("l"), ve.normalise(F.col("v")).alias("n"), ve.softplus(F.lit(-800.0)).alias("s")).first()
    assert row["p"] == [0.75, -1.0] and abs(sum(np.exp(row["l"])) - 1) < 1e-12 and row["s"] == 0.0
    assert np.allclose(row["n"], [0.7071067, -0.7071067])


def test_chunks_against_a_loop(spark):
    rng = random.Random(2)
    letters = lambda s: sum(c in "ابجد" for c in s)

    def merged(parts, most):
        out = []
        for p in parts:
            if out and letters(out[-1]) + letters(p) <= most:
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    def plain(text, most):
        pieces = []
        for sentence in filter(None, (s.strip() for s in text.replace(". ", ".\n").split("\n"))):
            if letters(sentence) <= most:
                pieces.append(sentence)
                continue
            for part in filter(None, (p.strip() for p in sentence.replace(", ", ",\n").split("\n"))):
                pieces += [part] if letters(part) <= most else merged(part.split(), most)
        return [c if c.endswith(".") else c.rstrip(",") + "." for c in merged(pieces, most)]

    texts = [" ".join("".join(rng.choice("ابجد") for _ in range(rng.randrange(1, 9))) + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", ar.sentence_chunks(F.col("t"), 20).alias("c"))
    for r in df.collect():
        assert r["c"] == plain(texts[r["i"]], 20), texts[r["i"]]


def test_files(spark, tmp_path):
    source = tmp_path / "a.jsonl"
    source.write_text('{"id": "1", "text": "س", "duration": 2}\n\n{"id": "2"}\n', encoding="utf-8")
    df = files.read_jsonl(spark, str(source), "id string, text string, duration double")
    assert sorted(r["id"] for r in files.iter_jsonl(spark, str(source), "id string")) == ["1", "2"]
    assert files.write_rows(df, str(tmp_path / "out")) == 2
    assert files.read_jsonl(spark, str(tmp_path / "out"), "id string, text string").where("text = 'س'").count() == 1
    assert files.write_once(df, str(tmp_path / "once")) and not files.write_once(df, str(tmp_path / "once"))
    (tmp_path / "doc.json").write_text(json.dumps({"a": [1, 2]}, indent=1))
    assert files.read_json(spark, str(tmp_path / "doc.json")).first()["a"] == [1, 2]
    (tmp_path / "log.txt").write_text("\n".join(map(str, range(100))))
    assert files.tail(spark, str(tmp_path / "log.txt"), 3) == ["97", "98", "99"]
    for n in (1, 20, 3):
        (tmp_path / f"step_{n:03}.pt").write_text("x")
    assert files.newest(spark, str(tmp_path), "step_*.pt").endswith("step_020.pt")
    assert files.newest(spark, str(tmp_path), "none*.pt") is None
    for folder in ("train", "dev"):
        (tmp_path / "a" / folder).mkdir(parents=True)
        (tmp_path / "a" / folder / f"{folder} 1.wav").write_text("x")
    (tmp_path / "a" / "train" / "2.wav").write_text("x")
    refs = spark.createDataFrame([("train/2.wav",), ("./train/2.wav",), ("dev/2.wav",), ("2.wav",), ("dev/dev 1.wav",), ("train/dev 1.wav",), (None,)], "audio_path string")
    there = files.with_existing(refs, files.listing(spark, str(tmp_path / "a"), "*.wav"))
    assert sorted(r["audio_path"] for r in there.collect()) == ["./train/2.wav", "dev/dev 1.wav", "train/2.wav"]
    log = tmp_path / "long.txt"
    log.write_bytes(b"first\n" + b"x" * 300_000 + b"\nb\xffd\r\nlast")
    assert files.tail(spark, str(log), 2) == ["b\ufffdd", "last"] and len(files.tail(spark, str(log), 9)) == 3 and files.tail(spark, str(log), 0) == []
    assert files.Layout("/d").work("manifest", "dev") == "/d/work/manifest/split=valid"


def test_wav(spark, tmp_path):
    tone = (0.5 * np.sin(np.arange(8000) * 2 * np.pi * 200 / 8000)).astype(np.float32)
    (tmp_path / "tone.wav").write_bytes(wav.encode(tone, 8000))
    (tmp_path / "bad.wav").write_bytes(b"RIFFnothing")
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in wav.read_wav(spark, str(tmp_path), 16000).collect()}
    assert rows["bad.wav"]["error"] and rows["bad.wav"]["samples"] is None
    got = np.array(rows["tone.wav"]["samples"])
    want = 0.5 * np.sin(np.arange(16000) * 2 * np.pi * 200 / 16000)
    assert len(got) == 16000 and np.abs(got - want)[100:-100].max() < 0.01
    assert resampling.resample(tone, 8000, 8000) is tone


def test_models(spark):
    upper = models.model_column(lambda: lambda texts: [None if t is None else t.upper() for t in texts])
    df = models.by_length(spark.createDataFrame([("a",), (None,), ("bcd",)], "t string"), F.length("t"), 2)
    assert {r[0] for r in df.select(upper(F.col("t"))).collect()} == {"A", None, "BCD"}
    size = models.model_column(lambda: lambda texts: [[float(len(t or ""))] for t in texts], ArrayType(DoubleType()))
    assert spark.createDataFrame([("ab",)], "t string").select(size(F.col("t"))).first()[0] == [2.0]


def test_streaming_manifest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = {"id": "1", "text": "ابجد هوز حطي", "duration": 2.0, "split": "train"}
    (tmp_path / "in/a.json").write_text(json.dumps(line, ensure_ascii=False) + "\n" + json.dumps(line | {"id": "2", "promo": True}, ensure_ascii=False))
    for n, extra in ((1, None), (2, {"id": "3"})):
        if extra:
            (tmp_path / "in/b.json").write_text(json.dumps(line | extra, ensure_ascii=False))
        incremental.manifest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out/kept")).count() == n


@pytest.mark.parametrize("cosine", [True, False])
def test_learning_rates(spark, cosine):
    rows = metrics.learning_rates(spark, 100, 1.0, 10, 0.1, cosine).orderBy("step").collect()
    assert rows[0]["lr"] == 0.1 and rows[9]["lr"] == 1.0 and (rows[99]["lr"] < 0.2) == cosine


@dataclasses.dataclass
class Inner:
    steps: int = 1
    rates: tuple = ()


@dataclasses.dataclass
class Outer:
    name: str = ""
    lr: float = 0.0
    inner: Inner = dataclasses.field(default_factory=Inner)
    free: dict = dataclasses.field(default_factory=dict)


def test_config(spark, tmp_path):
    got = config.coerced(Outer, {"name": "${A}/x", "lr": "1e-3", "inner": {"steps": "5", "rates": [1, 2]}, "free": {"any": {"k": 1}}}, {"A": "here"})
    assert got == Outer("here/x", 0.001, Inner(5, (1, 2)), {"any": {"k": 1}})
    assert config.coerced(Outer, {"lr": 1, "inner": {}}) == Outer(lr=1.0) and isinstance(config.coerced(Outer, {"lr": 1}).lr, float)
    assert config.coerced(Outer, None) == Outer()
    assert config.schema(Outer) == {"name": str, "lr": float, "inner": Inner, "free": dict, "inner.steps": int, "inner.rates": tuple}
    with pytest.raises(ValueError, match="unknown key inner.stps"):
        config.coerced(Outer, {"inner": {"stps": 1}})
    with pytest.raises(ValueError):
        config.coerced(Outer, {"lr": "fast"})
    assert config.nested(config.settings({"a": {"b": {}, "c": {"d": [1]}}, "e": None})) == {"a": {"b": {}, "c": {"d": [1]}}, "e": None}
    assert config.overridden({"a": {"b": 1, "c": 2}}, {"a": {"d": 3}}) == {"a": {"d": 3}}
    with pytest.raises(ValueError, match="unknown key"):
        config.coerced(Outer, {"nme": 1})
    with pytest.raises(ValueError, match="unresolved"):
        config.expand_variables("${NO_SUCH_NAME_HERE}", {})
    base = {"model": {"layers": 6}, "x": 1}
    assert config.overridden(base, {"model.layers": 24})["model"]["layers"] == 24 and base["model"]["layers"] == 6
    for path in ("model.width", "mode.layers", "x.y"):
        with pytest.raises(KeyError):
            config.overridden(base, {path: 1})
    for value in ({}, base):  # the second takes the place of the first
        sinks.write_json(spark, str(tmp_path / "c.json"), value)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["c.json"]
    assert config.load(spark, str(tmp_path / "c.json")) == base
    with pytest.raises(Exception, match="unresolved"):
        spark.range(1).select(config.variables_expanded(F.lit("${A}${B}"), {"A": "1"})).collect()


def test_sinks(spark, tmp_path):
    assert sinks.write_tokenizer(spark, str(tmp_path / "t.json")) == sinks.read_tokenizer(spark, str(tmp_path / "t.json")).count() == 53
    rows = spark.createDataFrame([("r", "a", 1, 1.0), ("r", "a", 2, float("nan")), ("r", "a", 3, None), ("r", "a", 4, float("inf"))], "run string, tag string, step int, value double")
    for _ in range(2):
        sinks.append_metrics(rows, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    tone = [0.5, -0.5, 0.25]
    assert sinks.write_wav(spark.createDataFrame([("a", 8000, tone), ("b", 8000, tone)], "name string, rate int, samples array<double>"), str(tmp_path / "w")) == 2
    assert wav.read_wav(spark, str(tmp_path / "w")).where("rate = 8000 AND size(samples) = 3").count() == 2
    info = sinks.export(spark, str(tmp_path / "e"), {"a": spark.range(3)}, {"version": 1})
    assert info["tables"]["a"]["rows"] == 3 and config.load(spark, str(tmp_path / "e" / "info.json")) == info
    sinks.make_folders(spark, str(tmp_path / "d" / "e"))
    assert sinks.data_root(spark, str(tmp_path / "no"), str(tmp_path / "d")) == str(tmp_path / "d")
    with pytest.raises(FileNotFoundError):
        sinks.data_root(spark, str(tmp_path / "no"))
    made = sinks.Registry()
    made.register("double", by=2)(lambda x, by: x * by)
    assert made.make("double", x=4) == 8
    with pytest.raises(KeyError):
        made.make("none")
    done = set()
    steps = [("a", lambda: "a" in done, lambda: done.add("a")), ("b", lambda: "b" in done, lambda: done.add("b"))]
    assert sinks.run_steps(steps) == ["a", "b"] and sinks.run_steps(steps) == []


def test_errors_stop_queries(spark):
    with pytest.raises(Exception, match="check failed: rows"):
        weights.checked(spark.range(1).select(F.lit(0).alias("n")), rows=F.col("n") > 0).collect()
    with pytest.raises(Exception, match="no audio"):
        cuts.first_audio(spark.createDataFrame([(1, 0)], "id long, offset long"), spark.createDataFrame([(2, "x")], "id long, audio string")).collect()
    with pytest.raises(Exception, match="nothing to say"):
        spark.range(1).select(manifest.required(F.lit(""))).collect()


def test_latents_edges(spark):
    row = spark.range(1).select(
        latents.stitch_window(F.array(F.lit(1.0), F.lit(2.0)), F.lit(1), 3).alias("w"),
        latents.trimmed(F.lit(5), F.lit(0.999), 12.5).alias("t"),
        latents.frame_count(F.lit(0), 12.5, 24, F.lit(9)).alias("f"),
        latents.assembled(F.array(F.lit(1.0)), F.lit(None).cast("array<double>"), F.array(F.lit(2.0))).alias("a"),
    ).first()
    assert row["w"] == [2.0, 0.0, 0.0] and row["t"] == 5 and row["f"] == 1
    assert row["a"]["sequence"] == [1.0, 2.0] and row["a"]["offsets"] == [0, 1, 1]


def test_tally_counts_repeats(spark):
    pairs = spark.createDataFrame([("قصه قصه", "قصَه قصُه"), ("قصه", "قصَه"), ("قصه بيت", "قصَه")], "text string, diac string")
    got = [r.asDict() for r in vo.tally(pairs).collect()]
    assert got == [{"word": "قصه", "votes_ta": 2, "votes_ha": 1, "abstain": 0}]


def test_stop_on_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "stop").write_text("")
    stream = spark.readStream.schema("a int").json(str(tmp_path / "in"))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
    assert incremental.stop_on_file(query, str(tmp_path / "stop"), 0.1) and not query.isActive


def test_checkpoints_and_model_config(spark, tmp_path):
    for step in (10, 9):
        weights.save_step(spark.range(step), str(tmp_path / "c"), step)
    assert weights.load_step(spark, str(tmp_path / "c")).count() == 10 and weights.load_step(spark, str(tmp_path / "c"), 9).count() == 9
    base = {"model": {"vocab_size": 1, "weights": "/data/m/w.bin"}}
    assert config.model_config(base, 53, "/data/m", paths=["model.weights"]) == {"model": {"vocab_size": 53, "weights": "w.bin"}}


def test_generator_starts_each_chunk_from_the_voice(spark):
    def load():
        def speak(state, text):
            for i, _ in enumerate(text):
                yield [float(state["n"]), float(i)]

        return (lambda voice: {"n": len(voice)}), speak

    rows = spark.createDataFrame([(1, "aa", ["xy", "z"]), (2, "b", None), (3, "b", ["w"])], "id long, voice string, chunks array<string>")
    got = sorted((r["id"], r["chunk"], r["part"], r["samples"]) for r in models.generated(rows, "id", "voice", "chunks", load).collect())
    assert got == [(1, 0, 0, [2.0, 0.0]), (1, 0, 1, [2.0, 1.0]), (1, 1, 0, [2.0, 0.0]), (3, 0, 0, [1.0, 0.0])]
    assert models.by_name("math:sqrt")(4) == 2
    with pytest.raises(LookupError):
        models.by_name("no_such_package:f")


def test_retention_and_sanity(spark):
    files_ = spark.createDataFrame([("r", k, n) for k, most in (("checkpoint", 5), ("optimizer", 3), ("log", 4)) for n in range(most)], "run string, kind string, n int")
    kept = weights.retained(files_, ["run"], "kind", [F.desc("n")], {"checkpoint": 3, "optimizer": 1}).collect()
    assert sorted((r["kind"], r["n"]) for r in kept) == [("checkpoint", 2), ("checkpoint", 3), ("checkpoint", 4), ("log", 0), ("log", 1), ("log", 2), ("log", 3), ("optimizer", 2)]
    same = (F.lit("a"), F.lit("a"), F.lit(5), F.lit(5))
    table = lambda *v: spark.createDataFrame([(list(v),)], "v array<double>")
    assert tuple(weights.sanity(table(1.0, -3.0), "v", *same).first()) == (2, 3.0)
    for bad, tests, what in ((table(1.0, float("nan")), same, "finite"), (table(float("-inf"), 1.0), same, "finite"), (table(0.0, 0.0), same, "some_not_zero"), (table(1.0), (F.lit("a"), F.lit("b"), F.lit(5), F.lit(5)), "same_digest"), (table(1.0), (F.lit("a"), F.lit("a"), F.lit(5), F.lit(4)), "same_window")):
        with pytest.raises(Exception, match=what):
            weights.sanity(bad, "v", *tests).collect()
    batches = spark.createDataFrame([(b,) for b in (0, 0, 1, 2, 2)], "b int")
    assert weights.first_batches(batches, "b", 2).count() == 3 and weights.first_batches(batches, "b", 0).count() == 5


def test_schedules(spark):
    df = spark.range(0, 40)
    due = [r["id"] for r in df.where(metrics.due(F.col("id"), 10)).collect()]
    assert sorted(due) == [0, 10, 20, 30]
    verbose = [r["id"] for r in df.where(metrics.due(F.col("id"), 10, F.lit(5), 3)).collect()]
    assert sorted(verbose) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 20, 30]
    rows = spark.createDataFrame([(1.0,), (4.0,), (5.0,), (4.95,)], "x double")
    assert tuple(metrics.sample_statistics(rows, "x").first()) == (pytest.approx(14.95 / 4), 0.5)
