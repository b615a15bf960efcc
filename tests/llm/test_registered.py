"""Every registered query, as registered, over a small folder of odd tables against brute force.

The documents hold nulls, empty and long texts, ties, repeated rows and columns named like the operators' own.
"""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from noria.llm import html_text, pieces, queries, url_filters  # noqa: E402
from test_llm import BYTE_BPE, CLASHING, LOWER, PIECES, WORD_BPE, components, corpus, crc, encoded, plain_verdicts, removed, words  # noqa: E402

PAGES = [
    (1, "https://A.Example.com/en/7x?q", "<article><h1>T</h1><p>Some words of it stand here.</p></article><footer>No</footer>"),
    (2, "https://a.example.com/en/1", None),
    (3, None, ""),
    (4, "no scheme", "<p>Words without a container, but enough of them to count as text.</p>"),
    (5, "http://x.net/de/1", "plain text only, which is one block without any markup at all."),
    (5, "http://x.net/de/1", "plain text only, which is one block without any markup at all."),
    (None, "http://example.net/de/8/9", "<p>" + "long " * 50_000 + "end.</p>"),
    (6, "http://free-casino-bets.org/es/1", "<nav><a>Home</a></nav>"),
    (7, "http://org.example/es/", "<div>" * 300),
    (8, "http://" + "a" * 30_000 + ".com/en/", "<p>x</p>"),
]


@pytest.fixture(scope="module")
def rows():
    own = corpus()
    return [*own, *own[:6], (900, "word " * 30_000 + "end"), (901, "'s don't  a\t\n"), (902, "<|endoftext|> x ▁ y")]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    to = tmp_path_factory.mktemp("odd")
    clash = {c: F.lit(c) for c in CLASHING + ("text_sha256", "ids", "part", "seq", "task", "number", "edit", "factors")}
    spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash).repartition(5).write.parquet(str(to / "documents.parquet"))
    spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("host", "path", "rule", "by_rule", "text", "n_chars")}).repartition(3).write.parquet(str(to / "pages.parquet"))
    return str(to)


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    to = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(to / "documents.parquet"))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(to / "pages.parquet"))
    return str(to)


def run(spark, name, folder, *columns):
    return sorted((tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, folder).collect()), key=repr)


def ordered(found):
    return sorted(found, key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, bare, name):
    assert queries.QUERIES[name](spark, bare).count() == 0


def test_op1(spark, rows, folder):
    want = plain_verdicts(rows)
    assert run(spark, "op1_quality_rules", folder, "doc_id", "kept") == ordered((i, want[i]) for i, _ in rows)


def test_op2(spark, rows, folder):
    body = lambda t: (t or "").translate(LOWER)
    last, size = {}, {}
    for i, t in rows:
        last[body(t)], size[body(t)] = max(i, last.get(body(t), -1)), size.get(body(t), 0) + 1
    want = ordered((i, last[body(t)], size[body(t)], i == last[body(t)], hashlib.sha256(body(t).encode()).hexdigest()) for i, t in rows)
    assert run(spark, "op2_exact_dedup", folder, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_op3(spark, folder):
    want = ordered((i, u, t := html_text.main_text(h), len(t)) for i, u, h in PAGES)
    got = run(spark, "op3_html_extraction", folder, "page_id", "url", "text", "n_chars")
    assert got == want
    by_id = {r[0]: r[2] for r in got}
    assert by_id[1] == "T\n\nSome words of it stand here." and by_id[2] == by_id[3] == by_id[6] == by_id[7] == "" and len(by_id[None]) == 250_004


def test_op4(spark, rows, folder):
    want = removed(list(dict(rows).items()))
    assert run(spark, "op4_substring_dedup", folder, "doc_id", "n_words", "n_removed", "kept_sha256") == ordered((i, want[i][0], want[i][1], hashlib.sha256(want[i][2].encode()).hexdigest()) for i, _ in rows)


def test_op5(spark, rows, folder):
    ids, at, want = encoded(rows, WORD_BPE, 2), 0, []
    for i, _ in sorted(rows, key=lambda r: r[0]):
        want.append((i, at, len(ids[i]), crc(ids[i])))
        at += len(ids[i])
    assert run(spark, "op5_token_ids", folder, "doc_id", "start", "n_tokens", "ids_crc32") == ordered(want)


def test_op6(spark, rows, folder):
    model = pieces.Pieces.from_file(PIECES)
    want = []
    for i, t in rows:
        ids = model.encode(t)
        assert model.decode(ids) == (t or "")
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True))
    assert run(spark, "op6_sentencepiece", folder, "doc_id", "n_pieces", "ids_crc32", "exact") == ordered(want)


def test_op7(spark, rows, folder):
    want = components(list(dict(rows).items()), 3, 85)
    assert run(spark, "op7_near_dedup", folder, "doc_id", "n_shingles", "component_id", "kept") == ordered((i, *want[i]) for i, _ in rows)


def plain_urls(spark):
    """page_id, host, path, rule and verdict by loops; the model's n-gram hashes are Spark's."""
    intercept, weights = url_filters.train(spark)
    out = []
    for i, url, _ in PAGES:
        at = (url or "").find("://")
        rest = url[at + 3 :] if at >= 0 else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fits = [(len(r), v, r) for v, r in queries.URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        grams = [(mark, text[k : k + n]) for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in url_filters.SIZES for k in range(len(text) - n + 1)]
        out.append([i, host, path, max(fits)[2] if fits else None, max(fits)[1] if fits else None, grams])
    known = sorted({g for r in out for g in r[5]})
    hashed = spark.createDataFrame(known, "mark string, gram string").select("mark", "gram", F.pmod(F.xxhash64("mark", "gram"), F.lit(url_filters.BUCKETS)).alias("b")).collect()
    bucket = {(r["mark"], r["gram"]): r["b"] for r in hashed}
    for r in out:
        grams = r.pop()
        z = intercept + sum(weights[bucket[g]] for g in grams) / max(1, len(grams))
        r[4] = r[4] or ("allow" if 1 / (1 + math.exp(-z)) >= 0.5 else "block")
    return ordered(map(tuple, out))


def test_op8(spark, folder):
    got = run(spark, "op8_url_filters", folder, "page_id", "host", "path", "rule", "verdict")
    assert got == plain_urls(spark)
    by_id = {r[0]: r[3:] for r in got}
    assert by_id[1] == ("example.com/en/7", "allow") and by_id[2] == ("com/en/", "block") and by_id[None] == ("example.net/de/8", "block") and by_id[5] == ("net/de/", "allow")


def test_op8_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x")], "page_id long, url string")
    for rules in ((("block", "a.com/x"), ("allow", "a.com/x")), (("allow", "a.com/x"), ("block", "a.com/x"))):
        assert [r["verdict"] for r in url_filters.filter_urls(df, rules, (0.0, [0.0] * url_filters.BUCKETS)).collect()] == [rules[0][0]] * 2


def test_op9(spark, rows, folder):
    ids, got, sequences = encoded(rows, BYTE_BPE, 0), {}, {}
    for r in queries.QUERIES["op9_best_fit_packing"](spark, folder).collect():
        got.setdefault((r["doc_id"], r["piece"]), []).append((r["start"], r["length"], r["ids_crc32"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    times = {}
    for i, _ in rows:
        times[i] = times.get(i, 0) + 1
    want = {}
    for i, n in times.items():
        size = len(ids[i])
        first = size if size <= 2048 else size % 2048
        starts = [0] + list(range(first or 2048, size, 2048)) if size > 2048 else [0]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], size])):
            want[i, k] = [(a, b - a, crc(ids[i][a:b]))] * n
    assert got == want
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= math.ceil(sum(len(ids[i]) for i, _ in rows) / 2048) * 1.03 + 1


def test_op10(spark, rows, folder):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BYTE_BPE)
    count = lambda t: len(plain.encode(t, add_special_tokens=False).ids)
    want = []
    for i, t in rows:
        t = t or ""
        m = len(t) // 2
        want.append((i, count(t), count(t[:m] + " edited words " + t[m + 5 :])))
    assert run(spark, "op10_token_counts", folder, "doc_id", "n_before", "n_tokens") == ordered(want)


def test_words_helper():
    assert words(" a\tb\x0bc  ") == ["a", "b", "c"]
