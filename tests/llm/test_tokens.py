"""Cross-tokenizer alignment, forced-boundary BPE and fill-in-the-middle against the libraries and plain loops."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from noria.llm import cross_tokens, fill_middle, forced_bpe, queries  # noqa: E402
from noria.llm.encoding import joined  # noqa: E402
from noria.llm.fragments import letters_to_bytes  # noqa: E402
from test_llm import BYTE_BPE, CLASHING, PIECES, corpus, prose  # noqa: E402

ODD = [
    None, "", " ", "a", "  two  spaces ", "\ttab\nline\r\n\r\nend\n", "it's we'll 'tis x'", "!'s ?'re '' 'S", "日本語 テスト 中文", "naïve café ß Ÿ", "é combining",
    "emoji 👩‍👩‍👧 😀😀", "a b   c　d  e\u0085f", "x▁y", "<|endoftext|> inside <|endoftext|>", "<s> </s> <unk> <0x41>", "a\x00b \x01", "100,000.5 3.14 ١٢٣",
    "  \U0010fffd  \U0001f600", "a \r b  \r\n c\x1c d\x0b", "word " * 300, "=" * 500, "Ġ Ċ ▁▁", "<P>", "a<S>b", "x<M>", "<p> < P > <<P", "P><", "S", "<PX> <SM>", "Ab1Cd é É",
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    own = corpus()
    rows = [*own, *own[:4], *((500 + k, t) for k, t in enumerate(ODD)), (None, "no id here"), (None, None)]
    rows += [(600 + k, "".join(rng.choice(("a", "B", "<", "P", "S", "M", ">", " ", "é", "字", "'", "\n", "1")) for _ in range(rng.randrange(60)))) for k in range(150)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    to = tmp_path_factory.mktemp("tokens")
    clash = {c: F.lit(c) for c in CLASHING + ("block", "a", "b", "docs", "pairs", "n", "form", "ids", "restored", "_p")}
    spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash).repartition(4).write.parquet(str(to / "documents.parquet"))
    return str(to)


def run(spark, name, folder, *columns):
    return sorted((tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, folder).collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# alignment


def plain_alignment(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, by loops over all pairs of near tokens."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(BYTE_BPE), SentencePieceProcessor(model_file=PIECES)
    one.encode_special_tokens = True
    alphabet = letters_to_bytes()
    spelled = {i: bytes(alphabet[c] for c in t) for t, i in one.get_vocab().items() if i != 50256}

    def piece(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()

    found, counts = [], {}
    for t in texts:
        whole = (" " + (t or "")).encode()
        a = [(i, spelled[i]) for i in one.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = [(i, piece(i)) for i in two.encode(t)] if t else []
        if not t or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            found.append(None)
            continue
        at = [[], []]
        for side, tokens in enumerate((a, b)):
            place = 0
            for i, x in tokens:
                at[side].append((place, place + len(x), i))
                place += len(x)
        ends = {e for _, e, _ in at[0]} & {e for _, e, _ in at[1]}
        groups = []
        for side in (0, 1):
            own = [[]]
            for s, e, i in at[side]:
                own[-1].append(str(i))
                if e in ends:
                    own.append([])
            groups.append([",".join(x) for x in own[:-1]])
        links, j = [], 0
        for s, e, i in at[0]:
            while at[1][j][1] <= s:
                j += 1
            k = j
            while k < len(at[1]) and at[1][k][0] < e:
                links.append((i, at[1][k][2]))
                k += 1
        for p in set(links):
            counts[p] = counts.get(p, 0) + 1
        found.append((len(a), len(b), len(ends), links, ";".join(f"{x}|{y}" for x, y in zip(*groups, strict=True))))
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(n, top.get(a, 0))
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(counts[p] == top[p[0]] for p in f[3]), sum(counts[p] for p in f[3]), sha(f[4])) for f in found]


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_op11(spark, rows, folder):
    want = plain_alignment([t for _, t in rows])
    assert run(spark, "op11_cross_tokenizer", folder, *COLUMNS) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=repr)
    assert sum(w[3] for w in want) > 10_000 and sum(w[0] == 0 for w in want) >= 5


@pytest.mark.parametrize("part, memo", [(1 << 7, 1 << 30), (1 << 20, 0)])
def test_small_parts_and_no_memo(rows, part, memo, monkeypatch):
    texts = [t for _, t in rows]
    want = cross_tokens._aligned(cross_tokens.Aligner(BYTE_BPE, PIECES), pa.array(texts, pa.string()), True)
    monkeypatch.setattr(cross_tokens, "PART_BYTES", part)
    monkeypatch.setattr(cross_tokens, "MEMO_BYTES", memo)
    aligner, got = cross_tokens.Aligner(BYTE_BPE, PIECES), []
    for t in texts:
        got += cross_tokens._aligned(aligner, pa.array([t], pa.string()), True)[0]
    assert got == want[0]
    assert (len(aligner.known) == 0) == (memo == 0)


def test_alignment_by_blocks(spark, rows, folder):
    docs = spark.read.parquet(folder + "/documents.parquet")
    some = cross_tokens.aligned_blocks(docs, BYTE_BPE, PIECES, with_groups=True)
    for r in some.collect():
        assert r["groups_sha256"] == (sha(r["groups"]) if r["groups"] else "")
        assert r["n_groups"] == (r["groups"].count(";") + 1 if r["groups"] else 0)
        assert sum(r["links"]) == r["n_links"]
    top = cross_tokens.pair_counts(some)
    assert top.groupBy("a").agg(F.max("best").alias("m")).where("m <> 1").count() == 0
    plan = top._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# forced boundaries


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_BPE)


@pytest.fixture(scope="module")
def forced():
    return forced_bpe.ForcedEncoder(BYTE_BPE)


def test_op12(spark, rows, folder, library):
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert run(spark, "op12_forced_bpe", folder, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_pairs_that_no_token_holds():
    never = forced_bpe.forced_pairs([b"ab", b"bca", b"z"])
    assert [bytes([i >> 8, i & 255]) for i in np.flatnonzero(~never)] == [b"ab", b"bc", b"ca"]


def test_cuts_are_forced(forced):
    text = "The cat's tail, it isn't 12km long — is it? \U0001f600x"
    data, offsets = joined(pa.array([text]))
    cuts = forced.cuts(data, offsets).tolist()
    assert cuts[0] == 0 and len(cuts) > 10
    for c in cuts[1:]:
        assert forced.never[int(data[c - 1]) * 256 + int(data[c])] and chr(data[c]) != "'" and chr(data[c - 1]) not in " '"


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" '\r\n\tsltrvemd!?<|>endoftx  　\u0085 é日\U0001f600\U0010fffd\x1c\x00"), st.characters(codec="utf-8")), max_size=40))
def test_forced_equals_library(forced, library, text):
    ids, _ = forced.encode(pa.array([text]))
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_decode_ids_of_any_kind(spark, library):
    rng = random.Random(1)
    lists = [[rng.randrange(50257) for _ in range(rng.randrange(40))] for _ in range(60)] + [[], None, [50256], [i for i in range(256)]]
    got = forced_bpe.decode(spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>"), BYTE_BPE).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {k: library.decode(x or [], skip_special_tokens=False) for k, x in enumerate(lists)}


# fill in the middle


def plain_fim(doc, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = sha(f"1:{'' if doc is None else doc}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, n, "plain", None, None, sha(text), sha(text)
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h4 % 100 < 20 else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc, n, "spm" if h4 % 100 < 20 else "psm", len(pre), len(mid), sha(out), sha(text)


def test_op13(spark, rows, folder):
    got = run(spark, "op13_fill_middle", folder, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    assert got == sorted((plain_fim(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ<PSM>é字😀 1"), max_size=30), max_size=8))
def test_automaton_by_loop(texts):
    auto = fill_middle.Automaton()
    data, _ = fill_middle._parted(pa.array(texts, pa.string()))
    state, want = 0, []
    for byte in data.tolist():
        want.append(int(auto.emit[state * 256 + byte]))
        state = int(auto.next[state * 256 + byte])
    was = fill_middle.LANES
    try:
        for fill_middle.LANES in (1, 3, 7, 2048):
            assert auto.scan(data).tolist() == want
    finally:
        fill_middle.LANES = was
    counted = lambda flag: sum(1 for w in want if w & flag)
    assert counted(fill_middle.CHARACTER) == sum(map(len, texts))
    assert counted(fill_middle.UNIT) == sum(len(re.findall(r"[A-Za-z]+|[^A-Za-z]", t)) for t in texts)
    assert counted(fill_middle.SENTINEL) == sum(len(re.findall("<[PSM]>", t)) for t in texts)


def test_places_over_counted_runs(monkeypatch):
    monkeypatch.setattr(fill_middle, "COUNTED", 5)
    flags = fill_middle.Automaton().scan(np.frombuffer(b"ab 12 cd  x" * 4, np.uint8))
    starts = np.flatnonzero(flags & fill_middle.UNIT)
    counts = fill_middle._counts(flags, fill_middle.UNIT)
    assert [fill_middle._place(flags, counts, k) for k in range(len(starts) + 1)] == [*starts.tolist(), len(flags)]


def test_other_sentinels(spark):
    marks = ("[[pre]]", "[[suf]]", "[[mid]]")
    rng = random.Random(2)
    texts = [(k, prose(rng, 30) + rng.choice(("", "[[", "[[pre", "pre]]", "[[mid]]"))) for k in range(80)]
    done = fill_middle.transform(spark.createDataFrame(texts, "doc_id long, text string"), seed=7, rate=100, spm=50, sentinels=marks)
    back = fill_middle.restore(done, marks).collect()
    assert {r["doc_id"]: r["restored"] for r in back} == dict(texts)
    assert {r["form"] for r in back} == {"plain", "psm", "spm"}
    with pytest.raises(ValueError):
        fill_middle.Automaton(("<P>", "<P>>"))
