"""The pipeline against a plain version of its stages on a small corpus."""

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from test_llm import BYTE_BPE, CLASHING, LOWER, components, corpus, encoded, plain_verdicts, removed  # noqa: E402


def test_pipeline(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    keep = plain_verdicts(rows)
    rows = [(i, t) for i, t in rows if keep[i]]
    last = {}
    for i, t in rows:
        last[t.translate(LOWER)] = max(i, last.get(t.translate(LOWER), -1))
    rows = [(i, t) for i, t in rows if last[t.translate(LOWER)] == i]
    group = components(rows, 5, 80)
    rows = [(i, t) for i, t in rows if group[i][2]]
    cut = removed(rows)
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, str(tmp_path))
        assert state.columns == docs.columns, name
    texts = {r["doc_id"]: r["text"] for r in state.collect()}
    assert {i: " ".join(t.split()) for i, t in texts.items()} == {i: v[2] for i, v in cut.items()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = {}
    for r in out:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {i: len(x) for i, x in encoded(list(texts.items()), BYTE_BPE, 0).items()}


def test_pipeline_of_odd_tables(spark, tmp_path):
    """An empty table, and one with repeated rows, nulls, a row without id and columns named like the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() == 0
    text = " ".join(f"w{i} and so on it goes." for i in range(30))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, text + " x", "en", "s", 1), (4, text.upper(), "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit(c) for c in CLASHING})
    docs.write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "b")).collect()} == {None, 4}
