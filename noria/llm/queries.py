"""The queries of this subpackage: name -> function of (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cross_tokens, exact_dedup, fill_middle, forced_bpe, html_text, near_dedup, packing, pieces, quality_rules, substring_dedup, tables, token_counts, url_filters, wavelet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good", "pattern")


@_query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(_table(spark, sf_dir, "documents"))


ORACLE_SQL["op2_exact_dedup"] = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, sha256(body) AS text_sha256 FROM t)
SELECT doc_id, keep_id, group_size, text_sha256, doc_id IS NOT DISTINCT FROM keep_id AS kept FROM g
"""


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = tables.new_path(spark, "shards")
    wavelet.write_shards(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), to)
    return wavelet.documents(wavelet.read_shards(spark, to))


@_query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_up = packing.pieces(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return packing.pack(cut_up)


@_query
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"), k=3, percent=85)


@_query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed_words(_table(spark, sf_dir, "documents"))


@_query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


@_query
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


@_query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@_query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after an edit: five characters in the middle give way to two words."""
    docs = _table(spark, sf_dir, "documents")
    middle = F.floor(F.length(F.coalesce("text", F.lit(""))) / 2)
    return token_counts.count_edited(docs, tokenizer_path("byte_bpe_50k.json"), middle, middle + 5, F.lit(" edited words "))


@_query
def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokens.align(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@_query
def op12_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    done = forced_bpe.decode(forced_bpe.encode(_table(spark, sf_dir, "documents"), path), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@_query
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle.restore(fill_middle.transform(_table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("text", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE_SQL["op13_fill_middle"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT doc_id, text, units, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, array_to_string(units[:x], '') AS pre, array_to_string(units[x + 1:y], '') AS mid, array_to_string(units[y + 1:], '') AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN len(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM c
"""
