"""From raw documents to packed training sequences: five stages, each one operator of ``noria.llm``.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame, written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents, extra ones included, whatever
their names. A stage that an empty table reaches gives an empty table.

A null text is empty: the quality rules reject it, as they do texts of under 20 words. Verdicts are by doc_id: repeated
rows of a document stay or go together, rows without doc_id pass the first three stages and are packed. Of equal texts the
largest doc_id stays, of near copies the smallest, so ties don't occur. Very long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noria.llm import exact_dedup, near_dedup, packing, quality_rules, substring_dedup
from noria.llm.queries import tokenizer_path
from noria.llm.tables import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return near_dedup.drop_near_copies(docs, k=5, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a smaller doc_id has, too, are cut out."""
    return substring_dedup.drop_spans(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048."""
    return packing.pack(packing.pieces(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("substring dedup", substrings), ("packing", pack)]

#: SQL has neither the fitted rules nor the tokenizer; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
