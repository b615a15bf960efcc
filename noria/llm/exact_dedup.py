"""Exact dedup by 128-bit content hash, in built-in functions only.

Rows are grouped by the MD5 of the normalised text together with the text itself: partial
aggregation meets copies inside each task first, comparing bytes, so a group of copies of any size
reaches the shuffle as one row per task and two texts that collide in the hash stay apart. Then
each row looks its group up by hash alone; only hashes that hold several texts (none, but for a
collision) are looked up by the text's SHA-256 as well. The lookup treats hot hashes apart. Very long texts
are grouped whole.

Null text counts as empty. Rows that repeat a doc_id are the same document and share a verdict.
A null doc_id is smaller than any other and, alone in its group, stays. An empty table gives an
empty result; extra columns are kept by ``drop_copies`` and otherwise not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import clean_input, stored, with_group_values, without_ids


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null as empty. ASCII texts take the faster function."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def groups(docs: DataFrame) -> DataFrame:
    """One row per distinct normalised text: hash, keep_id, group_size, text_sha256, n_texts of its hash."""
    texts = clean_input(docs, "doc_id", "text").select("doc_id", normalised(F.col("text")).alias("body")).select("doc_id", F.unhex(F.md5("body")).alias("hash"), "body")
    found = texts.groupBy("hash", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return stored(found.select("hash", "keep_id", "group_size", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256")), "exact-groups")


def mark_copies(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    found = groups(docs)
    rows = stored(clean_input(docs, "doc_id", "text").select("doc_id", F.unhex(F.md5(normalised(F.col("text")))).alias("hash")), "exact-rows")
    total = rows.count()
    clashing = found.groupBy("hash").count().where("count > 1").select("hash")
    out = ["doc_id", "keep_id", "group_size", "text_sha256"]
    if clashing.isEmpty():
        marked = with_group_values(rows, found, "hash", "group_size", total).select(*out)
    else:
        marked = _by_text(docs, rows, found, stored(clashing, "exact-clashes"), total).select(*out)
    return marked.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def _by_text(docs: DataFrame, rows: DataFrame, found: DataFrame, clashing: DataFrame, total: int) -> DataFrame:
    """As in mark_copies, where some hashes hold several texts: those rows are told apart by SHA-256 and bytes."""
    plain = with_group_values(rows.join(clashing, "hash", "left_anti"), found.join(clashing, "hash", "left_anti"), "hash", "group_size", total)
    texts = clean_input(docs, "doc_id", "text").select("doc_id", normalised(F.col("text")).alias("body")).select("doc_id", F.unhex(F.md5("body")).alias("hash"), F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"))
    mixed = stored(texts.join(clashing, "hash", "left_semi").select("doc_id", F.concat_ws(":", F.hex("hash"), "text_sha256").alias("hash")), "exact-mixed")
    apart = found.join(clashing, "hash", "left_semi").withColumn("hash", F.concat_ws(":", F.hex("hash"), "text_sha256"))
    out = ["doc_id", "keep_id", "group_size", "text_sha256"]
    return plain.select(*out).unionByName(with_group_values(mixed, apart, "hash", "group_size", total).select(*out))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows without doc_id stay."""
    return without_ids(docs, mark_copies(docs).select("doc_id", "kept"))
