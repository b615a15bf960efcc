"""Joins that survive hot keys, on intermediate tables in shared storage (``noria.storage``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noria.storage import new_path, shared_folder, stored

__all__ = ["clean_input", "new_path", "only_ids", "shared_folder", "stored", "with_group_values", "without_ids"]

#: Most keys that count as hot: at most TOTAL / THRESHOLD keys can hold THRESHOLD rows or more.
HOT_KEYS = 1_000
#: Keys with fewer rows than this are never hot.
HOT_ROWS = 1_000
#: Most ids of eight bytes that are broadcast; with more, the join shuffles instead.
BROADCAST_IDS = 1_000_000


def with_group_values(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per key in ``groups``, safe for hot keys.

    ``size`` is the column of ``groups`` with the number of rows of the key, ``total`` the number of
    all rows. Keys above ``max(HOT_ROWS, total / HOT_KEYS)`` rows number at most HOT_KEYS by
    counting, so their groups are broadcast; each other key has so few rows that a shuffle spreads
    them evenly. Both inputs are read twice and should be stored tables. Rows with a null key go.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    cold = groups.where(F.col(size) <= limit)
    cold_rows = rows.join(F.broadcast(groups.where(F.col(size) > limit).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold_rows.join(cold, key))


def only_ids(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose ``key`` is in ``ids`` (distinct, one column).

    Up to BROADCAST_IDS ids are broadcast, so that the rows are filtered where they are read; with
    more of them both sides are shuffled by the key.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), key, "left_semi")


def without_ids(rows: DataFrame, verdicts: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` without the ids whose ``kept`` is false in every verdict; all columns stay.

    Rows with a null id stay. The ids to drop are broadcast up to BROADCAST_IDS, else shuffled.
    """
    drop = stored(verdicts.groupBy(F.col(key).alias("_id")).agg(F.max("kept").alias("kept")).where("NOT kept AND _id IS NOT NULL").select("_id"), "dropped")
    few = drop.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    drop = F.broadcast(drop) if few else drop.hint("merge")
    return rows.join(drop, rows[key] == drop["_id"], "left_anti")


def clean_input(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns of the caller can't clash with ours."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])
