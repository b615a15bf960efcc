"""Layout of stores: plans without exchanges, and what a range read touches."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from noria.operators import store


def frames(spark, n=400, each=10):
    return spark.range(n * each).select((F.col("id") / each).cast("long").alias("utt_id"), (F.col("id") % each).cast("int").alias("frame"), F.array(F.col("id") * 1.0).alias("latent"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_without_exchange(spark, tmp_path):
    index = spark.range(400).select(F.col("id").alias("utt_id"), (F.col("id") % 12).alias("frames"))
    store.save_bucketed(index, str(tmp_path / "i"), "utt_id", [], 6)
    store.save_bucketed(frames(spark), str(tmp_path / "f"), "utt_id", ["frame"], 6)
    for side in ("i", "f"):
        assert len([p for p in (tmp_path / side).iterdir() if p.name.startswith("part-")]) == 6
    joined = store.frames_of(store.open_bucketed(spark, str(tmp_path / "i")), store.open_bucketed(spark, str(tmp_path / "f")))
    assert "Exchange" not in plan_of(joined) and "SortMergeJoin" in plan_of(joined)
    got = {}
    for r in joined.collect():
        assert r["latent"] == [r["utt_id"] * 10.0 + r["frame"]]
        got.setdefault(r["utt_id"], []).append(r["frame"])
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(min(k % 12, 10))) for k in range(400) if k % 12}
    plain = store.frames_of(index, frames(spark))
    assert "Exchange" in plan_of(plain) and plain.count() == joined.count()


def test_a_range_touches_its_row_groups_only(spark, tmp_path):
    path = str(tmp_path / "r")
    df = frames(spark, 20_000).withColumn("at", F.col("utt_id") * 10 + F.col("frame")).repartition(3)
    store.write_ranges(df, path, "at", row_group_bytes=1 << 17)
    groups = []
    for file in sorted((tmp_path / "r").glob("*.parquet")):
        meta = pq.ParquetFile(file).metadata
        column = [c for c in range(meta.num_columns) if meta.schema.column(c).path == "at"][0]
        groups += [meta.row_group(g).column(column).statistics for g in range(meta.num_row_groups)]
    assert len(groups) >= 8
    ranges = sorted((s.min, s.max) for s in groups)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))  # no two groups overlap
    first, stop = 120_005, 120_345
    assert sum(s.max >= first and s.min < stop for s in groups) <= 2
    found = store.read_range(spark, path, first, stop)
    assert "PushedFilters: [IsNotNull(at), GreaterThanOrEqual(at,120005), LessThan(at,120345)]" in found._jdf.queryExecution().toString()
    assert sorted(r["at"] for r in found.select("at").collect()) == list(range(first, stop))
    scan = found.select("at")
    scan.collect()
    read = []

    def walk(node):
        if "Scan" in node.nodeName():
            read.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    executed = scan._jdf.queryExecution().executedPlan()
    walk(executed.finalPhysicalPlan() if "Adaptive" in executed.nodeName() else executed)
    assert read and sum(read) < 20_000  # of 200,000 rows


def test_many_ranges(spark, tmp_path):
    path = str(tmp_path / "r")
    store.write_ranges(frames(spark, 50).withColumn("at", F.col("utt_id") * 10 + F.col("frame")), path, "at")
    wanted = [("a", 0, 3), ("b", 498, 9), ("c", 63, 2), ("d", 100, 0), ("e", 10, 300), ("e", 10, 300), ("f", 900, 5)]
    found = store.read_ranges(spark, path, spark.createDataFrame(wanted, "who string, first long, frames long"), 64)
    got = {}
    for r in found.collect():
        got.setdefault(r["who"], []).append(r["at"])
    assert {k: sorted(v) for k, v in got.items()} == {"a": [0, 1, 2], "b": [498, 499], "c": [63, 64], "e": sorted([*range(10, 310)] * 2)}
