"""Losses, schedules and series over events and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from noria.functions import vectors as ve
from noria.operators import latents, metrics, weights

from .registry import query, table
from .sequence_queries import _E, _TRACK, track, vectors


@query(f"WITH {_E}, y AS (SELECT vec_id, unnest(v) AS x, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS dim FROM e) SELECT dim, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM y WHERE vec_id % 3 > 0 GROUP BY dim")
def q_masked_stats(spark, sf_dir):
    """The mask (two of three vectors are valid) is part of the statistic."""
    y = vectors(spark, sf_dir).where("vec_id % 3 > 0").select(F.posexplode("v").alias("dim", "x"))
    return y.groupBy("dim").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("std"))


_SHIFT = f"{_TRACK}, n AS (SELECT *, i < 20 AS m FROM tr), s AS (SELECT *, CAST(coalesce(lag(m) OVER (PARTITION BY user_id ORDER BY i), m) AS DOUBLE) AS w FROM n)"


@query(f"WITH {_SHIFT} SELECT user_id, round(sum(w * x * x) / greatest(1.0, sum(w)), 4) AS loss FROM s GROUP BY user_id")
def q_masked_mse(spark, sf_dir):
    t = track(spark, sf_dir).withColumn("m", F.col("i") < 20)
    return metrics.masked_mse(t, ["user_id"], "i", "x", "m").select("user_id", F.round("loss", 4).alias("loss"))


@query(f"WITH {_SHIFT}, l AS (SELECT *, (x - 200) / 100 AS z FROM s) SELECT user_id, round(sum(w * CASE WHEN m THEN ln(1 + exp(-abs(z))) + greatest(z, 0.0) ELSE ln(1 + exp(-abs(z))) + greatest(-z, 0.0) END) / greatest(1.0, sum(w)), 4) AS loss FROM l GROUP BY user_id")
def q_eos_loss(spark, sf_dir):
    t = track(spark, sf_dir).withColumn("m", F.col("i") < 20).withColumn("z", (F.col("x") - 200) / 100)
    return metrics.eos_loss(t, ["user_id"], "i", "z", "m").select("user_id", F.round("loss", 4).alias("loss"))


@query(f"WITH {_E} SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: pow(((1 - (1 - 1e-5) * t) * v[i] + t * v[i + 32]) - (v[i + 32] - (1 - 1e-5) * v[i]), 2))) / 32, 5) AS loss FROM (SELECT *, (vec_id % 10) / 10.0 AS t FROM e)")
def q_flow_loss(spark, sf_dir):
    """A point between noise and data at time t, held against the flow's target (the point itself as prediction)."""
    t, s = (F.col("vec_id") % 10) / 10.0, 1e-5
    x0, x1 = F.slice("v", 1, 32), F.slice("v", 33, 32)
    loss = latents.flow_loss(latents.flow_point(x0, x1, t, s), x0, x1, s)
    return vectors(spark, sf_dir).select("vec_id", F.round(loss, 5).alias("loss"))


@query("SELECT round(avg(m), 6) AS metric FROM (SELECT avg(m) AS m FROM (SELECT user_id % 4 AS r, user_id, avg(value) AS m FROM events GROUP BY ALL) GROUP BY r)")
def q_avg_of_avg(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("r", F.col("user_id") % 4)
    return metrics.mean_of_means(e, "r", "user_id", "value").select(F.round("metric", 6).alias("metric"))


@query(f"WITH {_E} SELECT round(sqrt(sum(s)), 5) AS norm, round(least(1.0, 1.0 / (sqrt(sum(s)) + 1e-6)), 5) AS clip, round(max(m), 5) AS max_abs FROM (SELECT list_sum(list_transform(v, lambda x: x * x)) AS s, list_max(list_transform(v, lambda x: abs(x))) AS m FROM e)")
def q_grad_norm(spark, sf_dir):
    v = F.col("v")
    s = vectors(spark, sf_dir).agg(F.sqrt(F.sum(ve.total(F.transform(v, lambda x: x * x)))).alias("norm"), F.max(F.array_max(F.transform(v, lambda x: F.abs(x)))).alias("m"))
    return s.select(F.round("norm", 5).alias("norm"), F.round(F.least(F.lit(1.0), 1.0 / (F.col("norm") + 1e-6)), 5).alias("clip"), F.round("m", 5).alias("max_abs"))


@query("SELECT n_regionkey, sha256(string_agg(n_name || ':' || n_nationkey, '' ORDER BY n_name || ':' || n_nationkey)) AS digest FROM nation GROUP BY n_regionkey")
def q_digest(spark, sf_dir):
    parts = F.collect_list(F.concat_ws(":", "n_name", F.col("n_nationkey").cast("string")))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(ve.digest(parts).alias("digest"))


@query(f"WITH {_TRACK}, f AS (SELECT i, max(x) AS rel FROM tr GROUP BY i), k AS (SELECT median(rel) AS floor FROM f) SELECT CAST(coalesce(max(i) FILTER (rel > greatest(1.5 * floor, 1e-3)), -1) + 1 + 4 AS BIGINT) AS margin FROM f, k")
def q_calibration(spark, sf_dir):
    """Frames until the largest deviation is at the noise floor, with a margin of four."""
    f = track(spark, sf_dir).groupBy("i").agg(F.max("x").alias("rel"))
    floor = f.agg(F.percentile("rel", F.lit(0.5)).alias("floor"))
    return f.join(F.broadcast(floor)).agg((F.coalesce(F.max(F.when(F.col("rel") > F.greatest(1.5 * F.col("floor"), F.lit(1e-3)), F.col("i"))), F.lit(-1)) + 5).cast("long").alias("margin"))


@query("SELECT event_id, round(CASE WHEN event_id < 500 THEN 2e-4 * (event_id + 1) / 500 ELSE 1e-5 + (2e-4 - 1e-5) * 0.5 * (1 + cos(least((event_id - 500) / 1500.0, 1.0) * 3.141592653589793)) END, 9) AS lr FROM events")
def q_lr_schedule(spark, sf_dir):
    """The rate at each event's number as a step."""
    return table(spark, sf_dir, "events").select("event_id", F.round(metrics.learning_rate(F.col("event_id"), 2000, 2e-4, 500, 1e-5, True), 9).alias("lr"))


@query("WITH l AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id) SELECT user_id, round(list_reduce(v, lambda s, x: 0.9 * s + 0.1 * x), 5) AS ema FROM l")
def q_ema(spark, sf_dir):
    steps = metrics.ema_steps(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "value", 0.9)
    return steps.groupBy("user_id").agg(F.round(F.max_by("ema", "i"), 5).alias("ema"))


@query(f"WITH {_TRACK} SELECT user_id, i, round(avg(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS smooth FROM tr QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i) >= 5")
def q_smooth(spark, sf_dir):
    return metrics.smoothed(track(spark, sf_dir), ["user_id"], "i", "x", 5).select("user_id", "i", F.round("smooth", 6).alias("smooth"))


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, CAST(ts AS DATE) AS day, max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS last_day FROM events) WHERE day = last_day")
def q_latest_step(spark, sf_dir):
    """All rows of the last day of each user."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).withColumn("last", F.max("day").over(Window.partitionBy("user_id")))
    return e.where("day = last").select("event_id", "user_id")


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def q_retention(spark, sf_dir):
    """The newest three of each customer stay."""
    return weights.newest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_orderkey", "o_custkey")


@query("SELECT event_type AS tag, count(*) AS n, md5(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS steps, round(arg_max(value, event_id), 6) AS last FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND abs(value) < 'inf'::DOUBLE GROUP BY event_type")
def q_scalars(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("tag"), F.col("event_id").alias("step"), "value")
    s = metrics.series(metrics.finite(e))
    return s.select("tag", F.size("step").cast("long").alias("n"), F.md5(F.array_join(F.col("step").cast("array<string>"), ",")).alias("steps"), F.round(F.element_at("value", -1), 6).alias("last"))


@query("SELECT p_partkey, CAST(unnest(list_concat(range(0, CAST(ceil(n / 2.0) AS BIGINT)), range(24 - n // 2, 24))) AS BIGINT) AS layer FROM (SELECT p_partkey, 1 + p_size % 24 AS n FROM part)")
def q_select_layers(spark, sf_dir):
    """Of 24 layers the bottom half and the top half of n, for the n of each part."""
    n = table(spark, sf_dir, "part").select("p_partkey", (1 + F.col("p_size") % 24).cast("long").alias("n"))
    return n.select("p_partkey", F.explode(weights.selected_layers(F.lit(24), F.col("n"))).alias("layer"))


@query("SELECT l_orderkey, l_linenumber, coalesce(o.o_totalprice, l.l_extendedprice) AS weight FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey AND o.o_orderstatus = l.l_linestatus")
def q_key_match(spark, sf_dir):
    """Values matched on a composite key; matched ones override."""
    base = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("key"), F.col("l_linestatus").alias("shape"), F.col("l_extendedprice").alias("value"))
    other = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("shape"), F.col("o_totalprice").alias("value"))
    return weights.matched(base, other, ["key", "shape"]).select("l_orderkey", "l_linenumber", F.col("value").alias("weight"))


@query("SELECT l.doc_id, CAST(d.n_chars AS BIGINT) AS n_chars FROM labels l JOIN documents d USING (doc_id) WHERE starts_with(d.source, 'src1')")
def q_prefix_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("source").startswith("src1"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", "n_chars")


@query(f"""WITH RECURSIVE {_TRACK}, r AS (SELECT user_id, i, CASE WHEN x / 1000 >= 0.24 THEN 0 ELSE x / 1000 END AS held, CASE WHEN x / 1000 >= 0.24 THEN 1 ELSE 0 END AS n, x / 1000 AS total FROM tr WHERE i = 0
 UNION ALL SELECT tr.user_id, tr.i, CASE WHEN held + tr.x / 1000 >= CASE WHEN n = 0 THEN 0.24 ELSE 0.5 END THEN 0 ELSE held + tr.x / 1000 END,
  n + CASE WHEN held + tr.x / 1000 >= CASE WHEN n = 0 THEN 0.24 ELSE 0.5 END THEN 1 ELSE 0 END, total + tr.x / 1000 FROM r JOIN tr ON tr.user_id = r.user_id AND tr.i = r.i + 1)
SELECT user_id, CAST(n + CASE WHEN held > 0 THEN 1 ELSE 0 END AS BIGINT) AS n, round(total, 6) AS seconds FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def q_rebuffer(spark, sf_dir):
    """Emission sizes per user when values arrive as seconds."""
    v = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("s"))
    out = v.select("user_id", metrics.rebuffer(F.transform("s.value", lambda x: x / 1000), 0.24, 0.5).alias("out"))
    return out.select("user_id", F.size("out").cast("long").alias("n"), F.round(ve.total(F.col("out")), 6).alias("seconds"))


@query("SELECT user_id, event_id, round(date_diff('microsecond', lag(ts) OVER w, ts) / 1e6, 6) AS gap, CASE WHEN lag(ts) OVER w IS NOT NULL THEN round(value / greatest(date_diff('microsecond', lag(ts) OVER w, ts) / 1e6, 1e-6), 4) END AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def q_throughput(spark, sf_dir):
    """Amount per second between log points."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").withColumn("gap", (us - F.lag(us).over(w)) / 1e6)
    return e.select("user_id", "event_id", F.round("gap", 6).alias("gap"), F.round(F.col("value") / F.greatest("gap", F.when(F.col("gap").isNotNull(), F.lit(1e-6))), 4).alias("rate"))


@query("SELECT round(avg(l_quantity), 6) AS mean, round(avg(CAST(l_quantity >= (SELECT max(l_quantity) FROM lineitem) - 0.1 AS DOUBLE)), 6) AS at_limit FROM lineitem")
def q_sample_stats(spark, sf_dir):
    found = metrics.sample_statistics(table(spark, sf_dir, "lineitem"), "l_quantity")
    return found.select(F.round("mean", 6).alias("mean"), F.round("at_limit", 6).alias("at_limit"))
