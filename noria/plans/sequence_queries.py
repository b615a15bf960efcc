"""Signal and vector operators over events and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noria.functions import vectors as ve
from noria.operators import signal

from .registry import query, table

#: DuckDB: events as a track per user.
_TRACK = "tr AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x FROM events)"
_SILENT = f"{_TRACK}, th AS (SELECT user_id, greatest(quantile_cont(x, 0.9) - 35, least(quantile_cont(x, 0.05) + 8, quantile_cont(x, 0.9) - 15)) AS threshold FROM tr GROUP BY user_id), si AS (SELECT tr.*, x < threshold + 120 AS silent FROM tr JOIN th USING (user_id))"


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("value").alias("x"))


def silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = track(spark, sf_dir)
    return t.join(signal.thresholds(t, "user_id"), "user_id").withColumn("silent", F.col("x") < F.col("threshold") + 120)


@query(f"WITH {_TRACK} SELECT user_id, i, round(sum(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3, 6) AS x FROM tr")
def q_moving_avg(spark, sf_dir):
    return signal.smooth3(track(spark, sf_dir), "user_id").select("user_id", "i", F.round("x", 6).alias("x"))


@query(f"WITH {_TRACK} SELECT user_id, CAST(i // 10 AS BIGINT) AS i, round(10 * log10(avg(x * x) + 1e-12), 6) AS x FROM tr GROUP BY user_id, i // 10 HAVING count(*) = 10")
def q_energy(spark, sf_dir):
    return signal.frame_energy(track(spark, sf_dir), "user_id", 10).select("user_id", "i", F.round("x", 6).alias("x"))


@query(f"WITH {_SILENT} SELECT user_id, round(threshold, 6) AS threshold FROM th")
def q_threshold(spark, sf_dir):
    return signal.thresholds(track(spark, sf_dir), "user_id").select("user_id", F.round("threshold", 6).alias("threshold"))


@query(f"WITH {_SILENT}, g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, silent ORDER BY i) AS g FROM si), r AS (SELECT user_id, min(i) AS start, count(*) AS n FROM g WHERE silent GROUP BY user_id, g), b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, start) = 1) SELECT u.user_id, coalesce(start, 0) AS start, coalesce(n, 0) AS length FROM (SELECT DISTINCT user_id FROM tr) u LEFT JOIN b USING (user_id)")
def q_longest_run(spark, sf_dir):
    return signal.longest_run(silent(spark, sf_dir), ["user_id"], "silent")


@query(f"WITH {_TRACK} SELECT user_id, i AS at FROM tr QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY x, i) = 1")
def q_first_minimum(spark, sf_dir):
    return signal.first_minimum(track(spark, sf_dir), ["user_id"])


@query(f"WITH {_SILENT}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM si), w AS (SELECT *, min(silent) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS ahead, min(silent) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AND i >= 3 AS behind FROM n) SELECT user_id, coalesce(max(i) FILTER (behind AND i <= n // 3), 0) AS first_start, coalesce(min(i) FILTER (ahead AND i >= n // 2), count(*)) AS last_end FROM w GROUP BY user_id")
def q_speech_edges(spark, sf_dir):
    t = silent(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    return signal.speech_edges(t, "user_id", "silent", 3, F.expr("n div 3"), F.expr("n div 2"))


@query(f"""WITH {_SILENT}, f AS (SELECT user_id, (i + 5) // 20 AS pair, i, x, silent FROM si WHERE (i + 5) % 20 < 11 AND i >= 15),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, pair, silent ORDER BY i) AS g FROM f), r AS (SELECT user_id, pair, min(i) AS s, count(*) AS n FROM g WHERE silent GROUP BY user_id, pair, g),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id, pair ORDER BY n DESC, s) = 1), m AS (SELECT user_id, pair, i AS lo FROM f QUALIFY row_number() OVER (PARTITION BY user_id, pair ORDER BY x, i) = 1)
SELECT m.user_id, CAST(m.pair AS BIGINT) AS pair, round(CAST(CASE WHEN n >= 3 THEN s ELSE lo + 0.5 END AS DOUBLE) * CAST(0.1 AS DOUBLE), 3) AS word_end, round(CAST(CASE WHEN n >= 3 THEN s + n ELSE lo + 0.5 END AS DOUBLE) * CAST(0.1 AS DOUBLE), 3) AS word_start, CASE WHEN n >= 3 AND n * 0.1 >= 0.55 THEN '.' WHEN n >= 3 AND n * 0.1 >= 0.22 THEN ',' ELSE '' END AS mark FROM m LEFT JOIN b USING (user_id, pair)""")
def q_refine(spark, sf_dir):
    """Word boundaries at every 20th frame, searched five frames to either side."""
    f = silent(spark, sf_dir).where("(i + 5) % 20 < 11 AND i >= 15").withColumn("pair", F.expr("(i + 5) div 20"))
    return signal.refine(f, ["user_id", "pair"], "silent", 3, 0.1)


_E = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", ve.doubles(F.col("embedding")).alias("v"))


def _exploded(df: DataFrame, name: str = "v", digits: int = 4) -> DataFrame:
    """vec_id, pos, x: rounded values one by one, so engines compare number by number."""
    return df.select("vec_id", F.posexplode(name).alias("pos", "x")).select("vec_id", "pos", (F.round("x", digits) + 0.0).alias("x"))


def _duck_exploded(expression: str, digits: int = 4) -> str:
    return f"WITH {_E}, y AS (SELECT vec_id, unnest({expression}) AS x, CAST(generate_subscripts({expression}, 1) - 1 AS INTEGER) AS pos FROM e) SELECT vec_id, pos, round(x, {digits}) + 0.0 AS x FROM y"


@query(_duck_exploded("list_transform(v, lambda x: (x - list_avg(v)) / sqrt(list_var_samp(v) + 1e-7))"))
def q_normalise_vec(spark, sf_dir):
    return _exploded(vectors(spark, sf_dir).select("vec_id", ve.normalise(F.col("v")).alias("v")))


@query(_duck_exploded("list_transform(v[1:8], lambda x: x - list_max(v[1:8]) - ln(list_sum(list_transform(v[1:8], lambda y: exp(y - list_max(v[1:8]))))))"))
def q_log_softmax(spark, sf_dir):
    return _exploded(vectors(spark, sf_dir).select("vec_id", ve.log_softmax(F.slice("v", 1, 8)).alias("v")))


@query(f"WITH {_E}, p AS (SELECT vec_id, list_resize(v[1:1 + CAST(vec_id % 9 AS BIGINT)], 9, 0.0) AS v, 1 + vec_id % 9 AS n FROM e) SELECT vec_id, CAST(n AS BIGINT) AS n, CAST(len(v) AS BIGINT) AS size, round(list_sum(v), 4) AS s FROM p")
def q_pad(spark, sf_dir):
    p = vectors(spark, sf_dir).select("vec_id", (1 + F.col("vec_id") % 9).alias("n"), F.slice("v", F.lit(1), (1 + F.col("vec_id") % 9).cast("int")).alias("v"))
    p = p.withColumn("v", ve.pad(F.col("v"), F.lit(9))).withColumn("m", ve.mask(F.col("n"), F.lit(9)))
    return p.select("vec_id", F.size(F.filter("m", lambda x: x)).cast("long").alias("n"), F.size("v").cast("long").alias("size"), F.round(ve.total(F.col("v")), 4).alias("s"))


@query(f"WITH {_E}, b AS (SELECT vec_id // 8 AS batch, max(1 + vec_id % 9) AS widest, count(*) AS n, sum(1 + vec_id % 9) AS used FROM e GROUP BY 1) SELECT CAST(batch AS BIGINT) AS batch, widest, n, CAST(used AS BIGINT) AS used, CAST(n * widest - used AS BIGINT) AS padding FROM b")
def q_collate(spark, sf_dir):
    """Batches of eight padded to their longest member."""
    rows = vectors(spark, sf_dir).select(F.expr("vec_id div 8").alias("batch"), F.slice("v", F.lit(1), (1 + F.col("vec_id") % 9).cast("int")).alias("v"))
    batches = rows.groupBy("batch").agg(F.collect_list("v").alias("vs"), F.max(F.size("v")).cast("long").alias("widest"))
    padded = batches.withColumn("padded", F.transform("vs", lambda v: ve.pad(v, F.col("widest"))))
    used = F.aggregate("vs", F.lit(0).cast("long"), lambda s, v: s + F.size(v))
    return padded.select("batch", "widest", F.size("vs").cast("long").alias("n"), used.alias("used"), (ve.total(F.transform("padded", lambda v: F.size(v).cast("double"))) - used).cast("long").alias("padding"))


@query(f"WITH {_E}, y AS (SELECT vec_id, unnest(v) AS x, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos FROM e) SELECT vec_id, pos, CAST(trunc(greatest(-1.0, least(1.0, x * 3)) * 32767) AS INTEGER) AS pcm FROM y")
def q_pcm16(spark, sf_dir):
    p = vectors(spark, sf_dir).select("vec_id", ve.pcm16(F.transform("v", lambda x: x * 3)).alias("v"))
    return p.select("vec_id", F.posexplode("v").alias("pos", "pcm")).select("vec_id", "pos", F.col("pcm").cast("int").alias("pcm"))


@query(_duck_exploded("list_transform(v, lambda x: x * 9 / greatest(1.0, list_max(list_transform(v, lambda y: abs(y * 9)))))"))
def q_peak(spark, sf_dir):
    return _exploded(vectors(spark, sf_dir).select("vec_id", ve.peak_normalise(F.transform("v", lambda x: x * 9)).alias("v")))


@query(_duck_exploded("list_transform(range(1, 33), lambda i: (v[i] + v[i + 32]) / 2)", 6))
def q_downmix(spark, sf_dir):
    return _exploded(vectors(spark, sf_dir).select("vec_id", ve.down_mix(F.slice("v", 1, 32), F.slice("v", 33, 32)).alias("v")), digits=6)


@query(_duck_exploded("list_transform(range(1, 33), lambda i: v[i] + 1.5 * (v[i + 32] - v[i]))", 6))
def q_cfg_combine(spark, sf_dir):
    return _exploded(vectors(spark, sf_dir).select("vec_id", ve.guided(F.slice("v", 1, 32), F.slice("v", 33, 32), 1.5).alias("v")), digits=6)


@query(_duck_exploded("list_concat(v[1:4], v[14:18])", 6))
def q_stitched(spark, sf_dir):
    """Four frames of a stitch block, then stored frames from cut 9 on, nine in all."""
    v = vectors(spark, sf_dir)
    return _exploded(v.select("vec_id", ve.stitched(F.slice("v", 1, 4), F.col("v"), F.lit(9), F.lit(9)).alias("v")), digits=6)


@query(f"WITH {_E}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) AS d FROM e a JOIN e b ON a.vec_id // 8 = b.vec_id // 8 AND a.vec_id < b.vec_id) SELECT a, b, round(sqrt(greatest(d, 1e-8)), 5) AS distance FROM p")
def q_cdist(spark, sf_dir):
    """Distances within groups of eight: an equi-join on the group."""
    v = vectors(spark, sf_dir).withColumn("g", F.expr("vec_id div 8"))
    pairs = v.alias("a").join(v.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.vec_id") < F.col("b.vec_id")))
    return pairs.select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), F.round(F.sqrt(F.greatest(ve.squared_distance(F.col("a.v"), F.col("b.v")), F.lit(1e-8))), 5).alias("distance"))


@query(f"""WITH RECURSIVE {_E}, em AS (SELECT vec_id, t, v[8 * t + 1:8 * t + 8] AS f FROM e, range(8) r(t)),
st AS (SELECT vec_id, 0 AS t, [0.0, CAST('-inf' AS DOUBLE), CAST('-inf' AS DOUBLE), CAST('-inf' AS DOUBLE)] AS s FROM e
 UNION ALL SELECT st.vec_id, st.t + 1, [s[1] + f[1], greatest(s[2] + f[1], s[1] + f[3]), greatest(s[3] + f[1], s[2] + f[6]), greatest(s[4] + f[1], s[3] + f[4])] FROM st JOIN em ON em.vec_id = st.vec_id AND em.t = st.t)
SELECT vec_id, round(s[4], 5) AS score FROM st WHERE t = 8""")
def q_viterbi_score(spark, sf_dir):
    """Eight frames of eight scores, tokens 2, 5, 3."""
    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("v", t * 8 + 1, F.lit(8)))
    tokens = F.array(F.lit(2), F.lit(5), F.lit(3))
    return vectors(spark, sf_dir).select("vec_id", F.round(signal.viterbi(frames, tokens), 5).alias("score"))
