"""Long series: numbers, runs, recurrences and quantiles where one key may hold all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from noria.operators import blocks, metrics, ordering, quantiles, signal

from .registry import query, table
from .sequence_queries import _SILENT, _TRACK, silent, track


#: exp(-0.1). With a short decimal, states would end in a 5 just where they are rounded.
_DECAY = 0.9048374180359595
_D = f"CAST({_DECAY!r} AS DOUBLE)"


@query("SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events")
def q_number_within(spark, sf_dir):
    """Numbers within five types, each of which holds a fifth of the table."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    return ordering.number_within(e, ["event_type"], ["ts", "event_id"], "i").select("event_type", "event_id", "i")


@query(f"""WITH RECURSIVE {_TRACK}, r AS (SELECT user_id, i, x AS s FROM tr WHERE i = 0
 UNION ALL SELECT tr.user_id, tr.i, {_D} * s + (1 - {_D}) * x FROM r JOIN tr ON tr.user_id = r.user_id AND tr.i = r.i + 1)
SELECT user_id, i, round(s, 5) AS ema FROM r""")
def q_ema_steps(spark, sf_dir):
    """The state after every event of each user."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return metrics.ema_steps(e, ["user_id"], ["ts", "event_id"], "value", _DECAY).select("user_id", "i", F.round("ema", 5).alias("ema"))


@query(f"""WITH t AS (SELECT event_id, row_number() OVER w - 1 AS i, first_value(value) OVER w AS x0, list(value) OVER (ORDER BY event_id ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS l FROM events WINDOW w AS (ORDER BY event_id))
SELECT event_id, i, round((1 - {_D}) * list_sum(list_transform(l, lambda x, k: x * pow({_D}, len(l) - k))) + pow({_D}, i + 1) * x0, 5) AS ema FROM t""")
def q_ema_one_series(spark, sf_dir):
    """All events as one series, in blocks of 1024. The twin sums the last 400 terms; older ones weigh under 1e-17."""
    e = table(spark, sf_dir, "events").select(F.lit(0).alias("all"), "event_id", "value")
    return metrics.ema_steps(e, ["all"], ["event_id"], "value", _DECAY, size=1024).select("event_id", "i", F.round("ema", 5).alias("ema"))


@query("""WITH t AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value > 40 AS f FROM events), g AS (SELECT *, i - row_number() OVER (PARTITION BY f ORDER BY i) AS g FROM t)
SELECT min(i) AS start, count(*) AS length FROM g WHERE f GROUP BY g""")
def q_runs(spark, sf_dir):
    """All runs of values above 40 in the events as one track, in blocks of 64."""
    e = table(spark, sf_dir, "events").select(F.lit(0).alias("all"), "event_id", (F.col("value") > 40).alias("f"))
    return blocks.runs(ordering.number_within(e, ["all"], ["event_id"], "i"), ["all"], "f", 64).select("start", "length")


@query(f"WITH {_TRACK} SELECT user_id, i, round(avg(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS smooth FROM tr WHERE true QUALIFY i >= 2")
def q_moving_mean(spark, sf_dir):
    found = blocks.moving_mean(track(spark, sf_dir), ["user_id"], "x", 3, "smooth", size=4)
    return found.select("user_id", "i", F.round("smooth", 6).alias("smooth"))


@query(f"WITH {_SILENT}, g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, silent ORDER BY i) AS g FROM si), r AS (SELECT user_id, min(i) AS start, count(*) AS n FROM g WHERE silent GROUP BY user_id, g), b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, start) = 1) SELECT u.user_id, coalesce(start, 0) AS start, coalesce(n, 0) AS length FROM (SELECT DISTINCT user_id FROM tr) u LEFT JOIN b USING (user_id)")
def q_longest_run_small_blocks(spark, sf_dir):
    """As q_longest_run, with blocks of four frames, so that most runs are joined over edges."""
    return signal.longest_run(silent(spark, sf_dir), ["user_id"], "silent", size=4)


_PARTS = (0.0, 0.03, 0.5, 0.9, 0.999)
_LISTED = ", ".join(f"round(quantile_cont({{x}}, {p}), 6) AS q{k}" for k, p in enumerate(_PARTS))


def _spread(df):
    return df.select(*[c for c in df.columns if c != "q"], *[F.round(F.element_at("q", k + 1), 6).alias(f"q{k}") for k in range(len(_PARTS))])


@query(f"SELECT l_returnflag, {_LISTED.format(x='l_extendedprice')} FROM lineitem GROUP BY l_returnflag")
def q_quantiles_by_flag(spark, sf_dir):
    """Three groups of all lines; no task sorts more than 2048 values."""
    return _spread(quantiles.exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", list(_PARTS), limit=2048))


@query(f"SELECT {_LISTED.format(x='l_quantity')} FROM lineitem")
def q_quantiles_of_ties(spark, sf_dir):
    """One group of all lines, with fifty different values."""
    return _spread(quantiles.exact_quantiles(table(spark, sf_dir, "lineitem"), [], "l_quantity", list(_PARTS), limit=2048))


@query(f"WITH {_SILENT} SELECT user_id, round(threshold, 6) AS threshold FROM th")
def q_threshold_hot(spark, sf_dir):
    return signal.thresholds(track(spark, sf_dir), "user_id", hot=True).select("user_id", F.round("threshold", 6).alias("threshold"))
