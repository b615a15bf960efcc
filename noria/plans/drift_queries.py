"""Drift of generated vectors: groups of eight embeddings, the first of which is the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noria.operators import drift

from .registry import query
from .sequence_queries import _E, vectors

_TEMP = 0.5
_KERNEL = f"""{_E},
r AS (SELECT vec_id // 8 AS g, vec_id % 8 AS slot, v FROM e),
p AS (SELECT i.g, i.slot AS i, j.slot AS j, i.v AS x, j.v AS y, sqrt(greatest(list_sum(list_transform(range(1, len(i.v) + 1), lambda k: pow(i.v[k] - j.v[k], 2))), 1e-8)) AS d
  FROM r i JOIN r j USING (g) WHERE i.slot > 0),
n AS (SELECT *, count(*) OVER (PARTITION BY g, i) AS n, min(j) OVER (PARTITION BY g) AS least FROM p),
s AS (SELECT *, greatest(avg(d) OVER (PARTITION BY g) * n / (n - 1), 1e-3) AS scale FROM n WHERE n > 1 AND least = 0),
l AS (SELECT *, -(d / scale + CASE WHEN i = j THEN 100.0 ELSE 0.0 END) / CAST({_TEMP} AS DOUBLE) AS z FROM s),
k AS (SELECT *, z - ln(sum(exp(z)) OVER (PARTITION BY g, i)) AS a, z - ln(sum(exp(z)) OVER (PARTITION BY g, j)) AS b FROM l),
w AS (SELECT *, sqrt(greatest(exp(a) * exp(b), 1e-6)) AS w, sqrt(CAST(len(x) AS DOUBLE)) / scale AS unit FROM k)"""
_FORCE = f"""{_KERNEL},
t AS (SELECT g, i, max(w) FILTER (j = 0) AS pull, sum(w) FILTER (j > 0) AS push FROM w GROUP BY g, i),
c AS (SELECT w.g, w.i, w.j, x, y, unit, CASE WHEN j = 0 THEN pull * push ELSE -w * pull END AS c FROM w JOIN t ON w.g = t.g AND w.i = t.i),
u AS (SELECT g, i, unnest(range(1, len(x) + 1)) AS k, unnest(x) AS x, unnest(y) AS y, c, unit FROM c),
f AS (SELECT g, i, k, sum(c * (y - x)) * any_value(unit) AS f, any_value(x * unit) AS x FROM u GROUP BY g, i, k),
m AS (SELECT g, sqrt(greatest(avg(f * f), 1e-8)) AS rms FROM f GROUP BY g)"""


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.expr("vec_id div 8").alias("group"), (F.col("vec_id") % 8).alias("slot"), "v")


@query(f"WITH {_KERNEL} SELECT g AS grp, i AS slot, round(max(a + ln(n - 1)) FILTER (j = 0), 6) AS log_mass, round(max(scale), 6) AS scale FROM w GROUP BY g, i")
def q_drift_mass(spark, sf_dir):
    found = drift.drift(groups(spark, sf_dir), _TEMP, None)
    return found.select(F.col("group").alias("grp"), "slot", F.round("log_mass", 6).alias("log_mass"), F.round("scale", 6).alias("scale"))


def _force_query(name: str, normalise: str | None, divisor: str) -> None:
    def run(spark, sf_dir):
        found = drift.drift(groups(spark, sf_dir), _TEMP, normalise)
        rows = found.select(F.col("group").alias("grp"), "slot", F.posexplode("force").alias("pos", "f"))
        return rows.select("grp", "slot", "pos", (F.round("f", 5) + 0.0).alias("f"))

    run.__name__ = name
    query(f"WITH {_FORCE} SELECT f.g AS grp, i AS slot, CAST(k - 1 AS INTEGER) AS pos, round(f / {divisor}, 5) + 0.0 AS f FROM f JOIN m ON f.g = m.g")(run)


_force_query("q_drift_force", "batch", "(SELECT avg(rms) FROM m)")
_force_query("q_drift_force_by_group", "group", "rms")


@query(f"""WITH {_FORCE},
a AS (SELECT f.g, avg(pow(f / (SELECT avg(rms) FROM m), 2)) AS loss FROM f GROUP BY f.g),
b AS (SELECT g, max(mass) AS most FROM (SELECT g, i, max(a + ln(n - 1)) FILTER (j = 0) AS mass FROM w GROUP BY g, i) GROUP BY g),
v AS (SELECT g, sqrt(sum(s)) AS std FROM (SELECT g, k, var_samp(x) AS s FROM f GROUP BY g, k) GROUP BY g)
SELECT round(avg(loss), 6) AS loss, round(-avg(most), 6) AS temp_loss, round(avg(std), 6) AS std_mean FROM a JOIN b USING (g) JOIN v USING (g)""")
def q_drift_metrics(spark, sf_dir):
    found = drift.drift_metrics(drift.drift(groups(spark, sf_dir), _TEMP, "batch"))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])
