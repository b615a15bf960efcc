"""Every query of the library with a DuckDB twin, at the smallest scale."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from noria.plans import catalogue  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 9) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_twin(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(ours.columns)
    theirs = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(theirs.columns) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in ours.collect()), key=repr)
    at = [theirs.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in theirs.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_flagship(spark):
    rows = catalogue.flagship(spark, FOLDER).collect()
    assert len(rows) == 200 and all(len(r["chunks"]) == len(r["token_ids"]) for r in rows)
    assert all(c.endswith(".") for r in rows for c in r["chunks"])
