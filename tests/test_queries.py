"""Every registered query with SQL against DuckDB, and the others for rows and schema, on the smallest tables."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _plain():
    from tidemark.plans.queries import ORACLE_SQL, QUERIES

    return QUERIES, ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p).split('.')[0]} AS SELECT * FROM '{p}'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: "" if v is None or v != v else repr(round(float(v), 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


def close(a: str, b: str) -> bool:
    if a == b:
        return True
    try:
        x, y = float(a), float(b)
    except ValueError:
        return False
    return abs(x - y) <= 1e-6 * max(1.0, abs(x), abs(y))


@pytest.mark.parametrize("name", sorted(_plain()[1]))
def test_against_sql(spark, duck, name):
    queries, sql = _plain()
    got, want = queries[name](spark, SF), duck.sql(sql[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canonical([tuple(r) for r in got.collect()], got.columns), canonical(want.fetchall(), want.columns)
    assert len(a) == len(b)
    assert all(close(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", sorted(set(_plain()[0]) - set(_plain()[1])))
def test_runs(spark, name):
    df = _plain()[0][name](spark, SF)
    assert df.columns and df.limit(1).count() >= 0


def test_estimates_reach_the_last_january(spark):
    last = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("max(year(l_shipdate)) AS y").first().y
    dates = {r.date for r in _plain()[0]["hrp_weights"](spark, SF).select("date").distinct().collect()}
    assert max(dates) == f"{last}-01-01"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
