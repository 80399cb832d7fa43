"""The registered queries with SQL against DuckDB on the smallest tables."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", ["op1_quality_rules", "op3_license_scan", "op6_embedding", "op10_line_dedup"])
def test_against_sql(spark, name):
    from tidemark.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p).split('.')[0]} AS SELECT * FROM '{p}'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    show = lambda rows, names: sorted(tuple(str(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in rows)
    assert show([tuple(r) for r in got.collect()], got.columns) == show(want.fetchall(), want.columns)


def test_all_ten_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
