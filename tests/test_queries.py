"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = [n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_duckdb(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(d[0] for d in want.description)
    at = {d[0]: i for i, d in enumerate(want.description)}
    a = sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=str)
    b = sorted(([plain(r[at[c]]) for c in columns] for r in want.fetchall()), key=str)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, abs_tol=2e-5, rel_tol=1e-6)) for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith(("op", "pipeline"))])
def test_others_have_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_fits_cover_every_entity(spark):
    want = {r.entity for r in entry.registry.returns(spark, SF).select("entity").distinct().collect()}
    assert len(want) > 4
    for name in ("m6_garch", "m7_filtered_historical"):
        assert sorted(r.entity for r in entry.queries()[name](spark, SF).collect()) == sorted(want)
