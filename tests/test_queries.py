"""Every registered query of the library against its SQL, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__
from tallyglass.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


#: What reports of checks must show on sound data.
SOUND = {
    "reconciliation": lambda r: r["cells"] > 0 and r["mismatched"] == 0,
    "price_reconciliation": lambda r: r["cells"] > 0 and r["mismatched"] == 0,
    "result_invariants": lambda r: r["n"] == 0,
    "snapshot_checks": lambda r: r["n"] == 0,
    "feature_panel_checks": lambda r: r["passed"],
    "zero_strength_control": lambda r: r["passed"],
    "forecast_checks": lambda r: r["passed"],
}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.date() if not (v.hour or v.minute or v.second) else v
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = df.collect()
    rows = sorted((tuple(plain(r[c]) for c in names) for r in got), key=repr)
    joins = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in joins, "a cartesian product"
    if name in SOUND:
        assert got and all(SOUND[name](r) for r in got), got
    if name not in registry.SQL:
        return
    sql = duck.sql(registry.SQL[name])
    assert sorted(sql.columns) == names
    at = [sql.columns.index(c) for c in names]
    want = sorted((tuple(plain(r[k]) for k in at) for r in sql.fetchall()), key=repr)
    assert len(rows) == len(want)
    for a, b in zip(rows, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 + 1e-5 * abs(y)) for x, y in zip(a, b)), (a, b)
    spark.catalog.clearCache()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.SQL) <= set(registry.QUERIES) <= set(__spark_entry__.queries())
