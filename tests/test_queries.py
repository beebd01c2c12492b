"""Every query with SQL gives the rows of its SQL; the others give rows of a stable schema."""

import math

import duckdb
import pytest

from gyre.plans import field_queries, file_queries, forcing_queries, mesh_queries  # noqa: F401  # they register their queries
from gyre.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, name):
    df = plans.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert rows
    if name not in plans.ORACLE_SQL:
        return
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = con.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    assert rows == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in got.fetchall())


def test_entry_module_has_queries_and_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(plans.QUERIES) <= set(e.queries())


def test_interpolation_joins_without_a_nested_loop(spark, sf):
    plan = plans.located(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
