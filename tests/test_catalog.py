"""Every query of the engine against its DuckDB twin, and the driver's contract."""

import math
import os

import duckdb
import pytest

from weftgraph.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        path = f"{sf}/{f}"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert rows
    if name not in ORACLE_SQL:
        return
    got = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=repr)
    assert rows == want


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    out = entry.entry(spark)
    assert out.columns == ["id", "label", "degree"] and out.count() == 20
