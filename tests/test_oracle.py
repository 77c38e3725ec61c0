"""Registered queries against their SQL on the smallest tables, where those are at hand."""

import os

import pytest

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def rows(cols, values):
    key = lambda x: (x is None, f"{x:.9g}" if isinstance(x, float) else str(x))
    return sorted(tuple(key(v[c]) for c in cols) for v in values)


def test_all_with_sql(spark):
    import duckdb

    from folioscope import catalog

    con = duckdb.connect()
    for t in os.listdir(D):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{D}/{t}'")
    wrong = []
    for name, sql in catalog.SQL.items():
        df = catalog.QUERIES[name](spark, D)
        cols = sorted(df.columns)
        rel = con.sql(sql)
        assert sorted(rel.columns) == cols, name
        got = rows(cols, [r.asDict() for r in df.collect()])
        want = rows(cols, [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()])
        if got != want:
            wrong.append(name)
    assert not wrong


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
