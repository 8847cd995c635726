"""Each catalogue query against its SQL on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

from ctxloom.plans import catalogue  # noqa: E402


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    return con


def shown(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return "[" + ",".join(map(shown, v)) + "]" if isinstance(v, list) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, sql, name):
    df = catalogue.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted("|".join(shown(r[c]) for c in names) for r in df.collect())
    found = sql.execute(catalogue.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = sorted("|".join(shown(r[columns.index(c)]) for c in names) for r in found.fetchall())
    assert got == want


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
