"""Core queries against their SQL on the smallest tables, where these are present."""

import math
import os
from collections import Counter

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in v.items()) + "}"
    return str(v)


def compare(spark, name, query, sql):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = query(spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(canon(r.asDict(True)[c]) for c in cols) for r in df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = Counter(tuple(canon(row[names.index(c)]) for c in cols) for row in res.fetchall())
    assert got == want, name


def _core():
    import pagewright.plans.pages  # noqa: F401
    import pagewright.plans.trees  # noqa: F401
    from pagewright.plans.queries import QUERIES, SQL

    return QUERIES, SQL


@pytest.mark.parametrize("name", sorted(_core()[1]))
def test_sql(spark, name):
    queries, sql = _core()
    compare(spark, name, queries[name], sql[name])


@pytest.mark.parametrize("name", sorted(set(_core()[0]) - set(_core()[1])))
def test_runs(spark, name):
    assert _core()[0][name](spark, DATA).count() > 0


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
