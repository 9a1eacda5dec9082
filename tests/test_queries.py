"""Every query with SQL gives the rows that DuckDB gives."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from voxloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if hasattr(x, "isoformat"):
        return x.isoformat()[:19]
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    if x is None or isinstance(x, (str, bool)):
        return x
    return "nan" if math.isnan(x) else float(f"{float(x):.6g}")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = catalog.QUERIES[name](spark, sf_dir)
    result = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    order = [columns.index(c) for c in sorted(columns)]
    want = Counter(tuple(value(r[i]) for i in order) for r in result.fetchall())
    got = Counter(tuple(value(r[c]) for c in sorted(columns)) for r in found.collect())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
