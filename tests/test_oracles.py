"""Every catalogue query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lumenspan.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def shown(v):
    if v is None or v != v:
        return "-"
    return f"{float(v):.4f}".replace("-0.0000", "0.0000") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    rel = duck.sql(catalog.SQL[name])
    names = sorted(got.columns)
    assert names == sorted(rel.columns)
    want = rel.df()[names]
    a = sorted(tuple(shown(r[c]) for c in names) for r in got.collect())
    b = sorted(
        tuple(
            shown(None if x is None or x != x else float(x) if isinstance(x, float) else x) for x in row
        ) for row in want.astype(object).where(want.notna(), None).itertuples(index=False)
    )
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
