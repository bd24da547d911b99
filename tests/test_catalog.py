"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from driftline.plans import catalog, catalog_audit, catalog_extra, catalog_fields, catalog_links, catalog_more, catalog_summary  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(x, y):
    if isinstance(x, float) and isinstance(y, (int, float)):
        return x == y or abs(x - y) <= 1e-6 * max(1, abs(x))
    return x == y


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(catalog.SQL[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    a = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    b = sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=repr)
    assert len(a) == len(b)
    assert [x for x in zip(a, b, strict=True) if not all(map(same, *x))] == []
