"""The SQL of the corpus operators gives the same rows as their queries."""

import duckdb
import pytest

from driftline.llm import queries

from ..test_catalog import SF, TABLES, same


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name, sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    place = [want.columns.index(x) for x in columns]
    a = sorted((tuple(r[x] for x in columns) for r in df.collect()), key=repr)
    b = sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=repr)
    assert len(a) == len(b) and [x for x in zip(a, b, strict=True) if not all(map(same, *x))] == []
