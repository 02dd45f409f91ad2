"""Registered SQL of the subpackage against its queries."""

import duckdb
import pytest

from kinloom.llm import registry

from ..conftest import DATA


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    df = registry.queries()[name](spark, DATA)
    db = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = db.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)
