"""The corpus queries against their SQL, on whole tables."""

import duckdb
import pytest

from flowjobs.llm import queries

TABLES = "documents embeddings pages benchmark labels".split()


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    key = lambda r: tuple("" if x is None else f"{x:.5f}" if isinstance(x, float) else str(x) for x in r)
    assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, want.project(", ".join(f'"{c}"' for c in columns)).fetchall()))
