import duckdb
import pytest
from pathlib import Path

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The queries over flows; those of the corpus operators have their own tests.
CHECKED = [name for name in entry.oracle_sql() if not name.startswith("op")]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = entry.queries()[name](spark, sf_dir)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = lambda r: tuple("" if x is None else f"{x:.5f}" if isinstance(x, float) else str(x) for x in r)
    assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, want.project(", ".join(f'"{c}"' for c in columns)).fetchall() if hasattr(want, "fetchall") else []))


def test_broadcast_lookups_and_no_python_over_rows(spark, sf_dir):
    plan = entry.queries()["vw2_recipients_view"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "BroadcastHashJoin" in plan
    # The largest view has slugs: Python runs on the two tables of distinct names, never between the sums and the result.
    plan = entry.queries()["vw4_sectors_view"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and all(plan[m:].splitlines()[1].lstrip(" :+-").startswith("Aggregate") for m in (plan.index("ArrowEvalPython"), plan.rindex("ArrowEvalPython")))
