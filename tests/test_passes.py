"""What the flow queries move: raw rows are dealt once, and labels are made for sums, not for raw rows."""

import pyspark.sql.functions as F
import pytest

from flowjobs import registry, tables
from flowjobs.operators import groups, joins


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def below(lines, at):
    """The lines of the subtree of line ``at``."""
    depth = lambda s: len(s) - len(s.lstrip(" :+-"))
    out = []
    for line in lines[at + 1 :]:
        if depth(line) <= depth(lines[at]):
            break
        out.append(line)
    return out


def test_lines_meet_customers_with_their_orders_alone(spark, sf_dir):
    lines = optimized(tables.flows(spark, sf_dir))
    at = next(i for i, s in enumerate(lines) if "Join Inner" in s and "o_custkey" in s and "c_custkey" in s)
    assert not any("l_orderkey" in s for s in below(lines, at))
    at = next(i for i, s in enumerate(lines) if "Join Inner" in s and "l_orderkey" in s and "o_orderkey" in s)
    # Prices and dates have turned into a value and a year, parts and suppliers into codes.
    given = next(s for s in below(lines, at) if "Project" in s and "l_orderkey" in s)
    assert not any(c in given.split("[", 1)[1] for c in ("l_extendedprice", "l_discount", "l_shipdate", "l_partkey", "l_suppkey"))


@pytest.mark.parametrize("name", ["vw3_marker_view", "vw2_recipients_view", "a05_donor_group_totals", "a04_recipient_group_totals"])
def test_no_labels_are_made_for_raw_rows(spark, sf_dir, name):
    lines = optimized(registry.queries()[name](spark, sf_dir))
    # It would stand in a filter or in the condition of a join.
    assert not any("size(" in s for s in lines)


def test_repeat_for_keeps_null_labels_and_drops_rows_without(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None), (4, ["b"])], "id int, names array<string>")
    out = groups.repeat_for(df, F.col("names"), "name").select("id", "name").collect()
    assert sorted(out, key=str) == sorted(df.select("id", F.explode("names").alias("name")).collect(), key=str)


@pytest.mark.parametrize("name", ["j04_checked_join", "s07_manifest", "v02_to_v07_gates", "v20_validate_all", "v20_validate_dataset_gates", "vw3_marker_classified", "vw5_total_less_parts"])
def test_flows_are_read_once(spark, sf_dir, monkeypatch, name):
    seen, make = spark.sparkContext.accumulator(0), tables.flows

    def counted(year):
        seen.add(1)
        return True

    monkeypatch.setattr(tables, "flows", lambda *of: make(*of).where(F.udf(counted, "boolean")("year")))
    registry.queries()[name](spark, sf_dir).collect()
    assert 0 < seen.value <= tables.read(spark, sf_dir, "lineitem").count()


def test_checked_join_asks_what_it_has_written_whether_there_are_rows(spark, monkeypatch):
    kind, asked = type(spark.range(1)), []
    empty = kind.isEmpty
    monkeypatch.setattr(kind, "isEmpty", lambda self: asked.append(optimized(self)) or empty(self))
    rows = spark.range(10).join(spark.range(5), "id").withColumn("value", F.lit(1.0))
    out = joins.checked_join(rows, spark.range(3).withColumn("name", F.lit("a")), ["id"], "value")
    assert out.count() == 5 and not any("Join" in s for lines in asked for s in lines)
    assert joins.checked_join(rows.where("id > 9"), spark.range(3).withColumn("name", F.lit("a")), ["id"], "value").count() == 0
