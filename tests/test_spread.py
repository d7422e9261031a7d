"""Work that is spread, pruned or observed as it should be: salts, folders, pairs, metrics, bitmaps, documents."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowjobs.operators import groups, joins
from flowjobs.plans import release
from flowjobs.sources import io


@pytest.fixture
def conf(spark):
    old = {}

    def put(**kw):
        for k, v in kw.items():
            k = k.replace("__", ".")
            old.setdefault(k, spark.conf.get(k, None))
            spark.conf.set(k, v)

    yield put
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_dominating_key_is_cut_into_salts(spark, conf):
    conf(spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__shuffle__partitions="8")
    left = spark.range(300).select((F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(1)).alias("k"), F.col("id").alias("a"))
    right = spark.range(2000).select((F.when(F.col("id") % 10 == 0, F.col("id") % 300).otherwise(1)).alias("k"), F.col("id").alias("b"))
    plain = left.join(right, "k")
    sizes = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    salted = joins.salted_join(left, right, ["k"], pairs_per_task=2000)
    assert sizes(plain)[-1] > 0.9 * plain.count()
    got = sizes(salted)
    assert len(got) == 8 and got[-1] <= 2 * got[4] and sum(got) == plain.count()
    assert salted.groupBy().agg(F.sum(F.xxhash64("k", "a", "b").cast("decimal(38,0)"))).first() == plain.groupBy().agg(F.sum(F.xxhash64("k", "a", "b").cast("decimal(38,0)"))).first()


def test_salted_join_of_nothing_and_nulls(spark):
    left = spark.createDataFrame([(None, 1), (1, 2)], "k int, a int")
    right = spark.createDataFrame([(None, 5), (1, 6), (1, 7)], "k int, b int")
    assert sorted(map(tuple, joins.salted_join(left, right, ["k"], 1).collect())) == [(1, 2, 6), (1, 2, 7)]
    assert joins.salted_join(left.limit(0), right, ["k"]).count() == 0


def test_a_hot_folder_is_written_by_many_tasks(spark, conf, tmp_path):
    conf(spark__sql__adaptive__advisoryPartitionSizeInBytes="64k", spark__sql__shuffle__partitions="97")
    rows = spark.range(60_000).select(F.when(F.col("id") % 20 == 0, F.concat(F.lit("small"), (F.col("id") / 20 % 5).cast("int").cast("string"))).otherwise("hot").alias("slug"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    io.write_partitioned(rows, str(tmp_path / "v"), ["slug"])
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "v").iterdir() if d.is_dir()}
    assert files["slug=hot"] > 3 and all(n == 1 for d, n in files.items() if d != "slug=hot")
    assert spark.read.parquet(str(tmp_path / "v")).count() == 60_000


def test_pairs_prune_folders_while_the_query_runs(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i}", f"r{j}", i * j) for i in range(6) for j in range(6)], "donor_slug string, recipient_slug string, v int")
    rows.write.partitionBy("donor_slug", "recipient_slug").parquet(str(tmp_path / "base"))
    asked = [("mine", "d1", "r2"), ("mine", "d3", "r4"), ("mine", "d3", "r4"), ("mine", "dx", "r1"), ("other", "d5", "r5")]
    spark.createDataFrame(asked, "selection string, donor_slug string, recipient_slug string").write.parquet(str(tmp_path / "pairs"))
    out = io.read_partition_pairs(spark, str(tmp_path / "base"), spark.read.parquet(str(tmp_path / "pairs")), "mine")
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["donor_slug"], r["recipient_slug"], r["v"]) for r in out.collect()) == [("d1", "r2", 2), ("d3", "r4", 12)]


def test_a_join_that_changes_a_total_is_an_error(spark, monkeypatch):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0), (None, 4.0)], "k int, value double")
    dim = spark.createDataFrame([(1, "a"), (None, "n")], "k int, name string")
    plans = []
    monkeypatch.setattr(joins, "stored", lambda d, name: (plans.append(d._jdf.queryExecution().executedPlan().toString()), io.stored(d, name))[1])
    out = joins.checked_join(df, dim, ["k"], "value")
    assert {r["k"]: r["name"] for r in out.collect()} == {1: "a", 2: None, None: "n"}
    assert plans[0].count("CollectMetrics") == 2
    with pytest.raises(ValueError, match="changed 3 rows, total 9.0, to 4 rows, total 11.0"):
        joins.checked_join(df, dim.union(dim.limit(1)), ["k"], "value")
    assert joins.checked_join(df.limit(0), dim, ["k"], "value").count() == 0


def test_codes_that_disagree_are_an_error(spark):
    df = spark.createDataFrame([(2000, "x", 1, 5.0), (2000, "x", 2, 5.0), (2000, "y", 1, 5.0), (2000, "y", 2, None)], "year int, name string, code int, value double")
    kept, _ = joins.resolve_code_duplicates(df, ["year", "name"], "code", "value", raise_error=True)
    assert kept.count() == 2
    bad = df.union(spark.createDataFrame([(2001, "x", 1, 5.0), (2001, "x", 2, 6.0)], df.schema))
    with pytest.raises(ValueError, match="year=2001, name=x"):
        joins.resolve_code_duplicates(bad, ["year", "name"], "code", "value", raise_error=True)


def test_coverage_of_large_groups(spark):
    rnd = random.Random(1)
    codes = list(range(1, 141))
    rows = [(y, c) for y in range(30) for c in codes if rnd.random() < 0.9 and c not in (7, 130)] + [(99, 500), (5, None)]
    df = spark.createDataFrame(rows, "year int, code int")
    members = spark.createDataFrame([("big", c) for c in codes] + [("big", 7), ("none", 999)], "group_name string, member_code int")
    seen = {c: {y for y, d in rows if d == c} for c in codes}
    got = {r["member_code"]: (r["n_missing"], r["never"]) for r in groups.coverage_report(df, members, "code", ["year"]).collect()}
    assert got == {c: (30 - len(seen[c]), not seen[c]) for c in codes}
    one = groups.coverage_summary(df, members, "code", ["year"], k=3).first()
    assert one["n_combos"] == one["n_incomplete"] == 30 and one["never"] == [7, 130]
    gaps = sorted(((30 - len(seen[c]), c) for c in codes if seen[c] and len(seen[c]) < 30), reverse=True)
    assert [tuple(w) for w in one["worst"]] == gaps[:3]


def test_manifest_as_a_document(spark, tmp_path):
    view = spark.createDataFrame([(2020, "A", "S", 1.0), (2021, "B", None, 2.0), (2021, None, "S", 4.0)], "year int, donor_name string, sector_name string, value_usd double")
    saved = release.snapshot_release(view, "r1", ["year"], "value_usd")
    saved = saved.withColumn("total", F.when(F.col("key") == "B", float("inf")).when(F.col("key") == "max", float("nan")).otherwise(F.col("total")))
    io.write_document(io.manifest_document(saved, "flows"), str(tmp_path / "m"))
    text = json.loads(next(Path(tmp_path / "m").glob("*.txt")).read_text())
    assert text == {
        "dataset": "flows",
        "releases": {
            "r1": {
                "row_count": 3, "year_range": [2020, 2021],
                "aggregates": {"by_donor": {"A": 1.0, "B": None}, "by_donor_sector": {"A|S": 1.0}, "by_sector": {"S": 5.0}, "by_year": {"2020": 1.0, "2021": 6.0}},
                "distribution": {"min": 1.0, "max": None, "median": 2.0, "p25": 1.5, "p75": 3.0},
                "presence": {"donor": ["A", "B"], "sector": ["S"], "year": ["2020", "2021"]},
            }
        },
    }
    again = io.manifest_document(release.snapshot_release(view.limit(1), "r1", ["year"], "value_usd").unionByName(saved.withColumn("release", F.lit("r2"))), "flows")
    merged = io.merge_documents(io.read_document(spark, str(tmp_path / "m")), again).select("document.releases").first()[0]
    assert set(merged) == {"r1", "r2"} and merged["r1"]["row_count"] == 1 and merged["r2"]["row_count"] == 3
    (tmp_path / "bad").write_text("{not json")
    with pytest.raises(Exception, match="(?i)malformed|json"):
        io.read_document(spark, str(tmp_path / "bad")).collect()


def test_malformed_rows_of_a_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("year,donor_name,value\n2020,A,1.5\n2021,B,\nlate,C,2\n2022,D,x,y\n")
    read = lambda how: io.read_csv_input(spark, str(tmp_path / "c.csv"), "year int, donor_name string, value double", how)
    with pytest.raises(Exception, match="(?i)malformed"):
        read("error").collect()
    assert sorted(r["donor_name"] for r in read("drop").collect()) == ["A", "B"]
    kept = {r["donor_name"]: r[io.MALFORMED] for r in read("keep").collect()}
    assert kept["A"] is None and kept["B"] is None and kept["C"] == "late,C,2" and kept["D"] == "2022,D,x,y"
    with pytest.raises(ValueError):
        read("other")
