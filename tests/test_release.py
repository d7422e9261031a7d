"""Gates and detectors: each one fires, and is quiet when it should be."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowjobs.plans import query, release, report
from flowjobs.sources import io

KEYS = ["year", "donor_name"]


def series(spark, donor, values, start=2019):
    return spark.createDataFrame([(donor, start + i, v) for i, v in enumerate(values)], "donor_name string, year int, value_usd double")


def test_yoy_spike_fires_and_steady_growth_does_not(spark):
    spike = series(spark, "A", [100.0, 105.0, 110.0, 114.0, 175.0])
    assert [r["level"] for r in release.detect_yoy_anomalies(spike, 2023, "value_usd").collect()] == ["high"]
    steady = series(spark, "A", [100.0, 105.0, 111.0, 116.0, 122.0])
    assert release.detect_yoy_anomalies(steady, 2023, "value_usd").count() == 0


def test_yoy_needs_history_and_no_zero_in_it(spark):
    assert release.yoy_scores(series(spark, "A", [100.0, 110.0, 300.0]), 2021, "value_usd").count() == 0
    assert release.yoy_scores(series(spark, "A", [100.0, 0.0, 110.0, 120.0, 300.0]), 2023, "value_usd").count() == 0
    gap = series(spark, "A", [100.0, 105.0, 111.0, 116.0]).union(series(spark, "A", [300.0], 2024))
    assert release.yoy_scores(gap, 2024, "value_usd").count() == 0


def test_snapshot_and_drift(spark):
    was = spark.createDataFrame([("A", 2020, "S", 100.0), ("B", 2020, "S", 100.0), ("C", 2020, None, 10.0)], "donor_name string, year int, sector_name string, value_usd double")
    now = spark.createDataFrame([("A", 2020, "S", 180.0), ("B", 2020, "S", 20.0), ("N", 2020, "T", 5.0)], "donor_name string, year int, sector_name string, value_usd double")
    a, b = (release.release_aggregates(x, "value_usd") for x in (now, was))
    assert {r["entity"]: r["level"] for r in release.detect_release_drift(a, b).collect()} == {"A": "high", "B": "high", "C": "high"}
    # The sector is level, the donors within it are not.
    assert {r["entity"]: r["level"] for r in release.detect_sector_drift(a, b).collect()} == {"A|S": "high", "B|S": "high"}
    assert {(r["entity"], r["level"]) for r in release.detect_new_or_removed_entities(a, b).collect()} == {("N", "info"), ("T", "info"), ("C", "medium")}
    assert "indicator" not in {r["dimension"] for r in b.collect()}
    assert {(r["dimension"], r["key"]) for r in b.where("dimension = 'sector'").collect()} == {("sector", "S")}


def test_snapshot_reload(spark, tmp_path):
    df = series(spark, "A", [100.0, 200.0])
    for name in ("r1", "r2"):
        io.save_manifest(release.snapshot_release(df, name, KEYS, "value_usd"), str(tmp_path / "m"))
    got = io.load_manifest(spark, str(tmp_path / "m"), "r1")
    assert got.where("dimension = 'donor'").first()["total"] == 300.0
    assert got.where("dimension = 'stats' and key = 'median'").first()["total"] == 150.0
    with pytest.raises(ValueError):
        release.snapshot_release(df, "r", ["absent"], "value_usd")


def test_variation_and_distribution(spark):
    v = {r["donor"]: r for r in release.historical_variation(series(spark, "A", [100.0, 110.0, 121.0, 133.1]), "value_usd").collect()}
    assert abs(v["A"]["mean"] - 0.1) < 1e-9 and abs(v[None]["std"]) < 1e-9
    one = release.historical_variation(series(spark, "A", [100.0, 110.0]), "value_usd").where("donor = 'A'").first()
    assert one["std"] == 0.0
    d = release.distribution(series(spark, "A", [10.0, 20.0, 30.0, 40.0, 50.0]), "value_usd").first()
    assert tuple(d) == (10.0, 50.0, 30.0, 20.0, 40.0)
    assert tuple(release.distribution(series(spark, "A", [1.0]).limit(0), "value_usd").first()) == (None,) * 5


def passed(df):
    return df.first()["passed"]


def test_gates(spark):
    df = series(spark, "A", [1.0, 2.0])
    assert passed(release.check_not_empty(df)) and not passed(release.check_not_empty(df.limit(0)))
    assert passed(release.check_no_duplicate_keys(df, KEYS)) and not passed(release.check_no_duplicate_keys(df.union(df), [*KEYS, "absent"]))
    none = df.withColumn("value_eur", F.lit(None).cast("double"))
    assert passed(release.check_value_columns_populated(df)) and "value_eur" in release.check_value_columns_populated(none).first()["errors"]
    assert passed(release.check_value_bounds(df.withColumn("value_usd", F.lit(-1e20)))) and not passed(release.check_value_bounds(df.withColumn("value_usd", F.lit(1e20))))
    bad = df.withColumn("donor_name", F.when(F.col("year") == 2020, None).otherwise(F.col("donor_name")))
    assert "2020" in release.check_names_populated(bad).first()["errors"] and passed(release.check_names_populated(df))
    assert passed(release.check_critical_dimensions(df, ["A"], 2020)) and passed(release.check_critical_dimensions(df, [], None))
    assert "missing donors: Z" in release.check_critical_dimensions(df, ["A", "Z"], 2021).first()["errors"]
    expected = T.StructType([T.StructField("year", T.StringType()), T.StructField("donor_name", T.StringType()), T.StructField("x", T.LongType())])
    errors = release.check_schema(df, expected).first()["errors"]
    assert "missing column x" in errors and "year is int" in errors


def test_missing_data_and_coverage(spark):
    df = series(spark, "A", [1.0, 2.0]).union(series(spark, "B", [1.0])).union(series(spark, "Z", [1.0, 0.0]))
    assert {r["entity"] for r in release.detect_missing_expected_data(df, 2020, "value_usd").collect()} == {"B", "Z"}
    was = release.release_aggregates(df.withColumn("indicator_name", F.lit("I")), "value_usd")
    zero = release.release_aggregates(df.withColumns({"indicator_name": F.lit("I"), "value_usd": F.lit(0.0)}), "value_usd")
    assert [r["level"] for r in release.detect_indicator_coverage_gaps(zero, was).collect()] == ["medium"]
    one = spark.range(1)
    assert release.detect_row_count_change(1050, 1000, one).count() == 0
    assert release.detect_row_count_change(600, 1000, one).first()["level"] == "high"
    assert release.detect_row_count_change(5, 0, one).count() == 0


def test_topics(spark):
    t = lambda *r: spark.createDataFrame(list(r), "donor string, total double")
    was = t(("a", 100.0), ("b", 100.0), ("c", 100.0), ("z", 0.0))
    assert {r["entity"] for r in release.detect_topic_drift(t(("a", 200.0), ("b", 101.0), ("c", 99.0)), was).collect()} == {"a"}
    assert release.detect_topic_drift(t(("a", 110.0)), t(("a", 100.0))).count() == 0
    assert release.detect_topic_drift(t(("a", 1.0)), was.limit(0)).count() == 0
    assert [r["entity"] for r in release.detect_missing_critical(t(("a", 0.0)), was, ["a", "q"]).collect()] == ["a"]
    new = t(*[(f"n{i}", 1.0) for i in range(7)])
    assert release.detect_new_entities_summary(new, was).first()["message"] == "new donors: n0, n1, n2, n3, n4 and 2 others"


def test_previous_release_and_report(spark, tmp_path):
    r = spark.createDataFrame([("b", "2024-01-01"), ("a", "2025-01-01"), ("c", None)], "release string, computed_at string")
    assert release.previous_release(r, "c").first()["release"] == "a"
    assert release.previous_release(r, "c", by_name=True).first()["release"] == "b"
    df = series(spark, "A", [1.0, 2.0])
    df.write.parquet(str(tmp_path / "v"))
    gates, warnings = release.validate_path(spark, str(tmp_path / "v"), "d", df.schema, KEYS, "value_usd")
    assert release.report_status(gates).first() == (0, False) and warnings.count() == 0
    gates, _ = release.validate_path(spark, str(tmp_path / "gone"), "d", df.schema, KEYS, "value_usd")
    assert release.report_status(gates).first() == (1, True)


def test_drill_down_and_units(spark):
    view = spark.createDataFrame([(2020, "A", "I", 5_000_000), (2020, "A", "J", 1)], "year int, donor_name string, indicator_name string, value_usd_current long")
    assert [r["value"] for r in query.drill_down(view, "A", ["I"], "usd", "current", (2020, 2021)).collect()] == [5.0]
    assert query.drill_down(view, "A", [], "usd", "current", (2020, 2021)).count() == 0
    zero = view.withColumn("t", F.lit(0))
    assert query.unit_select(zero, "t", "value_usd_current", {"t": "t"}).first()["shown"] is None
    mix = spark.createDataFrame([(2020, "All", 10.0, None), (2020, "A", 6.0, 2.0), (2020, "B", 4.0, 1.0)], "year int, donor_name string, total double, part double")
    out = {r["donor_name"]: r["other"] for r in report.aid_mix(mix, ["part"], aggregate="All", missing="part").collect()}
    assert out == {"All": 7.0, "A": 4.0, "B": 3.0}


def test_quantiles_are_exact_without_one_task(spark):
    import numpy as np

    values = np.random.default_rng(0).normal(size=4321).round(2).tolist()
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = release.exact_quantiles(df.repartition(7), "v", (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)).first()
    assert np.allclose(list(got), np.quantile(values, (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)))
    near = release.quartiles(df, "v", accuracy=1000).first()
    assert np.allclose(list(near), np.quantile(values, (0.25, 0.5, 0.75)), atol=0.02)


def test_manifest_of_nothing_and_a_release_saved_twice(spark, tmp_path):
    path = str(tmp_path / "none")
    assert io.load_manifest(spark, path).count() == 0 and "release" in io.load_manifest(spark, path, "r1").columns
    row = lambda release_name, total: spark.createDataFrame([("donor", "a", None, total, 1, release_name)], io.MANIFEST)
    for name, total in (("r1", 1.0), ("r2", 2.0), ("r1", 3.0)):
        io.save_manifest(row(name, total), path)
    assert sorted((r["release"], r["total"]) for r in io.load_manifest(spark, path).collect()) == [("r1", 3.0), ("r2", 2.0)]


def test_gates_take_one_pass(spark):
    df = spark.createDataFrame([(2000, "A", None, 1.0), (2001, None, "S", None)], "year int, donor_name string, sector_name string, value_usd double")
    gates, _ = release.validate_dataset(df, "d", df.schema, ["year"], "value_usd", critical=["A", "B"], year=2001)
    got = {r["check"]: (r["passed"], r["errors"]) for r in gates.collect()}
    assert got == {
        "schema": (True, ""), "not_empty": (True, ""), "values_populated": (True, ""), "value_bounds": (True, ""), "no_duplicate_keys": (True, ""),
        "names_populated": (False, "donor_name: 1 null in 2001; sector_name: 1 null in 2000"), "critical_dimensions": (False, "missing donors: B"),
    }


def test_a_cluster_needs_a_shared_folder():
    import types

    fake = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(getCheckpointDir=lambda: None, master="yarn", applicationId="a"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        io.shared_dir(fake)
