"""Facts of a release, narrowing quantiles, and whole reports."""

import math
import random
from pathlib import Path

import numpy as np
import pytest

from flowjobs.plans import facts, release
from flowjobs.sources import io

VIEW = "year int, donor_name string, sector_name string, value_usd double"


def view(spark, rows):
    return spark.createDataFrame(rows, VIEW)


@pytest.mark.parametrize("steps", [2, 3, facts.STEPS])
def test_quantiles_by_narrowing(spark, monkeypatch, steps):
    monkeypatch.setattr(facts, "STEPS", steps)
    rnd = random.Random(steps)
    cases = [
        [rnd.gauss(0, 1) for _ in range(500)],
        [rnd.choice([1.0, 1.0000001, 1.00000011, -3.0, 0.0, 1e-300, -1e300]) for _ in range(300)],
        [1e9 + k for k in range(200)],
        [5.0],
        [0.0, -0.0, 0.0],
    ]
    at = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
    for values in cases if steps == facts.STEPS else cases[:2]:
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
        got = release.exact_quantiles(df, "v", at).first()
        assert np.allclose(list(got), np.quantile(values, at), rtol=1e-12)
    none = spark.createDataFrame([(None,)], "v double")
    assert list(release.exact_quantiles(none, "v", (0.5,)).first()) == [None]
    assert tuple(release.distribution(none, "v").first()) == (None,) * 5


def test_infinite_values_have_bins_of_their_own(spark):
    df = spark.createDataFrame([(v,) for v in (math.inf, -math.inf, 1.0, 2.0, 3.0)], "v double")
    assert list(release.exact_quantiles(df, "v", (0.0, 0.5, 1.0)).first()) == [-math.inf, 2.0, math.inf]


def test_no_value_is_shuffled(spark):
    df = spark.range(1000).selectExpr("cast(id as double) as v")
    plan = facts.count_bins(df, "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.index("Exchange") < plan.rindex("partial_min") and "Sort" not in plan and "rangepartitioning" not in plan


def test_facts_hold_what_gates_need(spark):
    rows = [(2000, "A", "S", 1.0), (2000, "A", "S", 1.0), (2001, None, "T", 2.0), (2001, "B", None, None), (None, None, None, 9.0)]
    f = facts.gather(view(spark, rows), "value_usd", ["year", "donor_name", "sector_name", "absent"])
    assert f.whole() == {"n": 5, "min": 1.0, "max": 9.0, "first_year": 2000, "last_year": 2001}
    assert f.null_names() == {"donor_name": (2, [2001]), "sector_name": (2, [2001])}
    assert sorted((r["donor_name"], r["year"], r["value"]) for r in f.donor_years.collect()) == [("A", 2000, 2.0), ("B", 2001, 0.0)]
    assert f.rows.where("dimension = 'hash'").count() == 1 and f.largest == {"value_usd": 9.0}
    assert {r["dimension"] for r in f.aggregates.collect()} == {"donor", "year", "sector", "donor_sector"}
    empty = facts.gather(view(spark, []), "value_usd", ["year"])
    assert empty.whole()["n"] == 0 and empty.quantiles((0.5,)) == [None]


def test_keys_are_compared_in_full(spark):
    # (null, 'a') and ('a', null) have one hash.
    df = spark.createDataFrame([(None, "a"), ("a", None), ("b", "b"), ("b", "b"), (None, None), (None, None)], "x string, y string")
    assert df.select(facts.key_hash(df, ["x", "y"])).distinct().count() < 4
    assert sorted((str(r["x"]), r["n"]) for r in release.duplicate_keys(df, ["x", "y", "absent"]).collect()) == [("None", 2), ("b", 2)]


def report(frame):
    return sorted((r["dataset"], r["check"], r["passed"]) for r in frame.collect())


def test_all_datasets_in_one_report(spark, tmp_path):
    years = lambda last, factor=1.0: [(y, d, "S", factor * (100.0 + y - 2018)) for y in range(2018, last + 1) for d in ("A", "B")]
    schema = view(spark, []).schema

    def run(name, rows, topics):
        view(spark, rows).write.parquet(f"{tmp_path}/{name}/good")
        (tmp_path / name / "broken").mkdir()
        (tmp_path / name / "broken" / "part-0.parquet").write_bytes(b"no parquet")
        spark.createDataFrame(topics, "year int, donor_name string, purpose_code int, value double").write.parquet(f"{tmp_path}/{name}/topics")
        made = [release.Dataset(n, f"{tmp_path}/{name}/{n}", schema, ["year", "donor_name"], "value_usd", ["A", "Z"]) for n in ("broken", "good", "absent")]
        sets = [release.Topics("topics", f"{tmp_path}/{name}/topics", {"health": [1, 2], "rest": None}, critical=["A"])]
        return release.validate_all(spark, made, name, f"{tmp_path}/m", sets)

    gates, warnings = run("r1", years(2022), [(2022, "A", 1, 10.0), (2022, "B", 9, 10.0)])
    assert [(r["dataset"], r["check"]) for r in warnings.collect()] == [("topics", "baseline")]
    got = report(gates)
    assert ("absent", "readable", False) in got and ("broken", "readable", False) in got and ("good", "readable", True) in got
    assert [x for x in got if x[0] == "good" and not x[2]] == [("good", "critical_dimensions", False)]
    gates, warnings = run("r2", years(2021, 2.0), [(2022, "B", 1, 10.0), (2022, "N", 2, 1.0)])
    failed = {(r["dataset"], r["check"]): r["errors"] for r in gates.collect() if not r["passed"]}
    assert failed["good", "critical_dimensions"] == "latest year fell to 2021; missing donors: Z"
    found = {(r["dataset"], r["check"], r["entity"]) for r in warnings.collect()}
    assert {("good", "release_drift", "A"), ("good", "row_count", None), ("topics", "topic_drift", "A"), ("topics", "missing_critical", "A"), ("topics", "new_entities", None)} <= found
    # The release before stays, and a release that is validated again is compared with it once more.
    assert sorted(r[0] for r in io.load_manifest(spark, f"{tmp_path}/m/good").select("release").distinct().collect()) == ["r1", "r2"]
    assert not (tmp_path / "m" / "absent").exists() and not (tmp_path / "m" / "broken").exists()


def test_warnings_read_facts_alone(spark, sf_dir):
    import __spark_entry__ as entry

    df = entry.queries()["v20_validate_dataset_warnings"](spark, sf_dir)
    assert "lineitem" not in df._jdf.queryExecution().executedPlan().toString()


def test_clean_deletes_what_was_named(spark):
    df = io.stored(spark.range(3), "numbers")
    folder = Path(df.inputFiles()[0].removeprefix("file:")).parents[1]
    assert folder.exists() and df.count() == 3
    io.clean(spark)
    assert not folder.exists()
