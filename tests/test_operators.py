"""Literal frames, one rule each."""

import pytest
from pyspark.sql import functions as F

from flowjobs.functions import names as N
from flowjobs.functions import scalars as S
from flowjobs.operators import classify, currency, filters, groups, impute, joins, reshape, shares
from flowjobs.sources import io


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_sum_of_nulls_is_zero_and_null_keys_are_keys(spark):
    df = spark.createDataFrame([(None, None), (None, 2.0), (1, None)], "k int, value double")
    assert rows(groups.sum_by(df, ["k"]), "k") == [(None, 2.0), (1, 0.0)]


def test_one_row_feeds_several_groups(spark):
    df = spark.createDataFrame([(2020, 1, 10), (2020, 2, 5), (2020, 9, 1)], "year int, donor_code int, value long")
    out = groups.donor_group_totals(df, {"A": [1, 2], "B": [2]}, ["year"])
    assert rows(out, "donor_name") == [(2020, "A", 15), (2020, "B", 5)]


def test_region_named_like_a_continent_counts_once(spark):
    df = spark.createDataFrame([(1, "Africa", None, 4), (2, "North Africa", "Low", 3), (3, None, None, 1)], "recipient_code int, region string, income_group string, value long")
    labels = groups.recipient_labels("All", {}, {"North Africa": "Africa", "East": "Asia"})
    assert dict(rows(groups.recipient_group_totals(df, labels, []))) == {"All": 8, "Africa": 7, "North Africa": 3, "Low": 3}


def test_group_members_add_up_to_the_group(spark):
    df = spark.createDataFrame([(1, "x", 1, "r", 2.5), (2, "y", 1, "r", 4.0)], "donor_code int, donor_name string, recipient_code int, recipient_name string, value double")
    out = {(d, r): v for d, r, v in rows(groups.with_all_totals(df, groups.donor_labels({"G": [1, 2]}), groups.labels_of(F.col("recipient_code"), {"R": [1]}), []))}
    assert out["G", "R"] == out["x", "R"] + out["y", "R"] == out["G", "r"] == 6.5


def test_bloc_leaves_out_routed_rows_only(spark):
    s = "donor_code int, channel_code int, value long"
    own = spark.createDataFrame([(1, 5, 10), (9, 5, 99)], s)
    imputed = spark.createDataFrame([(1, 5, 3), (1, 6, 4), (1, None, 5)], s)
    assert rows(groups.bloc_total(own, imputed, [1], [5], [], "Bloc")) == [(19, "Bloc")]


def test_scaled_institutions_count_once(spark):
    df = spark.createDataFrame([(2020, 1, "A", 10.0), (2020, 7, "Inst", 100.0), (2021, 7, "Inst", 50.0)], "year int, donor_code int, donor_name string, value double")
    weights = spark.createDataFrame([(2020, 0.2)], "year int, weight double")
    scaled = groups.scale_institutions(df, weights, [7])
    out = groups.all_bilateral_total(scaled, [1], "Inst", ["year"], "All")
    assert rows(out, "year", "donor_name") == [(2020, "A", 10.0), (2020, "All", 30.0), (2021, "All", 50.0)]


def test_conversion_uses_own_rates_before_sums(spark):
    df = spark.createDataFrame([(1, 2020, 10.0), (2, 2020, 10.0)], "donor_code int, year int, value double")
    rates = spark.createDataFrame([(1, 2020, 2.0, 1.0, 1.0), (2, 2020, 3.0, 1.0, 1.0)], "donor_code int, year int, rate_eur_current double, rate_eur_constant double, rate_usd_constant double")
    wide = currency.convert_currencies(df, rates, currencies=["usd", "eur"])
    assert groups.sum_by(wide, [], "value_eur_current", "value_usd_current").first() == (50.0, 20.0)


def test_widen_sums_duplicates_and_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, "usd", "current", 1.00004), (None, "usd", "current", 2.0), ("a", "eur", "constant", 3.0)], "k string, currency string, price string, value double")
    out = {r["k"]: r for r in currency.widen_currency_price(df, ["k"]).collect()}
    assert out[None]["value_usd_current"] == 3.0 and out["a"]["value_usd_current"] is None and out["a"]["value_eur_constant"] == 3.0


def test_mode_takes_smallest_on_a_tie_and_ignores_null(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, None), (1, None), (2, None)], "k int, a string")
    assert rows(classify.modal_classification(df, ["k"], ["a"]), "k") == [(1, "a"), (2, None)]
    assert rows(classify.ambiguous_keys(df, ["k"], ["a"])) == [(1, 2)]


def test_classification_gap_takes_last_row_even_if_null(spark):
    df = spark.createDataFrame([(1, 2022), (2, 2022), (3, 2022)], "recipient_code int, year int")
    dim = spark.createDataFrame([(1, 2020, "old"), (1, 2021, None), (2, 2022, "now")], "recipient_code int, year int, region string")
    out = classify.add_recipient_classifications(df, dim, {"region": "?"}, ["region"])
    assert rows(out, "recipient_code") == [(1, 2022, "?"), (2, 2022, "now"), (3, 2022, "?")]


def test_many_to_one_join_refuses_repeated_keys(spark):
    df = spark.createDataFrame([(1,), (None,)], "k int")
    dim = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    assert rows(joins.many_to_one_join(df, dim, ["k"]), "k") == [(None, "n"), (1, "a")]
    with pytest.raises(ValueError):
        joins.many_to_one_join(df, dim.union(dim), ["k"])


def test_code_duplicates(spark):
    df = spark.createDataFrame([(2020, "x", 2, 5), (2020, "x", 1, 5), (2021, "x", 1, 5), (2021, "x", 2, 6)], "year int, name string, code int, value int")
    kept, conflicts = joins.resolve_code_duplicates(df, ["year", "name"], "code", "value")
    assert rows(kept, "year") == [(2020, "x", 1, 5), (2021, "x", 1, 5)]
    assert rows(conflicts) == [(2021, "x", 2, 2)]


def test_shares_with_null_keys_and_zero_totals(spark):
    df = spark.createDataFrame([(None, "a", 1.0), (None, "ref", 3.0), ("k", "a", 2.0), ("z", "ref", 0.0)], "g string, d string, value double")
    out = {(g, d): s for g, d, _, s in rows(shares.share_of_reference_total(df, "d", "ref", ["g"], "s"))}
    assert out == {(None, "a"): 0.333333, (None, "ref"): 1.0, ("k", "a"): None, ("z", "ref"): None}
    out = {(g, d): s for g, d, _, s in rows(shares.share_of_group_total(df, ["g"], "s"))}
    assert out[None, "a"] == 0.25 and out["z", "ref"] is None


def test_pct_change_is_row_to_row(spark):
    df = spark.createDataFrame([("a", 2019, 100.0), ("a", 2022, 150.0)], "d string, year int, value double")
    assert [r[-1] for r in rows(shares.pct_change(df, ["d"]), "year")] == [None, 0.5]


def test_fill_missing_never_invents_a_series(spark):
    df = spark.createDataFrame([(2020, "a", 1), (2022, "a", 2), (2021, None, 3)], "year int, s string, value int")
    out = rows(reshape.fill_missing(df, (2020, 2022), ["s"], {"value": 0}), "s", "year")
    assert out == [(2020, None, 0), (2021, None, 3), (2022, None, 0), (2020, "a", 1), (2021, "a", 0), (2022, "a", 2)]


def test_splice_has_no_year_twice(spark):
    df = spark.createDataFrame([(y, m, 1) for y in (2017, 2018) for m in ("net", "ge")], "year int, m string, value int")
    assert rows(reshape.splice(df, "m", "net", "ge", 2018), "year") == [(2017, "net", 1), (2018, "ge", 1)]


def test_names(spark):
    df = spark.createDataFrame([("Africa, regional",), ("Africa regional",), ("Africa unspecified",), ("Africa, unspecified",), ("Regional and Unspecified",)], "n string")
    assert [r[0] for r in df.select(N.normalize_unspecified(F.col("n"))).collect()] == ["Africa, unspecified"] * 4 + ["Regional and Unspecified"]
    names = spark.createDataFrame([("Côte d'Ivoire",), ("São  Tomé",), (None,), ("Office & ﬁles",)], "n string")
    assert {r["n"]: r["s"] for r in N.add_slug(names, "n", "s").collect()} == {"Côte d'Ivoire": "cote-d-ivoire", "São  Tomé": "sao-tome", None: None, "Office & ﬁles": "office-files"}
    with pytest.raises(ValueError):
        same = spark.createDataFrame([("A b",), ("a-B",)], "n string")
        N.check_slugs(N.add_slug(same, "n", "s"), "n", "s")


def test_last_group_wins(spark):
    out = N.invert_groups(N.groups_table(spark, {"a": [1, 2], "b": [2, 3]}))
    assert dict(rows(out)) == {1: "a", 2: "b", 3: "b"}


def test_scalars(spark):
    df = spark.createDataFrame([(2.5, 1234.5, "a|b|c"), (float("nan"), 12.34, "x")], "v double, m double, k string")
    a, b = S.split_key(F.col("k"))
    got = rows(df.select(S.rounded(F.col("v"), 0, half_even=True), io.finite(F.col("v")), S.format_amount(F.col("m")), a, b))
    assert got[0] == (2.0, 2.5, "1.23 billion", "a", "b|c") or got[0] == (2.0, 2.5, "1.24 billion", "a", "b|c")
    assert got[1][1:] == (None, "12.3 million", "x", None)
    wide = spark.createDataFrame([(3_000_000_000, 5)], "a bigint, b bigint")
    assert dict(S.narrow_integers(wide, ["a", "b"]).dtypes) == {"a": "bigint", "b": "int"}
    merged = spark.range(1).select(S.merge_numbers(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))).alias("m"))
    assert merged.first()["m"] == {"a": 1, "b": 3}


def test_filters(spark):
    df = spark.createDataFrame([(1, 2, 5.0), (1, None, 0.0), (3, 2, None)], "a int, b int, v double")
    assert filters.exclude_rows(df, F.col("a") == 1, F.col("b") == 2).count() == 2
    assert filters.drop_null_or_zero(df, "v").count() == 1
    assert filters.latest_year_rows(df.limit(0), "a").count() == 0
    with pytest.raises(ValueError):
        filters.assert_mapped(df, "a", [1])


def test_imputed_money_is_kept(spark):
    spend = spark.createDataFrame([(5, 2019, 1, 30.0), (5, 2020, 1, 10.0), (5, 2020, 2, 60.0)], "channel_code int, year int, purpose_code int, value double")
    sh = impute.channel_spending_shares(spend, by=["purpose_code"])
    assert {(y, p): s for _, y, p, s in rows(sh)} == {(2019, 1): 1.0, (2020, 1): 0.4, (2020, 2): 0.6}
    given = spark.createDataFrame([("d", 5, 2020, 100.0)], "donor_name string, channel_code int, year int, value double")
    assert rows(impute.imputed_multilateral(given, sh, ["year", "donor_name", "purpose_code"]), "purpose_code") == [(2020, "d", 1, 40.0), (2020, "d", 2, 60.0)]
    with pytest.raises(ValueError):
        impute.purpose_group_totals(spend, "planet", {}, ["year"])


def test_partitioned_write_and_pruned_read(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "donor_slug string, recipient_slug string, v int")
    io.write_partitioned(df, str(tmp_path / "p"), ["donor_slug", "recipient_slug"])
    got = io.read_partitions(spark, str(tmp_path / "p"), ["a", None], ["x", "nope"])
    assert [r["v"] for r in got.collect()] == [1]
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("], ")[0]
    assert "donor_slug" in filters and "recipient_slug" in filters
    with pytest.raises(ValueError):
        io.write_partitioned(df, str(tmp_path / "q"), ["absent"])
    io.write_single_parquet(df, str(tmp_path / "s"))
    assert io.read_flows(spark, str(tmp_path / "s"), ["v"], isin={"donor_slug": ["b"]}).collect() == [(3,)]
    io.write_csv_report(df, str(tmp_path / "c"))
    assert io.read_csv_input(spark, str(tmp_path / "c"), "donor_slug string, recipient_slug string, v int").count() == 3
    with pytest.raises(ValueError):
        io.read_flows(spark, str(tmp_path / "s"), ["absent"])


def test_options(spark):
    df = spark.createDataFrame([("b",), ("a",), ("z",), (None,)], "d string")
    assert rows(io.view_options(df, ["d"], {"d": ["z"]}), "position") == [("d", 0, "z"), ("d", 1, "a"), ("d", 2, "b")]
    assert io.options_json(io.view_options(df, ["d"])).first()[0] == '{"d":["a","b","z"]}'


def test_python_sees_each_name_once(spark):
    df = spark.range(1000).selectExpr("id", "concat('Côte ', id % 3) as name").unionAll(spark.createDataFrame([(5000, None)], "id long, name string"))
    out = N.add_slug(df, "name", "slug")
    assert {(r["name"], r["slug"]) for r in out.collect()} == {("Côte 0", "cote-0"), ("Côte 1", "cote-1"), ("Côte 2", "cote-2"), (None, None)} and out.count() == 1001
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") > plan.index("ArrowEvalPython")  # below it: names are distinct before Python sees them


def test_labels_come_after_the_first_sum(spark):
    df = spark.createDataFrame([(2000, c, "r", "x", 1) for c in range(6)], "year int, recipient_code int, region string, income_group string, value int")
    labels = groups.recipient_labels("All", {"Two": [1, 2]}, {"r": "R"})
    out = groups.recipient_group_totals(df, labels, ["year"])
    assert {(r["recipient_name"], r["value"]) for r in out.collect()} == {("All", 6), ("r", 6), ("R", 6), ("x", 6), ("Two", 2)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and plan.rindex("Aggregate [") > plan.index("Generate")
