"""Whole views: tags, blocs, weighted memberships."""

import dataclasses
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from flowjobs import registry, tables
from flowjobs.operators import groups
from flowjobs.plans import views

FLOW = "year int, donor_code int, donor_name string, recipient_code int, channel_code int, purpose_code int, value decimal(18,4)"


def test_tags_choose_what_counts_where(spark):
    d = Decimal
    bilateral = spark.createDataFrame([(2000, 1, "A", 9, 1, 1, d(10)), (2000, 1, "A", 9, 1, 2, d(5)), (2000, 1, "A", 9, 1, 2, d(-5)), (2000, 5, "B", 9, 1, 1, d(7))], FLOW)
    imputed = spark.createDataFrame([
        (2000, 1, None, 9, 50, 1, d(3)), (2000, 1, None, 9, 60, 1, d(4)),  # one part is routed
        (2000, 1, None, 8, 50, 1, d(6)),  # all of it is
        (2000, 1, None, 7, 50, 1, d(6)), (2000, 1, None, 7, 60, 1, d(-6)),  # adds up to nothing, the bloc's part does not
        (2000, 2, None, 9, 60, 1, d(8)),  # a member that the bilateral side lacks
        (2000, 5, None, 9, 50, 1, d(1)), (2000, 6, None, 9, 60, 1, d(1)),  # outside the bloc; unknown and outside
    ], FLOW)
    names = spark.createDataFrame([(1, "one"), (2, "two")], "code int, name string")
    got = views.tagged_sectors(bilateral, imputed, names, views.Bloc("Bloc", (1, 2), (3,), (50,)))
    rows = {(r["indicator_name"][0], r["donor_code"], r["recipient_code"], r["sub_sector_name"], r["in_main"], r["in_bloc"]): float(r["value"]) for r in got.collect()}
    assert rows == {
        ("B", 1, 9, "one", True, True): 10, ("B", 5, 9, "one", True, False): 7,
        ("I", 1, 9, "one", True, False): 7, ("I", 1, 9, "one", False, True): 4,
        ("I", 1, 8, "one", True, False): 6, ("I", 1, 7, "one", False, True): -6,
        ("I", 2, 9, "one", False, True): 8, ("I", 5, 9, "one", True, False): 1,
    }


def test_the_bloc_is_what_it_is_alone(spark, sf_dir):
    import __spark_entry__ as entry

    f = tables.flows(spark, sf_dir)
    view = entry.queries()["vw4_sectors_with_bloc"](spark, sf_dir)
    got = view.where("donor_name = 'Bloc' and recipient_name = 'All recipients'").groupBy("year").agg(F.sum("value_usd_current").alias("v"))
    a, r = (f.where(F.col("indicator_name") == i) for i in "AR")
    alone = groups.bloc_total(a.where(F.col("donor_code").isin(*registry.MEMBERS, *registry.INSTITUTION)).withColumn("donor_code", F.lit(1)), r, registry.MEMBERS, (2, 3), ["year"], "Bloc")
    institutions = groups.sum_by(r.where(F.col("donor_code").isin(*registry.INSTITUTION)), ["year"])
    want = {x["year"]: float(x["value"]) for x in groups.sum_by(alone.select("year", "value").unionByName(institutions), ["year"]).collect()}
    assert {x["year"] for x in got.collect()} == set(want)
    assert all(abs(x["v"] / 100 - want[x["year"]]) < 1 for x in got.collect())


def test_a_bloc_is_no_plain_group(spark):
    with pytest.raises(ValueError, match="plain donor group"):
        views.whole_sectors_view(None, None, None, None, None, None, dataclasses.replace(registry.settings(), donor_groups={"Bloc": (1,)}), views.Bloc("Bloc", (1,), ()), {})


def test_members_and_institutions_add_up_once(spark, sf_dir):
    import __spark_entry__ as entry

    view = entry.queries()["vw2_recipients_weighted"](spark, sf_dir).where("recipient_name = 'All recipients'")
    totals = {(r["year"], r["indicator_name"], r["donor_name"]): r["value_usd_current"] for r in view.collect()}
    inside = {f"NATION_{k}" for k in registry.MEMBERS}
    for (year, indicator, donor), value in totals.items():
        if donor not in ("All donors", "Bloc"):
            continue
        factor = (year - 1990) / 10 if year < 2000 else 1
        one = lambda n: totals.get((year, indicator, n), 0)  # noqa: B023, E731
        own = sum(one(n) for n in (inside if donor == "Bloc" else {f"NATION_{k}" for k in range(24)}))
        assert abs(value - own - factor * one("NATION_24")) < 100, (year, indicator, donor)
