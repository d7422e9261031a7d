"""Queries over the driver tables, each with its oracle SQL.

The SQL is written on its own lines of thought (a group-by and a union per group
where the library explodes labels), so that it checks the plan and not itself.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables
from .functions import names as N
from .functions import scalars as S
from .operators import classify, currency, filters, groups, impute, joins, reshape, shares
from .plans import query, release, report, views
from .sources import io

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# Settings of the queries: code lists over nations, rollups, labels.
DONORS = {"All donors": tuple(range(25)), "Northern": tuple(range(0, 12)), "Odd": tuple(range(1, 25, 2)), "Seven": (1, 3, 6, 7, 12, 19, 23)}
RECIPIENTS = {"Low": (0, 5, 10, 15), "Fragile": (4, 8, 15, 16)}
ROLLUP = {"ASIA": "Greater Asia", "MIDDLE EAST": "Greater Asia", "AFRICA": "AFRICA"}
INCOME = {"LIC": "Low income", "LMIC": "Lower middle income"}
SUB_SECTORS = {"Basic": range(1, 21), "Health": range(18, 30), "Food": range(30, 46)}
SECTORS = {"Basic": "Social", "Health": "Social", "Food": "Production"}
INSTITUTION, MEMBERS = (24,), (1, 3, 6, 7, 12, 19, 23)


def _isin(codes) -> str:
    return "(" + ", ".join(map(str, codes)) + ")"


SQL_LABELS = (
    "labels AS (" + " UNION ALL ".join(f"SELECT '{g}' AS g, n_nationkey AS code FROM nation WHERE n_nationkey IN {_isin(c)}" for g, c in DONORS.items()) + ")"
)
SQL_SUB = "CASE WHEN purpose_code BETWEEN 30 AND 45 THEN 'Food' WHEN purpose_code BETWEEN 18 AND 29 THEN 'Health' WHEN purpose_code BETWEEN 1 AND 20 THEN 'Basic' ELSE 'Unallocated/unspecified' END"
#: (recipient code, aggregate name), one row for each aggregate that a recipient feeds
SQL_RECIPIENTS = (
    "rlab AS (SELECT n_nationkey AS code, 'All recipients' AS g FROM nation"
    " UNION ALL SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Low income' WHEN 1 THEN 'Lower middle income' WHEN 2 THEN 'UMIC' END FROM nation WHERE n_nationkey % 4 < 3"
    " UNION ALL SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT IN ('AFRICA', 'Greater Asia')"
    " UNION ALL SELECT n_nationkey, CASE WHEN r_name IN ('ASIA', 'MIDDLE EAST') THEN 'Greater Asia' ELSE 'AFRICA' END FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'MIDDLE EAST', 'AFRICA')"
    + "".join(f" UNION ALL SELECT n_nationkey, '{g}' FROM nation WHERE n_nationkey IN {_isin(c)}" for g, c in RECIPIENTS.items())
    + ")"
)


def recipient_labels() -> Column:
    return groups.recipient_labels("All recipients", RECIPIENTS, ROLLUP, income_labels=INCOME)


def register(name: str, sql: str | None = None, ctes: str = "") -> Callable[[Callable], Callable]:
    """Registers fn(flows, spark, sf_dir). The SQL sees the flow tables of :mod:`tables` and ``ctes``."""

    def add(fn: Callable) -> Callable:
        _QUERIES[name] = lambda spark, sf_dir: fn(tables.flows(spark, sf_dir), spark, sf_dir)
        if sql is not None:
            more = f", {ctes}" if ctes else ""
            _SQL[name] = f"WITH {tables.FLOWS_SQL}{more}\n{sql}"
        return fn

    return add


def money(*columns: str) -> dict[str, Column]:
    return {c: F.round(F.col(c), 2).cast("double") for c in columns}


def table(spark: SparkSession, rows, schema: str) -> DataFrame:
    return N.small_table(spark, list(rows), schema)


def sub_sectors(spark: SparkSession) -> DataFrame:
    inverted = N.invert_groups(N.groups_table(spark, SUB_SECTORS))
    return inverted.select(F.col("member_code").alias("code"), F.col("group_name").alias("name"))


def sectors(spark: SparkSession) -> DataFrame:
    return table(spark, SECTORS.items(), "code string, name string")


def settings() -> views.Settings:
    return views.Settings(DONORS, recipient_labels(), cutoff=1998, factor=100)


# --- flagship -------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value by donor group and year in two currencies, with each group's share of all donors' total."""
    base = groups.sum_by(tables.flows(spark, sf_dir), ["year", "donor_code", "donor_name"])
    wide = currency.convert_currencies(base, tables.rates(spark, sf_dir))
    values = ["value_eur_current", "value_usd_current"]
    totals = groups.donor_group_totals(wide, DONORS, ["year"], values=values)
    out = shares.share_of_reference_total(totals, "donor_name", "All donors", ["year"], "share", "value_usd_current")
    return out.withColumns({**money("value_eur_current"), "units": S.to_units(F.col("value_usd_current"), 100)}).drop("value_usd_current")


_QUERIES["a00_flagship"] = flagship
_SQL["a00_flagship"] = f"""WITH {tables.FLOWS_SQL}, {SQL_LABELS}, t AS (
  SELECT year, g AS donor_name, sum(value_eur_current) AS eur, sum(value) AS usd FROM conv JOIN labels ON code = donor_code GROUP BY ALL)
SELECT t.year, t.donor_name, round(t.eur, 2)::DOUBLE AS value_eur_current, round(t.usd::DOUBLE / a.usd::DOUBLE, 6) AS share, (round(t.usd, 2)::DECIMAL(18,2) * 100)::BIGINT AS units
FROM t JOIN t a ON a.year = t.year AND a.donor_name = 'All donors'"""


# --- sources ----------------------------------------------------------------------


@register("s01_read_flows", "SELECT year(o_orderdate)::INTEGER AS year, o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY ALL")
def _(f, spark, sf):
    df = io.read_flows(spark, f"{sf}/orders.parquet", ["o_orderdate", "o_orderpriority"], isin={"o_orderpriority": ["1-URGENT", "5-LOW"]})
    return df.groupBy(F.year("o_orderdate").alias("year"), "o_orderpriority").agg(F.count("*").alias("n"))


def _by_year(f):
    return groups.sum_by(f, ["year", "donor_name"]).withColumn("value", F.round("value", 2).cast("double"))


_BY_YEAR_SQL = "SELECT year, donor_name, round(sum(value), 2)::DOUBLE AS value FROM flows GROUP BY ALL"


@register("s02_read_csv_input", _BY_YEAR_SQL)
def _(f, spark, sf):
    path = io.scratch_path(spark, "input.csv")
    _by_year(f).write.csv(path, header=True)
    return io.read_csv_input(spark, path, "year int, donor_name string, value double")


@register("s03_write_single_parquet", "SELECT year, donor_name, value, 1::BIGINT AS files FROM (" + _BY_YEAR_SQL + ")")
def _(f, spark, sf):
    path = io.scratch_path(spark, "view.parquet")
    io.write_single_parquet(_by_year(f), path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg(F.count("*").alias("files"))
    return spark.read.parquet(path).join(F.broadcast(files))


def _partitioned(f, spark):
    path = io.scratch_path(spark, "view")
    rows = groups.sum_by(f, ["year", "donor_name", "recipient_name"]).select("year", "value", F.lower("donor_name").alias("donor_slug"), F.lower("recipient_name").alias("recipient_slug"))
    io.write_partitioned(rows, path, ["donor_slug", "recipient_slug"])
    return path


@register("s04_write_partitioned", "SELECT year, lower(donor_name) AS donor_slug, lower(recipient_name) AS recipient_slug, sum(value)::DOUBLE AS value FROM flows GROUP BY ALL")
def _(f, spark, sf):
    return spark.read.parquet(_partitioned(f, spark)).withColumn("value", F.col("value").cast("double"))


@register("s05_read_partitions", "SELECT year, lower(donor_name) AS donor_slug, lower(recipient_name) AS recipient_slug, sum(value)::DOUBLE AS value FROM flows WHERE donor_name IN ('NATION_7', 'NATION_3') AND recipient_name = 'NATION_8' GROUP BY ALL")
def _(f, spark, sf):
    return io.read_partitions(spark, _partitioned(f, spark), ["nation_7", "nation_3", None, "atlantis"], ["nation_8"]).withColumn("value", F.col("value").cast("double"))


@register("s05_read_partition_pairs", "SELECT year, lower(donor_name) AS donor_slug, lower(recipient_name) AS recipient_slug, sum(value)::DOUBLE AS value FROM flows WHERE (donor_code + recipient_code) % 24 = 5 GROUP BY ALL")
def _(f, spark, sf):
    n = tables.read(spark, sf, "nation")
    a, b = (n.select(F.col("n_nationkey").alias(k), F.lower("n_name").alias(f"{x}_slug")) for k, x in (("d", "donor"), ("r", "recipient")))
    chosen = (F.when((F.col("d") + F.col("r")) % 24 == 5, "asked").otherwise("other")).alias("selection")
    # The table of selections, as a page's options would have it; pairs over two small lists of names.
    pairs = a.select(F.explode(F.sequence(F.lit(0), F.lit(24))).alias("r"), "d", "donor_slug").join(b, "r").select(chosen, "donor_slug", "recipient_slug")
    path = io.scratch_path(spark, "selections")
    pairs.write.parquet(path)
    return io.read_partition_pairs(spark, _partitioned(f, spark), spark.read.parquet(path), "asked").withColumn("value", F.col("value").cast("double"))


@register("s06_write_csv_report", "SELECT year, donor_name, value::VARCHAR AS value FROM (SELECT year::VARCHAR AS year, donor_name, round(sum(value), 0)::BIGINT AS value FROM flows GROUP BY ALL)")
def _(f, spark, sf):
    path = io.scratch_path(spark, "report.csv")
    io.write_csv_report(groups.sum_by(f, ["year", "donor_name"]).withColumn("value", F.round("value", 0).cast("long")), path)
    return spark.read.csv(path, header=True)


@register("s08_narrow_types", "SELECT year::SMALLINT AS year, donor_name, sum(value)::DECIMAL(38,4)::FLOAT AS value_usd, count(*) AS value_n FROM flows GROUP BY ALL")
def _(f, spark, sf):
    out = f.groupBy("year", "donor_name").agg(F.sum("value").alias("value_usd"), F.count("*").alias("value_n"))
    return io.narrow_types(out)


@register(
    "s09_view_options",
    """, v AS (SELECT DISTINCT 'donor_name' AS option, donor_name AS value FROM flows UNION SELECT DISTINCT 'indicator_name', indicator_name FROM flows UNION SELECT DISTINCT 'segment', segment FROM flows)
SELECT option, (row_number() OVER (PARTITION BY option ORDER BY CASE value WHEN 'R' THEN 0 WHEN 'NATION_7' THEN 0 WHEN 'NATION_3' THEN 1 ELSE 99 END, value) - 1)::INTEGER AS position, value FROM v""",
)
def _(f, spark, sf):
    return io.view_options(f, ["donor_name", "indicator_name", "segment"], {"indicator_name": ["R"], "donor_name": ["NATION_7", "NATION_3"]})


@register("s09_year_option", "SELECT min(year) AS start, max(year) AS \"end\", 1998 AS base FROM flows")
def _(f, spark, sf):
    return io.year_option(f, base_year=1998)


@register(
    "s09_options_json",
    """SELECT '{' || string_agg('"' || option || '":[' || list || ']', ',' ORDER BY option) || '}' AS options FROM (SELECT option, string_agg('"' || value || '"', ',' ORDER BY value) AS list FROM (SELECT DISTINCT 'donor_name' AS option, donor_name AS value FROM flows UNION SELECT DISTINCT 'segment', segment FROM flows) GROUP BY option)""",
)
def _(f, spark, sf):
    return io.options_json(io.view_options(f, ["segment", "donor_name"]))


@register("s10_child_index", ", d AS (SELECT DISTINCT region, recipient_name FROM flows) SELECT region, string_agg(recipient_name, ',' ORDER BY recipient_name) AS children FROM d GROUP BY region")
def _(f, spark, sf):
    return io.child_index(f, "region", "recipient_name").withColumn("children", F.array_join("children", ","))


# --- filters ----------------------------------------------------------------------


@register("p01_filter_members", f"SELECT year, sum(value)::DOUBLE AS value FROM flows WHERE donor_code IN {_isin(MEMBERS)} GROUP BY year")
def _(f, spark, sf):
    members = N.groups_table(spark, {"Seven": MEMBERS})
    return groups.sum_by(filters.filter_members(f, "donor_code", members), ["year"]).withColumn("value", F.col("value").cast("double"))


@register("p02_exclude_rows", f"SELECT donor_name, count(*) AS n FROM flows WHERE NOT (donor_code IN {_isin(MEMBERS)} AND channel_code IN (2, 5)) GROUP BY ALL")
def _(f, spark, sf):
    return filters.exclude_rows(f, F.col("donor_code").isin(*MEMBERS), F.col("channel_code").isin(2, 5)).groupBy("donor_name").agg(F.count("*").alias("n"))


@register("p03_drop_null_or_zero", "SELECT year, donor_name, sum(v)::DOUBLE AS v FROM (SELECT year, donor_name, CASE WHEN channel_code = 1 THEN 0 WHEN channel_code = 2 THEN NULL ELSE value END AS v FROM flows) WHERE v IS NOT NULL AND v <> 0 GROUP BY ALL")
def _(f, spark, sf):
    v = f.withColumn("v", F.when(F.col("channel_code") == 1, F.lit(0)).when(F.col("channel_code") == 2, None).otherwise(F.col("value")))
    return groups.sum_by(filters.drop_null_or_zero(v, "v"), ["year", "donor_name"], "v").withColumn("v", F.col("v").cast("double"))


@register("p04_latest_year_rows", "SELECT donor_name, sum(value)::DOUBLE AS value FROM flows WHERE year = (SELECT max(year) FROM flows) GROUP BY ALL")
def _(f, spark, sf):
    return groups.sum_by(filters.latest_year_rows(f), ["donor_name"]).withColumn("value", F.col("value").cast("double"))


@register("p06_flow_type", "SELECT CASE WHEN year < 1998 THEN 'Flows' ELSE 'Grant equivalents' END AS type, count(*) AS n FROM flows GROUP BY ALL")
def _(f, spark, sf):
    return f.groupBy(S.flow_type(F.col("year"), 1998).alias("type")).agg(F.count("*").alias("n"))


@register("p07_blank_for_entity", "SELECT year, donor_name, CASE WHEN donor_name = 'NATION_7' THEN NULL ELSE value::DOUBLE END AS value FROM gni")
def _(f, spark, sf):
    g = tables.gni(spark, sf)
    return g.select("year", "donor_name", S.blank_for(F.col("donor_name"), "NATION_7", F.col("value").cast("double")).alias("value"))


@register("p08_preliminary_split", "SELECT year, CASE WHEN year < 2001 THEN sum(value)::DOUBLE END AS other, CASE WHEN year = 2001 THEN sum(value)::DOUBLE END AS preliminary FROM flows GROUP BY year")
def _(f, spark, sf):
    return filters.preliminary_split(groups.sum_by(f, ["year"]).select("year", F.col("value").cast("double").alias("other")), 2001)


@register("p10_unmapped_values", "SELECT DISTINCT marker FROM flows WHERE marker NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def _(f, spark, sf):
    return filters.unmapped_values(f, "marker", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@register("p11_policy_marker_rows", f"SELECT year, CASE marker WHEN '1-URGENT' THEN 'Principal' ELSE 'Significant' END AS indicator_name, sum(value)::DOUBLE AS value FROM flows WHERE marker IN ('1-URGENT', '2-HIGH') AND donor_code IN {_isin(MEMBERS)} GROUP BY ALL")
def _(f, spark, sf):
    rows = filters.marker_rows(f, "marker", {"1-URGENT": "Principal", "2-HIGH": "Significant"}, donors=MEMBERS)
    return groups.sum_by(rows, ["year", "indicator_name"]).withColumn("value", F.col("value").cast("double"))


# --- joins ------------------------------------------------------------------------


@register("j01_lookup", f"SELECT sub, sum(value)::DOUBLE AS value FROM (SELECT {SQL_SUB} AS sub, value FROM flows) GROUP BY sub")
def _(f, spark, sf):
    named = joins.lookup(f, sub_sectors(spark), "purpose_code", "sub", "Unallocated/unspecified")
    return groups.sum_by(named, ["sub"]).withColumn("value", F.col("value").cast("double"))


@register("j02_invert_groups", f"SELECT purpose_code, {SQL_SUB} AS group_name, count(*) AS n FROM flows WHERE purpose_code BETWEEN 1 AND 45 GROUP BY ALL")
def _(f, spark, sf):
    table = N.invert_groups(N.groups_table(spark, SUB_SECTORS)).withColumnRenamed("member_code", "purpose_code")
    return f.join(table, "purpose_code").groupBy("purpose_code", "group_name").agg(F.count("*").alias("n"))


@register("j03_override_names", "SELECT DISTINCT donor_code, CASE donor_code WHEN 3 THEN 'Northland' WHEN 9 THEN 'Islands' ELSE donor_name END AS donor_name FROM flows")
def _(f, spark, sf):
    new = table(spark, [(3, "Northland"), (9, "Islands")], "code int, name string")
    return N.override_names(f.select("donor_code", "donor_name").distinct(), new, "donor_code", "donor_name")


@register("j04_many_to_one_join", "SELECT year, donor_name, g.value::DOUBLE AS gni, sum(f.value)::DOUBLE AS value FROM flows f LEFT JOIN gni g USING (year, donor_name) GROUP BY ALL")
def _(f, spark, sf):
    g = tables.gni(spark, sf).select("year", "donor_name", F.col("value").cast("double").alias("gni"))
    out = joins.many_to_one_join(groups.sum_by(f, ["year", "donor_name"]), g, ["year", "donor_name"])
    return out.withColumn("value", F.col("value").cast("double")).select("year", "donor_name", "gni", "value")


@register("j04_checked_join", f"SELECT year, donor_name, sub, sum(value)::DOUBLE AS value FROM (SELECT year, donor_name, {SQL_SUB} AS sub, value FROM flows) GROUP BY ALL")
def _(f, spark, sf):
    names = sub_sectors(spark).select(F.col("code").cast("int").alias("purpose_code"), F.col("name").alias("sub"))
    out = joins.checked_join(f.select("year", "donor_name", "purpose_code", "value"), names, ["purpose_code"], "value").withColumn("sub", F.coalesce("sub", F.lit("Unallocated/unspecified")))
    return groups.sum_by(out, ["year", "donor_name", "sub"]).withColumn("value", F.col("value").cast("double"))


@register("j04_same_total", f", x AS (SELECT f.value FROM flows f LEFT JOIN (SELECT DISTINCT purpose_code, {SQL_SUB} AS sub FROM flows) s ON s.purpose_code = f.purpose_code), a AS (SELECT count(*) AS n, sum(value) AS t FROM flows), b AS (SELECT count(*) AS n, sum(value) AS t FROM x) SELECT a.n AS rows_before, b.n AS rows_after, a.t = b.t AS same, a.t::DOUBLE AS total_before, b.t::DOUBLE AS total_after FROM a, b")
def _(f, spark, sf):
    named = joins.lookup(f, sub_sectors(spark), "purpose_code", "sub", "none")
    out = joins.same_total(f, named, "value")
    return out.select("rows_before", "rows_after", "same", F.col("total_before").cast("double").alias("total_before"), F.col("total_after").cast("double").alias("total_after"))


CLASSIFIED_SQL = """cnt AS (SELECT recipient_code, year, segment, count(*) AS n FROM flows WHERE year < 2000 GROUP BY ALL
), cls AS (SELECT recipient_code, year, CASE WHEN recipient_code IN (SELECT recipient_code FROM flows WHERE region = 'EUROPE') THEN NULL ELSE segment END AS segment FROM (SELECT *, row_number() OVER (PARTITION BY recipient_code, year ORDER BY n DESC, segment) AS k FROM cnt) WHERE k = 1
), fin AS (SELECT recipient_code, arg_max({'s': segment}, year)['s'] AS segment FROM cls GROUP BY recipient_code)"""


def _classified(f):
    # Classifications come late, and Europe has none: the gaps to fill.
    rows = f.where("year < 2000").withColumn("segment", F.when(F.col("region") == "EUROPE", None).otherwise(F.col("segment")))
    return classify.modal_classification(rows, ["recipient_code", "year"], ["segment"])


@register("a08_modal_classification", "SELECT recipient_code, year, segment FROM cls", CLASSIFIED_SQL)
def _(f, spark, sf):
    return _classified(f)


@register(
    "j05_add_classifications",
    "SELECT k.recipient_code, k.year, coalesce(CASE WHEN c.recipient_code IS NOT NULL THEN c.segment ELSE x.segment END, 'Not classified') AS segment FROM (SELECT DISTINCT recipient_code, year FROM flows) k LEFT JOIN cls c ON c.recipient_code = k.recipient_code AND c.year = k.year LEFT JOIN fin x ON x.recipient_code = k.recipient_code",
    CLASSIFIED_SQL,
)
def _(f, spark, sf):
    keys = f.select("recipient_code", "year").distinct()
    return classify.add_recipient_classifications(keys, _classified(f), {"segment": "Not classified"}, ["segment"])


@register(
    "j06_gni_denominator",
    "SELECT g.year, g.donor_name, g.value::DOUBLE AS gni FROM gni g UNION ALL SELECT year, g, sum(value)::DOUBLE FROM gni JOIN labels ON code = donor_code GROUP BY ALL",
    SQL_LABELS,
)
def _(f, spark, sf):
    every = shares.gni_with_groups(tables.gni(spark, sf), groups.donor_labels(DONORS))
    keys = every.select("year", "donor_name")
    return shares.add_gni(keys, every).withColumn("gni", F.col("gni").cast("double"))


@register("j07_combine_measures", "SELECT t.year, t.donor_name, t.v::DOUBLE AS total, a.v::DOUBLE AS a, coalesce(h.v, 0)::DOUBLE AS h FROM (SELECT year, donor_name, sum(value) AS v FROM flows GROUP BY ALL) t LEFT JOIN (SELECT year, donor_name, sum(value) AS v FROM flows WHERE purpose_code = 7 AND channel_code = 1 GROUP BY ALL) a USING (year, donor_name) LEFT JOIN (SELECT year, donor_name, sum(value) AS v FROM flows WHERE purpose_code = 9 AND channel_code = 6 GROUP BY ALL) h USING (year, donor_name)")
def _(f, spark, sf):
    part = lambda name, where: groups.sum_by(f.where(where), ["year", "donor_name"]).withColumnRenamed("value", name)
    out = joins.combine_measures(part("total", F.lit(True)), part("a", "purpose_code = 7 and channel_code = 1"), part("h", "purpose_code = 9 and channel_code = 6"), on=["year", "donor_name"], zero=["h"])
    return out.select("year", "donor_name", *[F.col(c).cast("double").alias(c) for c in ("total", "a", "h")])


@register("j08_convert_currencies", "SELECT year, donor_name, " + ", ".join(f"round(sum({v}), 2)::DOUBLE AS {v}" for v in views.VALUES) + " FROM conv GROUP BY ALL")
def _(f, spark, sf):
    wide = currency.convert_currencies(f, tables.rates(spark, sf))
    return groups.sum_by(wide, ["year", "donor_name"], *views.VALUES).withColumns(money(*views.VALUES))


@register("j09_code_duplicates", "SELECT year, segment, min(donor_code) AS donor_code, count(DISTINCT v) > 1 AS conflict FROM (SELECT year, segment, donor_code, sum(value) AS v FROM flows GROUP BY ALL) GROUP BY ALL")
def _(f, spark, sf):
    rows = groups.sum_by(f, ["year", "segment", "donor_code"])
    kept, conflicts = joins.resolve_code_duplicates(rows, ["year", "segment"], "donor_code", "value")
    flag = conflicts.select("year", "segment", F.lit(True).alias("conflict"))
    return kept.join(flag, ["year", "segment"], "left").select("year", "segment", "donor_code", F.coalesce("conflict", F.lit(False)).alias("conflict"))


@register("j10_entity_diff", "SELECT a.x AS entity, 'new' AS change FROM (SELECT DISTINCT recipient_name AS x FROM flows WHERE recipient_code > 3) a WHERE x NOT IN (SELECT recipient_name FROM flows WHERE recipient_code < 20) UNION ALL SELECT x, 'removed' FROM (SELECT DISTINCT recipient_name AS x FROM flows WHERE recipient_code < 20) WHERE x NOT IN (SELECT recipient_name FROM flows WHERE recipient_code > 3)")
def _(f, spark, sf):
    return joins.entity_diff(f.where("recipient_code > 3"), f.where("recipient_code < 20"), "recipient_name")


def _weights(spark):
    return table(spark, [(y, (y - 1990) * 10) for y in range(1995, 2000)], "year int, pct int").select("year", (F.col("pct").cast("decimal(6,2)") * F.lit(0.01).cast("decimal(4,2)")).alias("weight"))


@register("j11_scale_institutions", f"SELECT year, donor_name, round(sum(CASE WHEN donor_code IN {_isin(INSTITUTION)} AND year < 2000 THEN value * ((year - 1990) * 10)::DECIMAL(6,2) * 0.01::DECIMAL(4,2) ELSE value END), 2)::DOUBLE AS value FROM flows GROUP BY ALL")
def _(f, spark, sf):
    out = groups.scale_institutions(f, _weights(spark), INSTITUTION)
    return groups.sum_by(out, ["year", "donor_name"]).withColumns(money("value"))


# --- aggregations -------------------------------------------------------------------


@register("a01_sum_by", "SELECT year, income_group, indicator_name, sum(value)::DOUBLE AS value FROM flows GROUP BY ALL")
def _(f, spark, sf):
    return groups.sum_by(f, ["year", "income_group", "indicator_name"]).withColumn("value", F.col("value").cast("double"))


@register("a02_group_total", f"SELECT year, indicator_name, 'Seven' AS donor_name, sum(value)::DOUBLE AS value FROM flows WHERE donor_code IN {_isin(MEMBERS)} GROUP BY ALL")
def _(f, spark, sf):
    return groups.group_total(f, MEMBERS, "donor_code", ["year", "indicator_name"], "donor_name", "Seven").withColumn("value", F.col("value").cast("double"))


@register("a03_attribute_total", "SELECT year, CASE income_group WHEN 'LIC' THEN 'Low income' WHEN 'LMIC' THEN 'Lower middle income' ELSE income_group END AS recipient_name, sum(value)::DOUBLE AS value FROM flows GROUP BY ALL")
def _(f, spark, sf):
    labels = table(spark, INCOME.items(), "code string, name string")
    return groups.attribute_total(f, "income_group", ["year"], "recipient_name", labels).withColumn("value", F.col("value").cast("double"))


@register("a04_recipient_group_totals", "SELECT year, indicator_name, g AS recipient_name, sum(value)::DOUBLE AS value FROM flows JOIN rlab ON code = recipient_code GROUP BY ALL", SQL_RECIPIENTS)
def _(f, spark, sf):
    return groups.recipient_group_totals(f, recipient_labels(), ["year", "indicator_name"]).withColumn("value", F.col("value").cast("double"))


@register("a05_donor_group_totals", "SELECT year, indicator_name, g AS donor_name, sum(value)::DOUBLE AS value FROM flows JOIN labels ON code = donor_code GROUP BY ALL", SQL_LABELS)
def _(f, spark, sf):
    return groups.donor_group_totals(f, DONORS, ["year", "indicator_name"]).withColumn("value", F.col("value").cast("double"))


@register("a05_donor_groups_with_bloc", f"SELECT year, indicator_name, g AS donor_name, sum(value)::DOUBLE AS value FROM flows JOIN (SELECT g, code FROM labels UNION ALL SELECT 'Bloc', n_nationkey FROM nation WHERE n_nationkey IN {_isin((*MEMBERS, *INSTITUTION))}) ON code = donor_code GROUP BY ALL", SQL_LABELS)
def _(f, spark, sf):
    return groups.donor_group_totals(f, DONORS, ["year", "indicator_name"], bloc=("Bloc", MEMBERS, INSTITUTION)).withColumn("value", F.col("value").cast("double"))


@register("a06_bloc_total", f"SELECT year, 'Bloc' AS donor_name, sum(value)::DOUBLE AS value FROM (SELECT year, value FROM flows WHERE indicator_name = 'A' AND donor_code IN {_isin(MEMBERS)} UNION ALL SELECT year, value FROM flows WHERE indicator_name = 'R' AND donor_code IN {_isin(MEMBERS)} AND channel_code NOT IN (2, 3)) GROUP BY year")
def _(f, spark, sf):
    return groups.bloc_total(f.where("indicator_name = 'A'"), f.where("indicator_name = 'R'"), MEMBERS, (2, 3), ["year"], "Bloc").withColumn("value", F.col("value").cast("double"))


@register("a07_all_bilateral_total", f", x AS (SELECT year, CASE donor_code WHEN 24 THEN 'Scaled' ELSE donor_name END AS donor_name, donor_code, sum(value) AS value FROM flows GROUP BY ALL) SELECT year, donor_name, value::DOUBLE AS value FROM x WHERE donor_name <> 'Scaled' UNION ALL SELECT year, 'All bilateral', sum(value)::DOUBLE FROM x WHERE donor_name = 'Scaled' OR donor_code IN {_isin(MEMBERS)} GROUP BY year")
def _(f, spark, sf):
    rows = groups.sum_by(f.withColumn("donor_name", F.when(F.col("donor_code") == 24, "Scaled").otherwise(F.col("donor_name"))), ["year", "donor_code", "donor_name"])
    return groups.all_bilateral_total(rows, MEMBERS, "Scaled", ["year"], "All bilateral").withColumn("value", F.col("value").cast("double"))


@register("a08_ambiguous_keys", "SELECT recipient_code, year, count(DISTINCT segment) AS n_segment, count(DISTINCT region) AS n_region FROM flows GROUP BY ALL HAVING count(DISTINCT segment) > 1 OR count(DISTINCT region) > 1")
def _(f, spark, sf):
    return classify.ambiguous_keys(f, ["recipient_code", "year"], ["segment", "region"])


@register("a09_widen_currency_price", "SELECT year, indicator_name, " + ", ".join(f"round(sum(round({v}, 4)), 2)::DOUBLE AS {v}" for v in views.VALUES) + " FROM (SELECT year, indicator_name, donor_code, " + ", ".join(f"sum({v}) AS {v}" for v in views.VALUES) + " FROM conv GROUP BY ALL) GROUP BY ALL")
def _(f, spark, sf):
    wide = currency.convert_currencies(groups.sum_by(f, ["year", "donor_code", "indicator_name"]), tables.rates(spark, sf))
    long = currency.to_long(wide, ["year", "donor_code", "indicator_name"])
    return currency.widen_currency_price(long, ["year", "indicator_name"]).withColumns(money(*views.VALUES))


@register("a10_derive_measure", ", w AS (SELECT year, donor_name, sum(value) FILTER (indicator_name = 'N') AS n, sum(value) FILTER (indicator_name = 'A') AS a FROM flows GROUP BY ALL) SELECT year, donor_name, 'N' AS indicator_name, n::DOUBLE AS value FROM w WHERE n IS NOT NULL UNION ALL SELECT year, donor_name, 'A', a::DOUBLE FROM w WHERE a IS NOT NULL UNION ALL SELECT year, donor_name, 'N less A', (n - coalesce(a, 0))::DOUBLE FROM w WHERE n IS NOT NULL")
def _(f, spark, sf):
    rows = groups.sum_by(f, ["year", "donor_name", "indicator_name"])
    return report.non_part(rows, ["year", "donor_name"], "N", "A", "N less A").withColumn("value", F.col("value").cast("double"))


SERIES_SQL = f"""sv AS (SELECT year, donor_name, recipient_name, indicator_name, CASE s WHEN 'Food' THEN 'Production' WHEN 'Unallocated/unspecified' THEN NULL ELSE 'Social' END AS sector_name, s AS sub_sector_name, sum(value) AS value
  FROM (SELECT *, {SQL_SUB} AS s FROM flows) GROUP BY ALL
), shared AS (SELECT *, value::DOUBLE / sum(value) OVER (PARTITION BY year, donor_name)::DOUBLE AS d, value::DOUBLE / sum(value) OVER (PARTITION BY year, recipient_name)::DOUBLE AS r FROM sv
), ser AS (SELECT year, donor_name, recipient_name, 'All' AS indicator_name, sector_name, sub_sector_name, sum(value)::DOUBLE / 1e6 AS value, sum(d) AS d, sum(r) AS r FROM shared GROUP BY ALL)"""


def _sector_rows(f, spark):
    named = joins.lookup(f, sub_sectors(spark), "purpose_code", "sub_sector_name", "Unallocated/unspecified")
    rows = groups.sum_by(named, ["year", "donor_name", "recipient_name", "indicator_name", "sub_sector_name"])
    return joins.lookup(rows, sectors(spark), "sub_sector_name", "sector_name")


def _series(f, spark):
    """The series of all donors and recipients, with the shares that a view has."""
    share = lambda c: F.col("value").cast("double") / F.sum("value").over(Window.partitionBy("year", c)).cast("double")
    rows = _sector_rows(f, spark).withColumns({"value_usd_current": F.col("value"), "value_eur_current": F.col("value"), "pct_of_donor": share("donor_name"), "pct_of_recipient": share("recipient_name")})
    return query.sector_series(rows, None, None, ["A", "N", "R"], "eur", "current", combined="All")


@register("a11_sector_series", "SELECT year, donor_name, recipient_name, indicator_name, sector_name, sub_sector_name, round(value, 6) AS value, round(d, 6) AS pct_of_donor, round(r, 6) AS pct_of_recipient FROM ser", SERIES_SQL)
def _(f, spark, sf):
    return _series(f, spark).select("year", "donor_name", "recipient_name", "indicator_name", "sector_name", "sub_sector_name", *[F.round(c, 6).alias(c) for c in ("value", "pct_of_donor", "pct_of_recipient")])


@register("a12_sector_totals", "SELECT coalesce(sector_name, 'Other') AS sector_name, indicator_name, round(sum(value), 5) AS value FROM ser GROUP BY ALL", SERIES_SQL)
def _(f, spark, sf):
    return query.sector_totals(_series(f, spark)).withColumn("value", F.round("value", 5))


@register("o04_ordered_sector_totals", ", t AS (SELECT coalesce(sector_name, 'Other') AS sector_name, indicator_name, sum(value) AS v FROM ser GROUP BY ALL) SELECT sector_name, indicator_name, round(v, 5) AS value, row_number() OVER (ORDER BY v DESC, sector_name, indicator_name)::INTEGER AS position FROM t", SERIES_SQL)
def _(f, spark, sf):
    return report.ordered_totals(query.sector_totals(_series(f, spark)), "value", "sector_name", "indicator_name").withColumn("value", F.round("value", 5))


@register("a13_collapse_years", "SELECT year, coalesce(sector_name, 'none') AS sector_name, round(sum(value), 5) AS value, round(sum(d), 6) AS pct_of_donor FROM ser GROUP BY ALL", SERIES_SQL)
def _(f, spark, sf):
    out = query.collapse_years(_series(f, spark).withColumn("sector_name", F.coalesce("sector_name", F.lit("none"))), ["sector_name"])
    return out.select("year", "sector_name", F.round("value", 5).alias("value"), F.round("pct_of_donor", 6).alias("pct_of_donor"))


REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@register("a14_year_by_group_table", "SELECT year, " + ", ".join(f"sum(value) FILTER (region = '{r}')::DOUBLE AS \"{r}\"" for r in REGIONS) + " FROM flows GROUP BY year")
def _(f, spark, sf):
    return reshape.year_by_group_table(f, "region", REGIONS).select("year", *[F.col(r).cast("double").alias(r) for r in REGIONS])


AGG_SQL = "SELECT 'donor' AS dimension, donor_name AS key, NULL::VARCHAR AS key2, sum(value)::DOUBLE AS total, count(*) AS n FROM flows GROUP BY donor_name UNION ALL SELECT 'year', year::VARCHAR, NULL, sum(value)::DOUBLE, count(*) FROM flows GROUP BY year UNION ALL SELECT 'indicator', indicator_name, NULL, sum(value)::DOUBLE, count(*) FROM flows GROUP BY indicator_name UNION ALL SELECT 'sector', income_group, NULL, sum(value)::DOUBLE, count(*) FROM flows WHERE income_group IS NOT NULL GROUP BY income_group UNION ALL SELECT 'donor_sector', donor_name, income_group, sum(value)::DOUBLE, count(*) FROM flows WHERE income_group IS NOT NULL GROUP BY ALL"


def _release(f):
    return f.select("year", "donor_name", "indicator_name", F.col("income_group").alias("sector_name"), "value")


@register("a15_release_aggregates", AGG_SQL)
def _(f, spark, sf):
    return release.release_aggregates(_release(f), "value").withColumn("total", F.col("total").cast("double"))


@register("a16_presence_sets", f"SELECT dimension, string_agg(key, ',' ORDER BY key) AS vals FROM ({AGG_SQL}) WHERE key2 IS NULL GROUP BY dimension")
def _(f, spark, sf):
    return release.presence_sets(release.release_aggregates(_release(f), "value")).select("dimension", F.array_join("values", ",").alias("vals"))


@register("a17_distribution", "SELECT round(min(v), 4) AS min, round(max(v), 4) AS max, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.75), 4) AS p75 FROM (SELECT value::DOUBLE AS v FROM flows)")
def _(f, spark, sf):
    return release.distribution(f, "value").select(*[F.round(c, 4).alias(c) for c in ("min", "max", "median", "p25", "p75")])


CHANGES_SQL = "ch AS (SELECT donor, year, t, lag(t) OVER w AS p, lag(year) OVER w AS py, (t - lag(t) OVER w) / nullif(lag(t) OVER w, 0) AS c FROM (SELECT donor_name AS donor, year, sum(value)::DOUBLE AS t FROM flows GROUP BY ALL) WINDOW w AS (PARTITION BY donor ORDER BY year))"


@register("a18_historical_variation", "SELECT donor, round(avg(c), 6) AS mean, round(coalesce(stddev_samp(c), 0), 6) AS std FROM ch WHERE c IS NOT NULL GROUP BY donor UNION ALL SELECT NULL, round(avg(c), 6), round(stddev_pop(c), 6) FROM ch WHERE c IS NOT NULL", CHANGES_SQL)
def _(f, spark, sf):
    return release.historical_variation(f, "value").select("donor", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register("a19_purpose_group_totals", f"SELECT year, recipient_code, {SQL_SUB.replace(chr(39) + 'Unallocated/unspecified' + chr(39), 'NULL')} AS sector, sum(value)::DOUBLE AS value FROM flows GROUP BY ALL")
def _(f, spark, sf):
    return impute.purpose_group_totals(f, "sector", {"sector": sub_sectors(spark)}, ["year"], by_recipient=True).withColumn("value", F.col("value").cast("double"))


@register("a20_latest_year_topics", "SELECT topic, donor_name, sum(value)::DOUBLE AS value FROM (SELECT 'all' AS topic, * FROM flows UNION ALL SELECT 'health', * FROM flows WHERE purpose_code IN (12, 13) UNION ALL SELECT 'food', * FROM flows WHERE purpose_code IN (31)) WHERE year = (SELECT max(year) FROM flows) GROUP BY ALL")
def _(f, spark, sf):
    return impute.latest_year_topic_totals(f, {"all": None, "health": (12, 13), "food": (31,)}).withColumn("value", F.col("value").cast("double"))


COVER_SQL = f"mem AS (SELECT 'Seven' AS group_name, n_nationkey AS member_code FROM nation WHERE n_nationkey IN {_isin(MEMBERS)} UNION ALL SELECT 'Gone', 99), seen AS (SELECT DISTINCT year, purpose_code, channel_code, donor_code FROM flows), cb AS (SELECT group_name, count(DISTINCT (year, purpose_code, channel_code)) AS n FROM seen JOIN mem ON donor_code = member_code GROUP BY ALL)"


@register("a21_coverage_report", "SELECT m.group_name, m.member_code, (cb.n - count(seen.year)) AS n_missing, count(seen.year) = 0 AS never FROM mem m JOIN cb ON cb.group_name = m.group_name LEFT JOIN seen ON seen.donor_code = m.member_code GROUP BY m.group_name, m.member_code, cb.n", COVER_SQL)
def _(f, spark, sf):
    members = N.groups_table(spark, {"Seven": MEMBERS, "Gone": (99,)})
    return groups.coverage_report(f, members, "donor_code", ["year", "purpose_code", "channel_code"])


@register("a21_coverage_summary", "SELECT group_name, count(*) AS n_combos, count(*) FILTER (k < 7) AS n_incomplete FROM (SELECT group_name, year, purpose_code, channel_code, count(*) AS k FROM seen JOIN mem ON donor_code = member_code GROUP BY ALL) GROUP BY group_name", COVER_SQL)
def _(f, spark, sf):
    members = N.groups_table(spark, {"Seven": MEMBERS, "Gone": (99,)})
    return groups.coverage_summary(f, members, "donor_code", ["year", "purpose_code", "channel_code"]).select("group_name", "n_combos", "n_incomplete")


MANY = {"Seven": MEMBERS, "Most": tuple(range(20)), "Hundred": tuple(range(-60, 40))}


@register(
    "a21_coverage_gaps",
    """SELECT group_name, n_combos, n_incomplete, coalesce(never, '') AS never, coalesce(worst, '') AS worst FROM (
  SELECT group_name, any_value(n_combos) AS n_combos, any_value(n_incomplete) AS n_incomplete, string_agg(member_code::VARCHAR, ',' ORDER BY member_code) FILTER (n = 0) AS never, string_agg(member_code || ':' || (n_combos - n), ',' ORDER BY n, member_code DESC) FILTER (k <= 5) AS worst
  FROM (SELECT *, CASE WHEN n > 0 AND n < n_combos THEN row_number() OVER (PARTITION BY group_name, n > 0 AND n < n_combos ORDER BY n, member_code DESC) END AS k FROM counted) GROUP BY group_name)""",
    "mem AS (" + " UNION ALL ".join(f"SELECT '{g}' AS group_name, unnest({list(c)}) AS member_code" for g, c in MANY.items()) + """),
here AS (SELECT DISTINCT group_name, year, recipient_code, purpose_code, member_code FROM flows JOIN mem ON donor_code = member_code),
combos AS (SELECT group_name, year, recipient_code, purpose_code, count(*) AS k FROM here GROUP BY ALL),
sizes AS (SELECT group_name, count(*) AS size FROM mem GROUP BY ALL),
whole AS (SELECT group_name, count(*) AS n_combos, count(*) FILTER (k < size) AS n_incomplete FROM combos JOIN sizes USING (group_name) GROUP BY ALL),
counted AS (SELECT m.group_name, m.member_code, n_combos, n_incomplete, count(h.year) AS n FROM mem m JOIN whole USING (group_name) LEFT JOIN here h ON h.group_name = m.group_name AND h.member_code = m.member_code GROUP BY ALL)""",
)
def _(f, spark, sf):
    members = N.groups_table(spark, MANY)
    out = groups.coverage_summary(f, members, "donor_code", ["year", "recipient_code", "purpose_code"])
    text = F.transform("worst", lambda w: F.concat_ws(":", w["member_code"].cast("string"), w["n_missing"].cast("string")))
    return out.select("group_name", "n_combos", "n_incomplete", F.array_join(F.col("never").cast("array<string>"), ",").alias("never"), F.array_join(text, ",").alias("worst"))


@register("a22_aid_mix", ", w AS (SELECT year, donor_name, sum(value) AS total, sum(value) FILTER (indicator_name = 'A') AS a, sum(value) FILTER (indicator_name = 'R' AND donor_name <> 'NATION_7') AS r FROM flows GROUP BY ALL), m AS (SELECT year, sum(r) AS s FROM w WHERE donor_name <> 'NATION_7' GROUP BY year) SELECT year, donor_name, (total - coalesce(a, 0) - coalesce(CASE WHEN donor_name = 'NATION_7' AND r IS NULL THEN s ELSE r END, 0))::DOUBLE AS other FROM w JOIN m USING (year)")
def _(f, spark, sf):
    w = f.groupBy("year", "donor_name").agg(F.sum("value").alias("total"), F.sum(F.when(F.col("indicator_name") == "A", F.col("value"))).alias("a"), F.sum(F.when((F.col("indicator_name") == "R") & (F.col("donor_name") != "NATION_7"), F.col("value"))).alias("r"))
    return report.aid_mix(w, ["a", "r"], aggregate="NATION_7", missing="r").select("year", "donor_name", F.col("other").cast("double").alias("other"))


@register("a23_append_total_entity", "SELECT year, donor_name, sum(value)::DOUBLE AS value FROM flows GROUP BY ALL UNION ALL SELECT year, 'All', sum(value)::DOUBLE FROM flows GROUP BY year")
def _(f, spark, sf):
    return groups.append_total_entity(groups.sum_by(f, ["year", "donor_name"]), ["year"], "donor_name", "All").withColumn("value", F.col("value").cast("double"))


SHARES_SQL = "sp AS (SELECT channel_code, year, purpose_code, sum(value) AS v FROM flows WHERE indicator_name = 'R' GROUP BY ALL), sm AS (SELECT a.channel_code, t.year, a.purpose_code, sum(a.v) AS v FROM sp a JOIN (SELECT DISTINCT channel_code, year FROM sp) t ON t.channel_code = a.channel_code AND a.year BETWEEN t.year - 2 AND t.year GROUP BY ALL), sh AS (SELECT channel_code, year, purpose_code, round(v::DOUBLE / sum(v) OVER (PARTITION BY channel_code, year)::DOUBLE, 9) AS share FROM sm)"


@register("a25_channel_spending_shares", "SELECT channel_code, year, purpose_code, round(share, 6) AS share FROM sh", SHARES_SQL)
def _(f, spark, sf):
    return impute.channel_spending_shares(f.where("indicator_name = 'R'"), by=["purpose_code"]).withColumn("share", F.round("share", 6))


@register("a24_imputed_multilateral", "SELECT g.year, g.donor_name, sh.purpose_code, round(sum(g.v::DOUBLE * share), 2) AS value FROM (SELECT year, donor_name, channel_code, sum(value) AS v FROM flows WHERE indicator_name = 'A' GROUP BY ALL) g JOIN sh ON sh.channel_code = g.channel_code AND sh.year = g.year GROUP BY ALL", SHARES_SQL)
def _(f, spark, sf):
    sh = impute.channel_spending_shares(f.where("indicator_name = 'R'"), by=["purpose_code"])
    return impute.imputed_multilateral(f.where("indicator_name = 'A'"), sh, ["year", "donor_name", "purpose_code"]).withColumn("value", F.round("value", 2))


#: nine of ten rows come through one channel
_HOT = "CASE WHEN channel_code = 7 AND purpose_code % 3 = 0 THEN 7 ELSE 1 END"


@register(
    "a24_dominating_channel",
    "SELECT g.year, g.donor_name, sh.recipient_code, sh.purpose_code, round(sum(g.v::DOUBLE * share), 2) AS value FROM (SELECT year, donor_name, channel_code, sum(value) AS v FROM hot WHERE indicator_name = 'A' GROUP BY ALL) g JOIN sh ON sh.channel_code = g.channel_code AND sh.year = g.year GROUP BY ALL",
    f"hot AS (SELECT * REPLACE ({_HOT} AS channel_code) FROM flows), " + SHARES_SQL.replace("FROM flows", "FROM hot").replace("purpose_code", "purpose_code, recipient_code").replace("a.purpose_code, recipient_code", "a.purpose_code, a.recipient_code"),
)
def _(f, spark, sf):
    hot = f.withColumn("channel_code", F.expr(_HOT))
    sh = impute.channel_spending_shares(hot.where("indicator_name = 'R'"))
    out = impute.imputed_multilateral(hot.where("indicator_name = 'A'"), sh, ["year", "donor_name", "recipient_code", "purpose_code"], pairs_per_task=2000)
    return out.withColumn("value", F.round("value", 2))


@register("a26_combine_indicators", "SELECT year, donor_name, 'Total' AS indicator_name, sum(value)::DOUBLE AS value FROM flows GROUP BY ALL")
def _(f, spark, sf):
    return groups.combine_indicators(f, ["year", "donor_name", "indicator_name"], "Total").withColumn("value", F.col("value").cast("double"))


# --- windows ------------------------------------------------------------------------


@register("w01_pct_change", "SELECT donor AS donor_name, year, round(c, 6) AS pct_change FROM ch", CHANGES_SQL)
def _(f, spark, sf):
    return shares.pct_change(groups.sum_by(f, ["year", "donor_name"]), ["donor_name"]).select("donor_name", "year", "pct_change")


@register("w02_share_of_group_total", "SELECT year, donor_name, round(v::DOUBLE / sum(v) OVER (PARTITION BY year)::DOUBLE, 6) AS share FROM (SELECT year, donor_name, sum(value) AS v FROM flows GROUP BY ALL)")
def _(f, spark, sf):
    return shares.share_of_group_total(groups.sum_by(f, ["year", "donor_name"]), ["year"], "share").select("year", "donor_name", "share")


@register("w03_share_of_reference_total", ", x AS (SELECT year, donor_name, income_group, indicator_name, sum(value) AS v FROM flows GROUP BY ALL), t AS (SELECT year, income_group, sum(v) AS v FROM x WHERE donor_name = 'NATION_7' GROUP BY ALL) SELECT x.year, donor_name, x.income_group, indicator_name, round(x.v::DOUBLE / t.v::DOUBLE, 6) AS share FROM x LEFT JOIN t ON t.year = x.year AND t.income_group IS NOT DISTINCT FROM x.income_group")
def _(f, spark, sf):
    x = groups.sum_by(f, ["year", "donor_name", "income_group", "indicator_name"])
    return shares.share_of_reference_total(x, "donor_name", "NATION_7", ["year", "income_group"], "share").drop("value")


@register("w04_share_of_indicator", ", x AS (SELECT year, donor_name, indicator_name, sum(value) AS v FROM flows GROUP BY ALL) SELECT x.year, x.donor_name, x.indicator_name, round(x.v::DOUBLE / t.v::DOUBLE, 6) AS share FROM x LEFT JOIN x t ON t.year = x.year AND t.donor_name = x.donor_name AND t.indicator_name = 'N'")
def _(f, spark, sf):
    return shares.share_of_indicator(groups.sum_by(f, ["year", "donor_name", "indicator_name"]), "N", ["year", "donor_name"], "share").drop("value")


@register("w05_share_of_gni", "SELECT year, donor_name, round(v::DOUBLE / g.value::DOUBLE, 5) AS pct_of_gni, round(v::DOUBLE / g.value::DOUBLE * 100, 2) AS gni_percent, round(greatest((20000.0 - v::DOUBLE / g.value::DOUBLE * 100) / 100 * g.value::DOUBLE, 0.0), -1) AS shortfall FROM (SELECT year, donor_name, sum(value) AS v FROM flows GROUP BY ALL) JOIN gni g USING (year, donor_name)")
def _(f, spark, sf):
    return shares.share_of_gni(groups.sum_by(f, ["year", "donor_name"]), tables.gni(spark, sf), target=20000.0).withColumn("shortfall", F.round("shortfall", -1)).drop("value")


@register("w06_yoy_scores", ", s AS (SELECT donor, count(*) AS n, avg(c) FILTER (year < 2000) AS m, stddev_samp(c) FILTER (year < 2000) AS s, max(c) FILTER (year = 2000 AND py = 1999) AS c FROM ch WHERE year <= 2000 GROUP BY donor) SELECT donor, round(c, 6) AS change, round(m, 6) AS mean, round(s, 6) AS std, round((c - m) / s, 6) AS z FROM s WHERE n >= 4 AND s > 0 AND c IS NOT NULL", CHANGES_SQL)
def _(f, spark, sf):
    return release.yoy_scores(f, 2000, "value").select("donor", *[F.round(c, 6).alias(c) for c in ("change", "mean", "std", "z")])


@register("w07_order_by_total", ", t AS (SELECT region, row_number() OVER (ORDER BY sum(value) DESC, region) AS rank FROM flows GROUP BY region) SELECT DISTINCT year, region, rank::INTEGER AS rank FROM flows JOIN t USING (region)")
def _(f, spark, sf):
    return shares.order_by_total(groups.sum_by(f, ["year", "region"]), "region").drop("value")


@register("w08_sector_year_share", "SELECT year, region, sum(sum(value)) OVER (PARTITION BY year)::DOUBLE AS year_total FROM flows GROUP BY year, region")
def _(f, spark, sf):
    return shares.sector_year_share(groups.sum_by(f, ["year", "region"])).select("year", "region", F.col("year_total").cast("double").alias("year_total"))


# --- sorts, sets --------------------------------------------------------------------


@register("o01_pinned_sort", "SELECT year, donor_name, row_number() OVER (ORDER BY CASE WHEN donor_name = 'NATION_7' THEN 0 ELSE 1 END, year, donor_name)::INTEGER AS position FROM (SELECT DISTINCT year, donor_name FROM flows)")
def _(f, spark, sf):
    rows = f.select("year", "donor_name").distinct()
    return report.ranked(rows, report.pinned_order(F.col("donor_name"), "NATION_7", F.asc("year"), F.asc("donor_name")))


@register("o02_gni_table", "SELECT year, donor_name, pct_of_gni, row_number() OVER (ORDER BY year DESC, pct_of_gni DESC NULLS LAST, donor_name)::INTEGER AS position FROM (SELECT year, donor_name, CASE WHEN donor_name <> 'NATION_7' THEN round(v::DOUBLE / g.value::DOUBLE, 5) END AS pct_of_gni FROM (SELECT year, donor_name, sum(value) AS v FROM flows GROUP BY ALL) JOIN gni g USING (year, donor_name))")
def _(f, spark, sf):
    return report.gni_table(groups.sum_by(f, ["year", "donor_name"]), tables.gni(spark, sf), blank="NATION_7").drop("value")


@register("o03_top_k", "SELECT donor_name, sum(value)::DOUBLE AS value FROM flows GROUP BY donor_name ORDER BY 2 DESC, 1 LIMIT 5")
def _(f, spark, sf):
    rows = groups.sum_by(f, ["donor_name"]).withColumn("value", F.col("value").cast("double"))
    return report.top_k(rows, [F.desc("value"), F.asc("donor_name")], 5)


@register("o03_first_names", ", n AS (SELECT DISTINCT region, recipient_name AS x FROM flows), r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY x) AS k, count(*) OVER (PARTITION BY region) AS c FROM n) SELECT region, string_agg(x, ', ' ORDER BY x) FILTER (k <= 3) || CASE WHEN max(c) > 3 THEN ' (+' || (max(c) - 3) || ' more)' ELSE '' END AS names FROM r GROUP BY region")
def _(f, spark, sf):
    return f.groupBy("region").agg(report.first_names("recipient_name", 3).alias("names"))


@register("u01_union_by_name", "SELECT year, donor_name, donor_code, sum(value)::DOUBLE AS value FROM flows GROUP BY ALL UNION ALL SELECT year, 'All', NULL, sum(value)::DOUBLE FROM flows GROUP BY year")
def _(f, spark, sf):
    out = reshape.union_by_name(groups.sum_by(f, ["year", "donor_name", "donor_code"]), groups.sum_by(f, ["year"]).withColumn("donor_name", F.lit("All")))
    return out.withColumn("value", F.col("value").cast("double"))


@register("u02_splice", "SELECT year, donor_name, sum(value)::DOUBLE AS value FROM flows WHERE (indicator_name = 'R' AND (year < 1998 OR channel_code = 7)) OR (indicator_name = 'N' AND NOT (year < 1998 OR channel_code = 7)) GROUP BY ALL")
def _(f, spark, sf):
    rows = reshape.splice(f, "indicator_name", "R", "N", 1998, always_before=[7], item_col="channel_code")
    return groups.sum_by(rows, ["year", "donor_name"]).withColumn("value", F.col("value").cast("double"))


@register("u03_distinct_on", "SELECT year, donor_name, purpose_code, value::DOUBLE AS value FROM (SELECT *, row_number() OVER (PARTITION BY year, donor_name ORDER BY value DESC, purpose_code) AS k FROM flows) WHERE k = 1")
def _(f, spark, sf):
    out = reshape.distinct_on(f.select("year", "donor_name", "purpose_code", "value"), ["year", "donor_name"], [F.desc("value"), F.asc("purpose_code")])
    return out.withColumn("value", F.col("value").cast("double"))


@register("u05_fill_missing", ", x AS (SELECT year, donor_name, recipient_name, purpose_code, sum(value) AS value FROM flows GROUP BY ALL) SELECT y.year, s.donor_name, s.recipient_name, s.purpose_code, coalesce(x.value, 0)::DOUBLE AS value FROM years y, (SELECT DISTINCT donor_name, recipient_name, purpose_code FROM x) s LEFT JOIN x ON x.year = y.year AND x.donor_name = s.donor_name AND x.recipient_name = s.recipient_name AND x.purpose_code = s.purpose_code")
def _(f, spark, sf):
    x = groups.sum_by(f, ["year", "donor_name", "recipient_name", "purpose_code"])
    return reshape.fill_missing(x, tables.YEARS, ["donor_name", "recipient_name", "purpose_code"], {"value": 0}).withColumn("value", F.col("value").cast("double"))


# --- functions ----------------------------------------------------------------------


@register("f01_normalize_unspecified", ", n AS (SELECT DISTINCT recipient_name || CASE recipient_code % 5 WHEN 0 THEN ', regional' WHEN 1 THEN ' unspecified' WHEN 2 THEN ', unspecified' WHEN 3 THEN ' Regional and Unspecified' ELSE '' END AS name FROM flows) SELECT name, regexp_replace(regexp_replace(name, ',?\\s+regional$', ', unspecified'), '([^,\\s])\\s+unspecified$', '\\1, unspecified') AS normal FROM n")
def _(f, spark, sf):
    tail = F.element_at(F.array(*map(F.lit, [", regional", " unspecified", ", unspecified", " Regional and Unspecified", ""])), (F.col("recipient_code") % 5 + 1).cast("int"))
    return f.select(F.concat("recipient_name", tail).alias("name")).distinct().select("name", N.normalize_unspecified(F.col("name")).alias("normal"))


@register("f02_slugify", "SELECT DISTINCT c_name AS name, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
def _(f, spark, sf):
    names = tables.read(spark, sf, "customer").select(F.col("c_name").alias("name")).distinct()
    return N.add_slug(names, "name", "slug")


@register("f02_slug_collisions", "SELECT trim(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '-') AS slug, string_agg(n, ';' ORDER BY n) AS names FROM (SELECT DISTINCT unnest([c_name, c_name || '!']) AS n FROM customer) GROUP BY slug HAVING count(*) > 1")
def _(f, spark, sf):
    names = tables.read(spark, sf, "customer").select(F.explode(F.array(F.col("c_name"), F.concat("c_name", F.lit("!")))).alias("name"))
    return N.slug_collisions(N.add_slug(names, "name", "slug"), "name", "slug").withColumn("names", F.array_join("names", ";"))


@register("f03_to_units", "SELECT year, donor_name, (round(sum(value), 2)::DECIMAL(18,2) * 100)::BIGINT AS units FROM flows GROUP BY ALL")
def _(f, spark, sf):
    return groups.sum_by(f, ["year", "donor_name"]).select("year", "donor_name", S.to_units(F.col("value"), 100).alias("units"))


@register("f05_formats", "SELECT year, CASE WHEN v >= 1000 THEN format('{:,.2f} billion', v / 1000) ELSE format('{:,.1f} million', v) END AS amount FROM (SELECT year, round(sum(value)::DOUBLE / 1e6, 3) AS v FROM flows GROUP BY year)")
def _(f, spark, sf):
    return groups.sum_by(f, ["year"]).select("year", S.format_amount(F.round(S.to_millions(F.col("value")), 3)).alias("amount"))


@register("f06_rounding", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 1) AS even, round(l_quantity / 4, 1) AS up FROM lineitem")
def _(f, spark, sf):
    q = F.col("l_quantity") / 4
    return tables.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.rounded(q, 1, half_even=True).alias("even"), S.rounded(q, 1).alias("up"))


@register("f07_keys", "SELECT DISTINCT donor_name || '|' || region AS key, donor_name AS a, region AS b FROM flows")
def _(f, spark, sf):
    keys = f.select(S.join_key(F.col("donor_name"), F.col("region")).alias("key")).distinct()
    a, b = S.split_key(F.col("key"))
    return keys.select("key", a.alias("a"), b.alias("b"))


@register("f08_finite", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_totalprice END AS v FROM orders")
def _(f, spark, sf):
    v = F.when(F.col("o_orderkey") % 3 == 0, float("nan")).when(F.col("o_orderkey") % 3 == 1, float("inf")).otherwise(F.col("o_totalprice"))
    return tables.read(spark, sf, "orders").select("o_orderkey", io.finite(v).alias("v"))


# --- release ------------------------------------------------------------------------


RELEASE_SQL = "cur AS (SELECT * FROM flows WHERE donor_code <> 4 AND NOT (donor_code = 7 AND year = 2001)), prev AS (SELECT year, donor_code, donor_name, income_group, indicator_name, value * (CASE WHEN donor_code = 9 THEN 2 ELSE 1 END) AS value FROM flows WHERE donor_code <> 11 AND year < 2001)"


def _two_releases_of(f):
    cur = f.where("donor_code <> 4 and not (donor_code = 7 and year = 2001)")
    return cur, f.where("donor_code <> 11 and year < 2001").withColumn("value", F.col("value") * F.when(F.col("donor_code") == 9, 2).otherwise(1))


def _two_releases(f):
    cur, prev = _two_releases_of(f)
    return _release(cur), _release(prev)


@register("v03_duplicate_keys", "SELECT year, donor_name, indicator_name, purpose_code, channel_code, count(*) AS n FROM flows GROUP BY ALL HAVING count(*) > 1")
def _(f, spark, sf):
    return release.duplicate_keys(f, ["year", "donor_name", "indicator_name", "purpose_code", "channel_code", "absent_column"])


GATES_SQL = """dup AS (SELECT year::VARCHAR || '|' || donor_name AS k, count(*) AS n FROM g GROUP BY ALL HAVING count(*) > 1
), bad AS (SELECT (SELECT count(*) FROM g) AS n, (SELECT count(value_usd) FROM g) AS filled, (SELECT max(value_usd) FROM g) AS most, (SELECT max(year) FROM g) AS last,
  (SELECT 'no_duplicates' WHERE NOT EXISTS (FROM dup)) AS unique_keys, (SELECT sum(n)::BIGINT::VARCHAR || ' rows share keys: ' FROM dup) || (SELECT string_agg(k, ', ' ORDER BY k) FROM (SELECT k FROM dup ORDER BY k LIMIT 5)) AS keys,
  (SELECT string_agg(c || ': ' || k || ' null in ' || y, '; ' ORDER BY o) FROM (
    SELECT 1 AS o, 'donor_name' AS c, count(*) AS k, (SELECT string_agg(year::VARCHAR, ', ' ORDER BY year) FROM (SELECT DISTINCT year FROM g WHERE donor_name IS NULL ORDER BY year LIMIT 10)) AS y FROM g WHERE donor_name IS NULL
    UNION ALL SELECT 2, 'indicator_name', count(*), (SELECT string_agg(year::VARCHAR, ', ' ORDER BY year) FROM (SELECT DISTINCT year FROM g WHERE indicator_name IS NULL ORDER BY year LIMIT 10)) FROM g WHERE indicator_name IS NULL
    UNION ALL SELECT 3, 'sector_name', count(*), (SELECT string_agg(year::VARCHAR, ', ' ORDER BY year) FROM (SELECT DISTINCT year FROM g WHERE sector_name IS NULL ORDER BY year LIMIT 10)) FROM g WHERE sector_name IS NULL) WHERE k > 0) AS names,
  (SELECT string_agg(d, ', ' ORDER BY o) FROM (SELECT 1 AS o, 'NATION_7' AS d UNION ALL SELECT 2, 'ATLANTIS') WHERE d NOT IN (SELECT donor_name FROM g WHERE donor_name IS NOT NULL)) AS absent
), err AS (SELECT 'not_empty' AS "check", CASE WHEN n = 0 THEN 'no rows' END AS e FROM bad
  UNION ALL SELECT 'no_duplicate_keys', keys FROM bad
  UNION ALL SELECT 'values_populated', CASE WHEN filled = 0 AND n > 0 THEN 'only nulls in value_usd' END FROM bad
  UNION ALL SELECT 'value_bounds', CASE WHEN most > 1e15 THEN 'too large in value_usd' END FROM bad
  UNION ALL SELECT 'names_populated', names FROM bad
  UNION ALL SELECT 'critical_dimensions', nullif(concat_ws('; ', CASE WHEN last < PREVIOUS THEN 'latest year fell to ' || last END, 'missing donors: ' || absent), '') FROM bad)"""


def _gated(f):
    return f.select("year", "donor_name", "indicator_name", F.col("income_group").alias("sector_name"), F.col("value").alias("value_usd"))


@register("v01_check_schema", "SELECT 'd' AS dataset, 'schema' AS \"check\", false AS passed, 'missing column currency; year is int, not string' AS errors, count(*) AS n FROM flows")
def _(f, spark, sf):
    df = _gated(f)
    gate = release.check_schema(df, T.StructType.fromDDL("currency string, year string, donor_name string, value_usd double"), "d")
    return gate.join(F.broadcast(df.agg(F.count("*").alias("n"))))


@register(
    "v02_to_v07_gates",
    "SELECT 'd' AS dataset, \"check\", e IS NULL AS passed, coalesce(e, '') AS errors FROM err",
    "g AS (SELECT year, donor_name, indicator_name, income_group AS sector_name, value AS value_usd FROM flows), " + GATES_SQL.replace("PREVIOUS", "2000"),
)
def _(f, spark, sf):
    df = io.stored(_gated(f), "gated")
    out = release.check_not_empty(df, "d")
    for g in (release.check_no_duplicate_keys(df, ["year", "donor_name"], "d"), release.check_value_columns_populated(df, "d"), release.check_value_bounds(df, "d"), release.check_names_populated(df, "d"), release.check_critical_dimensions(df, ["NATION_7", "ATLANTIS"], 2000, "d")):
        out = out.unionByName(g)
    return out


@register("v08_yoy_anomalies", ", s AS (SELECT donor, count(*) AS n, avg(c) FILTER (year < 2000) AS m, stddev_samp(c) FILTER (year < 2000) AS s, max(c) FILTER (year = 2000 AND py = 1999) AS c FROM ch WHERE year <= 2000 GROUP BY donor), z AS (SELECT donor, (c - m) / s AS z FROM s WHERE n >= 4 AND s > 0 AND c IS NOT NULL) SELECT 'd' AS dataset, 'yoy' AS \"check\", donor AS entity, CASE WHEN abs(z) > 0.5 THEN 'high' ELSE 'medium' END AS level, round(z, 6) AS metric FROM z WHERE abs(z) > 0.25", CHANGES_SQL)
def _(f, spark, sf):
    # Lower levels than the usual 2 and 3, so that even donors show up.
    out = release.detect_yoy_anomalies(f, 2000, "value", "d", medium=0.25, high=0.5)
    return out.select("dataset", "check", "entity", "level", F.round("metric", 6).alias("metric"))


@register("v09_release_drift", "SELECT CASE WHEN abs(x) > 0.4 THEN 'high' ELSE 'medium' END AS level, k AS entity, round(x, 6) AS metric FROM (SELECT p.k, (coalesce(c.v, 0) - p.v) / p.v AS x FROM (SELECT donor_name AS k, sum(value)::DOUBLE AS v FROM prev GROUP BY 1) p LEFT JOIN (SELECT donor_name AS k, sum(value)::DOUBLE AS v FROM cur GROUP BY 1) c USING (k)) WHERE abs(x) > 0.2", RELEASE_SQL)
def _(f, spark, sf):
    now, was = (release.release_aggregates(x, "value") for x in _two_releases(f))
    return release.detect_release_drift(now, was).select("level", "entity", F.round("metric", 6).alias("metric"))


@register("v10_missing_expected_data", "SELECT donor_name AS entity FROM cur GROUP BY 1 HAVING count(*) FILTER (year = 2000) > 0 AND (count(*) FILTER (year = 2001) = 0 OR sum(value) FILTER (year = 2001) = 0)", RELEASE_SQL)
def _(f, spark, sf):
    return release.detect_missing_expected_data(_two_releases(f)[0], 2001, "value").select("entity")


@register("v11_new_or_removed", "SELECT 'info' AS level, donor_name AS entity FROM (SELECT DISTINCT donor_name FROM cur EXCEPT SELECT donor_name FROM prev) UNION ALL SELECT 'medium', donor_name FROM (SELECT DISTINCT donor_name FROM prev EXCEPT SELECT donor_name FROM cur)", RELEASE_SQL)
def _(f, spark, sf):
    now, was = (release.release_aggregates(x, "value") for x in _two_releases(f))
    return release.detect_new_or_removed_entities(now, was).select("level", "entity")


@register("v12_row_count_change", ", x AS (SELECT (SELECT count(*) FROM cur) AS a, (SELECT count(*) FROM prev) AS b) SELECT CASE WHEN abs((a - b) / b) > 0.3 THEN 'high' ELSE 'medium' END AS level, round((a - b)::DOUBLE / b, 6) AS metric FROM x WHERE abs((a - b)::DOUBLE / b) > 0.001", RELEASE_SQL)
def _(f, spark, sf):
    now, was = _two_releases(f)
    one = now.agg(F.count("*").alias("now")).join(F.broadcast(was.agg(F.count("*").alias("was"))))
    return release.detect_row_count_change(F.col("now"), F.col("was"), one, medium=0.001).select("level", F.round("metric", 6).alias("metric"))


@register("v13_indicator_gaps", "SELECT CASE WHEN c.t IS NULL THEN 'high' ELSE 'medium' END AS level, p.indicator_name AS entity FROM (SELECT DISTINCT indicator_name FROM prev) p LEFT JOIN (SELECT indicator_name, sum(value) AS t FROM cur WHERE indicator_name <> 'R' GROUP BY ALL) c USING (indicator_name) WHERE c.t IS NULL OR c.t = 0", RELEASE_SQL)
def _(f, spark, sf):
    now, was = _two_releases(f)
    return release.detect_indicator_coverage_gaps(release.release_aggregates(now.where("indicator_name <> 'R'"), "value"), release.release_aggregates(was, "value")).select("level", "entity")


@register("v14_sector_drift", ", x AS (SELECT donor_name || '|' || income_group AS k, p.v AS p, coalesce(c.v, 0) AS c FROM (SELECT donor_name, income_group, sum(value)::DOUBLE AS v FROM prev WHERE income_group IS NOT NULL GROUP BY ALL) p LEFT JOIN (SELECT donor_name, income_group, sum(value)::DOUBLE AS v FROM cur GROUP BY ALL) c USING (donor_name, income_group)), y AS (SELECT income_group AS k, p.v AS p, coalesce(c.v, 0) AS c FROM (SELECT income_group, sum(value)::DOUBLE AS v FROM prev WHERE income_group IS NOT NULL GROUP BY ALL) p LEFT JOIN (SELECT income_group, sum(value)::DOUBLE AS v FROM cur GROUP BY ALL) c USING (income_group)) SELECT CASE WHEN abs((c - p) / p) > 0.6 THEN 'high' ELSE 'medium' END AS level, k AS entity, round((c - p) / p, 6) AS metric FROM x WHERE abs((c - p) / p) > 0.4 UNION ALL SELECT CASE WHEN abs((c - p) / p) > 0.4 THEN 'high' ELSE 'medium' END, k, round((c - p) / p, 6) FROM y WHERE abs((c - p) / p) > 0.2", RELEASE_SQL)
def _(f, spark, sf):
    now, was = (release.release_aggregates(x, "value") for x in _two_releases(f))
    return release.detect_sector_drift(now, was).select("level", "entity", F.round("metric", 6).alias("metric"))


TOPIC_SQL = RELEASE_SQL + ", tp AS (SELECT p.k, (coalesce(c.v, 0) - p.v) / p.v AS x FROM (SELECT donor_name AS k, sum(value)::DOUBLE AS v FROM prev GROUP BY 1) p LEFT JOIN (SELECT donor_name AS k, sum(value)::DOUBLE AS v FROM cur GROUP BY 1) c USING (k)), st AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM tp)"


def _topic(df):
    return df.groupBy(F.col("donor_name").alias("donor")).agg(F.sum("value").cast("double").alias("total"))


@register("v15_topic_drift", "SELECT CASE WHEN abs((x - m) / s) > 3 OR abs(x) > 0.4 THEN 'high' ELSE 'medium' END AS level, k AS entity, round(x, 6) AS metric FROM tp, st WHERE abs((x - m) / s) > 2 OR abs(x) > 0.2", TOPIC_SQL)
def _(f, spark, sf):
    now, was = map(_topic, _two_releases(f))
    return release.detect_topic_drift(now, was).select("level", "entity", F.round("metric", 6).alias("metric"))


@register("v16_missing_critical", "SELECT 'high' AS level, p.donor_name AS entity FROM (SELECT donor_name, sum(value) AS t FROM prev WHERE donor_name IN (SELECT n_name FROM nation WHERE n_nationkey IN (3, 4, 11)) GROUP BY ALL HAVING sum(value) > 0) p LEFT JOIN (SELECT donor_name, sum(value) AS t FROM cur GROUP BY ALL) c USING (donor_name) WHERE coalesce(c.t, 0) = 0", RELEASE_SQL)
def _(f, spark, sf):
    now, was = map(_topic, _two_releases(f))
    names = [r[0] for r in tables.read(spark, sf, "nation").where("n_nationkey in (3, 4, 11)").select("n_name").collect()]
    return release.detect_missing_critical(now, was, names).select("level", "entity")


@register("v17_new_entities_summary", ", n AS (SELECT DISTINCT donor_name AS x FROM cur WHERE donor_name NOT IN (SELECT donor_name FROM prev)), k AS (SELECT x, row_number() OVER (ORDER BY x) AS k FROM n) SELECT 'info' AS level, 'new donors: ' || string_agg(x, ', ' ORDER BY x) FILTER (k <= 5) || CASE WHEN count(*) > 5 THEN ' and ' || (count(*) - 5) || ' others' ELSE '' END AS message FROM k HAVING count(*) > 0", RELEASE_SQL)
def _(f, spark, sf):
    now, was = map(_topic, _two_releases(f))
    return release.detect_new_entities_summary(now, was).select("level", "message")


@register("v18_snapshot_release", f"SELECT 'r1' AS release, * FROM ({AGG_SQL}) UNION ALL SELECT 'r1', 'stats', k, NULL, round(v, 4), (SELECT count(*) FROM flows) FROM (SELECT unnest(['row_count', 'first_year', 'last_year', 'min', 'max', 'p25', 'median', 'p75']) AS k, unnest([count(*)::DOUBLE, min(year), max(year), min(value)::DOUBLE, max(value)::DOUBLE, quantile_cont(value::DOUBLE, 0.25), quantile_cont(value::DOUBLE, 0.5), quantile_cont(value::DOUBLE, 0.75)]) AS v FROM flows)")
def _(f, spark, sf):
    out = release.snapshot_release(_release(f), "r1", ["year", "donor_name"], "value")
    return out.withColumn("total", F.round("total", 4)).select("release", "dimension", "key", "key2", "total", "n")


@register("v19_previous_release", "SELECT release FROM (SELECT year::VARCHAR AS release, max(make_date(year, 1, 1)) AS computed_at FROM flows GROUP BY year) WHERE release <> '2001' ORDER BY computed_at DESC, release DESC LIMIT 1")
def _(f, spark, sf):
    releases = f.groupBy(F.col("year").cast("string").alias("release")).agg(F.max(F.make_date("year", F.lit(1), F.lit(1))).alias("computed_at"))
    return release.previous_release(releases, "2001").select("release")


ALL_WARNINGS_SQL = """agg_c AS (SELECT 'donor' AS d, donor_name AS k, NULL AS k2, sum(value)::DOUBLE AS t FROM cur GROUP BY ALL UNION ALL SELECT 'indicator', indicator_name, NULL, sum(value)::DOUBLE FROM cur GROUP BY ALL UNION ALL SELECT 'sector', income_group, NULL, sum(value)::DOUBLE FROM cur WHERE income_group IS NOT NULL GROUP BY ALL UNION ALL SELECT 'donor_sector', donor_name, income_group, sum(value)::DOUBLE FROM cur WHERE income_group IS NOT NULL GROUP BY ALL
), agg_p AS (SELECT 'donor' AS d, donor_name AS k, NULL AS k2, sum(value)::DOUBLE AS t FROM prev GROUP BY ALL UNION ALL SELECT 'indicator', indicator_name, NULL, sum(value)::DOUBLE FROM prev GROUP BY ALL UNION ALL SELECT 'sector', income_group, NULL, sum(value)::DOUBLE FROM prev WHERE income_group IS NOT NULL GROUP BY ALL UNION ALL SELECT 'donor_sector', donor_name, income_group, sum(value)::DOUBLE FROM prev WHERE income_group IS NOT NULL GROUP BY ALL
), mv AS (SELECT p.d, p.k, p.k2, (coalesce(c.t, 0) - p.t) / p.t AS x FROM agg_p p LEFT JOIN agg_c c ON c.d = p.d AND c.k = p.k AND c.k2 IS NOT DISTINCT FROM p.k2 WHERE p.t <> 0
), cc AS (SELECT donor, year, (t - lag(t) OVER w) / nullif(lag(t) OVER w, 0) AS c, lag(year) OVER w AS py FROM (SELECT donor_name AS donor, year, sum(value)::DOUBLE AS t FROM cur GROUP BY ALL) WINDOW w AS (PARTITION BY donor ORDER BY year)
), zz AS (SELECT donor, (max(c) FILTER (year = 2001 AND py = 2000) - avg(c) FILTER (year < 2001)) / nullif(stddev_samp(c) FILTER (year < 2001), 0) AS z, count(*) AS n, count(*) FILTER (year < 2001) AS b FROM cc WHERE year <= 2001 GROUP BY donor
), rows AS (SELECT (SELECT count(*) FROM cur)::DOUBLE AS a, (SELECT count(*) FROM prev)::DOUBLE AS b
), warned AS (
  SELECT CASE WHEN abs(z) > 3 THEN 'high' ELSE 'medium' END AS level, 'yoy' AS "check", donor AS entity, z AS metric FROM zz WHERE abs(z) > 2 AND n >= 4 AND b >= 3
  UNION ALL SELECT 'high', 'missing_data', donor_name, NULL FROM cur GROUP BY donor_name HAVING count(*) FILTER (year = 2000) > 0 AND (count(*) FILTER (year = 2001) = 0 OR sum(value) FILTER (year = 2001) = 0)
  UNION ALL SELECT CASE WHEN abs(x) > 0.4 THEN 'high' ELSE 'medium' END, 'release_drift', k, x FROM mv WHERE d = 'donor' AND abs(x) > 0.2
  UNION ALL SELECT CASE WHEN abs(x) > 0.4 THEN 'high' ELSE 'medium' END, 'sector_drift', k, x FROM mv WHERE d = 'sector' AND abs(x) > 0.2
  UNION ALL SELECT CASE WHEN abs(x) > 0.6 THEN 'high' ELSE 'medium' END, 'sector_drift', k || '|' || k2, x FROM mv WHERE d = 'donor_sector' AND abs(x) > 0.4
  UNION ALL SELECT 'info', 'entities', k, NULL FROM (SELECT d, k FROM agg_c WHERE k2 IS NULL EXCEPT SELECT d, k FROM agg_p WHERE k2 IS NULL)
  UNION ALL SELECT CASE WHEN d = 'sector' THEN 'high' ELSE 'medium' END, 'entities', k, NULL FROM (SELECT d, k FROM agg_p WHERE k2 IS NULL EXCEPT SELECT d, k FROM agg_c WHERE k2 IS NULL)
  UNION ALL SELECT CASE WHEN c.t IS NULL THEN 'high' ELSE 'medium' END, 'indicator_coverage', p.k, NULL FROM agg_p p LEFT JOIN agg_c c ON c.d = p.d AND c.k = p.k WHERE p.d = 'indicator' AND coalesce(c.t, 0) = 0
  UNION ALL SELECT CASE WHEN abs((a - b) / b) > 0.3 THEN 'high' ELSE 'medium' END, 'row_count', NULL, (a - b) / b FROM rows WHERE abs((a - b) / b) > 0.15)"""


def _written(f, *more):
    """The columns of a release, written once: what validates and compares releases reads them several times."""
    return io.stored(f.select("year", "donor_code", "donor_name", "indicator_name", "income_group", *more, "value"), "flows")


def _validated(f):
    now, was = _two_releases(_written(f))
    now = now.withColumn("value_usd", F.col("value"))
    return release.validate_dataset(now, "d", now.drop("value").schema, ["year", "donor_name"], "value", previous=release.snapshot_release(was, "r1", ["year"], "value"), critical=["NATION_7", "ATLANTIS"], year=2001)


@register(
    "v20_validate_dataset_gates",
    "SELECT 'd' AS dataset, \"check\", e IS NULL AS passed, coalesce(e, '') AS errors FROM err UNION ALL SELECT 'd', 'schema', true, ''",
    RELEASE_SQL + ", g AS (SELECT year, donor_name, indicator_name, income_group AS sector_name, value AS value_usd FROM cur), " + GATES_SQL.replace("PREVIOUS", "(SELECT max(year) FROM prev)"),
)
def _(f, spark, sf):
    return _validated(f)[0]


@register("v20_validate_dataset_warnings", "SELECT 'd' AS dataset, level, \"check\", entity, round(metric, 6) AS metric FROM warned", RELEASE_SQL + ", " + ALL_WARNINGS_SQL)
def _(f, spark, sf):
    return _validated(f)[1].select("dataset", "level", "check", "entity", F.round("metric", 6).alias("metric"))


@register("v21_warning_summary", "SELECT level, count(*) AS n FROM warned GROUP BY level", RELEASE_SQL + ", " + ALL_WARNINGS_SQL)
def _(f, spark, sf):
    return release.warning_summary(_validated(f)[1])


#: The flow columns of a second dataset: orders by their customer's nation and priority.
ORDER_FLOWS_SQL = "flows AS (SELECT year(o_orderdate)::INTEGER AS year, c_nationkey AS donor_code, n_name AS donor_name, c_mktsegment AS income_group, o_orderpriority AS indicator_name, o_totalprice::DECIMAL(18,2) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey)"


def _order_flows(spark, sf):
    t = lambda name: tables.read(spark, sf, name)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.year("o_orderdate").alias("year"), F.col("c_nationkey").alias("donor_code"), F.col("n_name").alias("donor_name"), F.col("c_mktsegment").alias("income_group"), F.col("o_orderpriority").alias("indicator_name"), F.col("o_totalprice").cast("decimal(18,2)").alias("value")
    )


TOPICS = {"basic": tuple(range(1, 21)), "food": tuple(range(30, 46)), "all": None}


def _whole_report_sql(name: str, flows: str = "") -> str:
    """Gates, warnings and the releases saved of one dataset."""
    gates = GATES_SQL.replace("PREVIOUS", "(SELECT max(year) FROM prev)")
    return f"""(WITH {flows}{RELEASE_SQL}, g AS (SELECT year, donor_name, indicator_name, income_group AS sector_name, value AS value_usd FROM cur), {gates}, {ALL_WARNINGS_SQL}
SELECT '{name}' AS dataset, 'gate' AS kind, "check", CASE WHEN e IS NULL THEN 'passed' ELSE 'failed' END AS level, coalesce(e, '') AS entity, NULL::DOUBLE AS metric FROM err
UNION ALL SELECT '{name}', 'gate', unnest(['readable', 'schema']), 'passed', '', NULL
UNION ALL SELECT '{name}', 'warning', "check", level, entity, round(metric, 6) FROM warned
UNION ALL SELECT '{name}', 'saved', release, NULL, NULL, n::DOUBLE FROM (SELECT 'r1' AS release, count(*) AS n FROM prev UNION ALL SELECT 'r2', count(*) FROM cur))"""


_TOPIC_LISTS = ", ".join(f"('{t}', {'NULL' if codes is None else list(codes)})" for t, codes in TOPICS.items())


@register(
    "v20_validate_all",
    f"""SELECT * FROM {_whole_report_sql("flows")} UNION ALL SELECT * FROM {_whole_report_sql("orders", ORDER_FLOWS_SQL + ", ")}
UNION ALL SELECT 'absent', 'gate', 'readable', 'failed', '', NULL
UNION ALL SELECT 'topics', 'gate', unnest(['readable', 'not_empty']), 'passed', '', NULL
UNION ALL SELECT 'topics', 'warning', 'topic_drift', CASE WHEN abs(z) > 3 OR abs(x) > 0.4 THEN 'high' ELSE 'medium' END, donor_name, round(x, 6) FROM (
  SELECT donor_name, x, coalesce((x - avg(x) OVER (PARTITION BY topic)) / nullif(stddev_pop(x) OVER (PARTITION BY topic), 0), 0) AS z FROM topic_moves) WHERE abs(z) > 2 OR abs(x) > 0.2
UNION ALL SELECT 'topics', 'warning', 'missing_critical', 'high', donor_name, NULL FROM topic_moves WHERE x = -1 AND donor_name IN ('NATION_4', 'NATION_7')
UNION ALL SELECT 'topics', 'warning', 'new_entities', 'info', NULL, n FROM (SELECT count(DISTINCT donor_name)::DOUBLE AS n FROM topic_sums s WHERE is_now AND donor_name NOT IN (SELECT donor_name FROM topic_sums WHERE NOT is_now)) WHERE n > 0
UNION ALL SELECT 'topics', 'saved', unnest(['r1', 'r2']), NULL, NULL, NULL""",
    f"""topics(topic, codes) AS (VALUES {_TOPIC_LISTS}),
both_releases AS (SELECT true AS is_now, year, donor_name, purpose_code, value FROM flows WHERE donor_code <> 4 AND NOT (donor_code = 7 AND year = 2001) UNION ALL SELECT false, year, donor_name, purpose_code, value * (CASE WHEN donor_code = 9 THEN 2 ELSE 1 END) FROM flows WHERE donor_code <> 11 AND year < 2001),
latest AS (SELECT is_now, max(year) AS year FROM both_releases GROUP BY is_now),
topic_sums AS (SELECT is_now, topic, donor_name, sum(value)::DOUBLE AS t FROM both_releases JOIN latest USING (is_now, year) JOIN topics ON codes IS NULL OR list_contains(codes, purpose_code) GROUP BY ALL),
topic_moves AS (SELECT topic, donor_name, (coalesce(c.t, 0) - p.t) / p.t AS x FROM topic_sums p LEFT JOIN (SELECT topic, donor_name, t FROM topic_sums WHERE is_now) c USING (topic, donor_name) WHERE NOT p.is_now AND p.t > 0)""",
)
def _(f, spark, sf):
    """Two releases of two views and a topic table, one after the other; a third view is not there."""
    path = io.scratch_path(spark, "views")
    gated = lambda x: x.select("year", "donor_name", "indicator_name", F.col("sector_name"), F.col("value").alias("value_usd"))
    report = None
    f, orders = _written(f, "purpose_code"), io.stored(_order_flows(spark, sf), "orders")
    for k, name in ((1, "r1"), (0, "r2")):
        raw = _two_releases_of(f)[k]
        gated(_release(raw)).write.parquet(f"{path}/{name}/flows")
        raw.select("year", "donor_name", "purpose_code", "value").write.parquet(f"{path}/{name}/topics")
        gated(_release(_two_releases_of(orders)[k])).write.parquet(f"{path}/{name}/orders")
        views_ = [release.Dataset(d, f"{path}/{name}/{d}", T.StructType.fromDDL("year int, donor_name string, indicator_name string, sector_name string, value_usd decimal(18,4)"), ["year", "donor_name"], "value_usd", ["NATION_7", "ATLANTIS"], None if k else 2001) for d in ("flows", "orders", "absent")]
        report = release.validate_all(spark, views_, name, f"{path}/manifests", [release.Topics("topics", f"{path}/{name}/topics", TOPICS, critical=["NATION_4", "NATION_7"])])
    gates, warnings = report
    none = F.lit(None).cast("string")
    text = F.when(F.col("check") == "readable", "").otherwise(F.col("errors"))
    out = gates.select("dataset", F.lit("gate").alias("kind"), "check", F.when(F.col("passed"), "passed").otherwise("failed").alias("level"), text.alias("entity"), F.lit(None).cast("double").alias("metric"))
    out = out.unionByName(warnings.select("dataset", F.lit("warning").alias("kind"), "check", "level", "entity", F.round("metric", 6).alias("metric")))
    for d in ("flows", "orders", "topics"):
        saved = io.load_manifest(spark, f"{path}/manifests/{d}").groupBy("release").agg(F.max(F.when(F.col("key") == "row_count", F.col("total"))).alias("metric"))
        out = out.unionByName(saved.select(F.lit(d).alias("dataset"), F.lit("saved").alias("kind"), F.col("release").alias("check"), none.alias("level"), none.alias("entity"), "metric"))
    return out


@register("s07_manifest", f"SELECT release, dimension, key, key2, total, n FROM (SELECT 'r1' AS release, * FROM ({AGG_SQL})) WHERE dimension <> 'donor_sector' UNION ALL SELECT 'r2', dimension, key, key2, total, n FROM ({AGG_SQL}) WHERE dimension = 'donor'")
def _(f, spark, sf):
    path = io.scratch_path(spark, "manifest")
    # Three snapshots are saved from one pass.
    agg = io.stored(release.release_aggregates(_release(f), "value").select(F.lit("r1").alias("release"), "dimension", "key", "key2", F.col("total").cast("double").alias("total"), "n"), "aggregates")
    none = io.load_manifest(spark, path).count()
    io.save_manifest(agg, path)
    io.save_manifest(agg.where("dimension = 'donor'").withColumn("release", F.lit("r2")), path)
    # Saved again, a release replaces itself and leaves the other one.
    io.save_manifest(agg.where("dimension <> 'donor_sector'"), path)
    return io.load_manifest(spark, path).where(F.lit(none == 0)).select("release", "dimension", "key", "key2", "total", "n")


DOCUMENT_SQL = f"rows AS (SELECT 'r1' AS release, * FROM ({AGG_SQL})), late AS (SELECT * FROM flows WHERE year > 1997), rows2 AS (SELECT 'r2' AS release, * FROM ({AGG_SQL.replace('FROM flows', 'FROM late')}))"
_STATS_SQL = "SELECT {r} AS release, unnest(['row_count', 'year 0', 'year 1', 'min', 'max', 'median']) AS section, NULL AS name, unnest([count(*)::DOUBLE, min(year), max(year), min(value)::DOUBLE, max(value)::DOUBLE, quantile_cont(value::DOUBLE, 0.5)]) AS value FROM {t}"


@register(
    "s07_manifest_document",
    f"""SELECT release, section, name, round(value, 4) AS value FROM (
  SELECT release, 'by_' || dimension AS section, concat_ws('|', key, key2) AS name, total AS value FROM (FROM rows UNION ALL FROM rows2)
  UNION ALL {_STATS_SQL.format(r="'r1'", t="flows")} UNION ALL {_STATS_SQL.format(r="'r2'", t="late")}
  UNION ALL SELECT release, 'presence ' || dimension, string_agg(key, ',' ORDER BY key), count(*) FROM (FROM rows UNION ALL FROM rows2) WHERE key2 IS NULL GROUP BY ALL)""",
    DOCUMENT_SQL,
)
def _(f, spark, sf):
    """Two releases, written, read, merged and written again; one of them replaced on the way."""
    path = io.scratch_path(spark, "document")
    snapshot = lambda df, name: release.snapshot_release(_release(df), name, ["year"], "value")
    late = snapshot(f.where("year > 1997"), "r2")
    io.write_document(io.manifest_document(snapshot(f, "r1").unionByName(late.withColumn("total", F.lit(float("nan")))), "flows"), f"{path}/1")
    merged = io.merge_documents(io.read_document(spark, f"{path}/1"), io.manifest_document(late, "flows"))
    io.write_document(merged, f"{path}/2")
    each = io.read_document(spark, f"{path}/2").select(F.explode("document.releases").alias("release", "r"))
    sums = each.select("release", F.explode("r.aggregates").alias("section", "m")).select("release", "section", F.explode("m").alias("name", "value"))
    numbers = F.map_concat(F.map_filter("r.distribution", lambda k, _: k.isin("min", "max", "median")), F.create_map(F.lit("row_count"), F.col("r.row_count").cast("double"), F.lit("year 0"), F.col("r.year_range")[0].cast("double"), F.lit("year 1"), F.col("r.year_range")[1].cast("double")))
    stats = each.select("release", F.explode(numbers).alias("section", "value")).select("release", "section", F.lit(None).cast("string").alias("name"), "value")
    names = each.select("release", F.explode("r.presence").alias("d", "n")).select("release", F.concat(F.lit("presence "), "d").alias("section"), F.array_join("n", ",").alias("name"), F.size("n").cast("double").alias("value"))
    return sums.unionByName(stats).unionByName(names).withColumn("value", F.round("value", 4))


# --- queries and reports ----------------------------------------------------------------


@register("p05_drill_down", "SELECT year, donor_name, recipient_name, indicator_name, round(sum(value_eur_constant)::DOUBLE / 1e6, 6) AS value FROM conv WHERE donor_name = 'NATION_7' AND recipient_name = 'NATION_3' AND indicator_name IN ('A', 'N') AND year BETWEEN 1996 AND 2000 GROUP BY ALL")
def _(f, spark, sf):
    wide = currency.convert_currencies(groups.sum_by(f, ["year", "donor_code", "donor_name", "recipient_name", "indicator_name"]), tables.rates(spark, sf))
    return query.drill_down(wide, "NATION_7", ["A", "N"], "eur", "constant", (1996, 2000), "NATION_3").withColumn("value", F.round("value", 6))


@register("p09_unit_select", "SELECT year, donor_name, round(v::DOUBLE / sum(v) OVER (PARTITION BY year)::DOUBLE * 100, 6) AS shown FROM (SELECT year, donor_name, sum(value) AS v FROM flows GROUP BY ALL)")
def _(f, spark, sf):
    rows = shares.sector_year_share(groups.sum_by(f, ["year", "donor_name"]))
    return query.unit_select(rows, "donor", denominators={"donor": "year_total"}).select("year", "donor_name", F.round("shown", 6).alias("shown"))


@register("vw5_headline", "SELECT year, donor AS donor_name, round(c, 6) AS pct_change, CASE WHEN c < 0 THEN 'fell' ELSE 'rose' END AS direction FROM ch WHERE year = 2000", CHANGES_SQL)
def _(f, spark, sf):
    totals = groups.sum_by(f, ["year", "donor_name"]).withColumn("value", S.to_millions(F.col("value")))
    return report.headline(totals, 2000).select("year", "donor_name", F.round("pct_change", 6).alias("pct_change"), "direction")


@register("vw5_africa_share", "SELECT year, sum(value) FILTER (region = 'AFRICA')::DOUBLE AS value, sum(value)::DOUBLE AS total, round(sum(value) FILTER (region = 'AFRICA')::DOUBLE / sum(value)::DOUBLE, 4) AS share FROM flows GROUP BY year")
def _(f, spark, sf):
    return report.group_share_series(f, "region", "AFRICA").withColumns({"value": F.col("value").cast("double"), "total": F.col("total").cast("double")})


@register("vw5_income_split", "SELECT income_group, round(sum(value)::DOUBLE / sum(sum(value)) OVER ()::DOUBLE, 4) AS share FROM flows WHERE year = (SELECT max(year) FROM flows) GROUP BY income_group")
def _(f, spark, sf):
    return report.split_latest(f, "income_group").select("income_group", "share")


@register("vw5_country_series", "SELECT year, donor_name, sum(value)::DOUBLE AS value FROM flows WHERE recipient_name = 'NATION_3' GROUP BY ALL UNION ALL SELECT year, 'All', sum(value)::DOUBLE FROM flows WHERE recipient_name = 'NATION_3' GROUP BY year")
def _(f, spark, sf):
    return report.country_series(f, "NATION_3", "All").withColumn("value", F.col("value").cast("double"))


@register("vw5_sector_series", f"SELECT year, sub, sum(value)::DOUBLE AS value, round(sum(value)::DOUBLE / sum(sum(value)) OVER (PARTITION BY year)::DOUBLE, 4) AS share FROM (SELECT year, {SQL_SUB} AS sub, value FROM flows) GROUP BY year, sub")
def _(f, spark, sf):
    named = joins.lookup(f, sub_sectors(spark), "purpose_code", "sub", "Unallocated/unspecified")
    return report.part_series(named, ["year"], "sub").withColumn("value", F.col("value").cast("double"))


@register("vw5_key_sector_shares", f""", x AS (SELECT year, donor_name, {SQL_SUB} AS sub, value FROM flows), y AS (SELECT year, donor_name, sub, sum(value) AS v FROM x GROUP BY ALL UNION ALL SELECT year, 'All donors', sub, sum(value) FROM x GROUP BY ALL), z AS (SELECT *, round(v::DOUBLE / sum(v) OVER (PARTITION BY year, donor_name)::DOUBLE, 4) AS s FROM y)
SELECT year, donor_name, max(s) FILTER (sub = 'Basic') AS "Basic", max(s) FILTER (sub = 'Health') AS "Health" FROM z GROUP BY ALL""")
def _(f, spark, sf):
    named = joins.lookup(f, sub_sectors(spark), "purpose_code", "sub", "Unallocated/unspecified")
    return report.part_shares_wide(named, "sub", ["Basic", "Health"], "All donors")


@register("vw5_gni_key_number", ", x AS (SELECT f.year, f.donor_name, f.v, g.value::DOUBLE AS g, round(f.v / g.value::DOUBLE, 6) AS s FROM (SELECT year, donor_name, sum(value)::DOUBLE AS v FROM flows GROUP BY ALL) f JOIN gni g USING (year, donor_name)), y AS (SELECT *, lag(s) OVER (PARTITION BY donor_name ORDER BY year) AS p FROM x) SELECT year, donor_name, s AS oda_gni, round(g * 2000 - v, 1) AS distance, round((s - p) / p, 4) AS centre FROM y WHERE year = 2000")
def _(f, spark, sf):
    return report.gni_key_number(groups.sum_by(f, ["year", "donor_name"]), tables.gni(spark, sf), 2000, target=2000)


@register("vw5_gni_series", "SELECT year, donor_name, v::DOUBLE AS value, CASE WHEN donor_name <> 'NATION_3' THEN round(v::DOUBLE / g.value::DOUBLE, 5) END AS pct_of_gni, row_number() OVER (ORDER BY CASE WHEN donor_name = 'NATION_7' THEN 0 ELSE 1 END, year, donor_name)::INTEGER AS position FROM (SELECT year, donor_name, sum(value) AS v FROM flows GROUP BY ALL) JOIN gni g USING (year, donor_name)")
def _(f, spark, sf):
    rows = groups.sum_by(f, ["year", "donor_name"])
    return report.gni_series(rows, tables.gni(spark, sf), "NATION_7", blank="NATION_3").withColumn("value", F.col("value").cast("double"))


TO_ONE_SQL = "one AS (SELECT year, donor_name, sum(value) AS v FROM flows WHERE recipient_name = 'NATION_3' AND ((indicator_name = 'N' AND year <= 1998) OR (indicator_name = 'R' AND year >= 1998) OR indicator_name = 'A') GROUP BY ALL), to_one AS (SELECT year, donor_name, v FROM one UNION ALL SELECT year, 'All donors', sum(v) FROM one GROUP BY year)"


def _to_one(f):
    part = lambda i: f.where((F.col("indicator_name") == i) & (F.col("recipient_name") == "NATION_3")).select("year", "donor_name", "value")
    return report.recipient_total(part("N"), part("R"), part("A"), 1998, "All donors")


@register("vw5_recipient_total", "SELECT year, donor_name, v::DOUBLE AS value FROM to_one", TO_ONE_SQL)
def _(f, spark, sf):
    return _to_one(f).withColumn("value", F.col("value").cast("double"))


PARTS_SQL = "topic AS (SELECT year, donor_name, round(sum(value), 2)::DECIMAL(18,2) AS v FROM flows WHERE purpose_code IN (18, 19, 20) GROUP BY ALL), side AS (SELECT year, donor_name, v FROM topic UNION ALL SELECT year, 'All donors', sum(v) FROM topic GROUP BY year)"


def _side(f, spark):
    """A side input as it comes: a CSV of one row for each year and donor, and all donors' sum under one more name."""
    path = io.scratch_path(spark, "side.csv")
    rows = groups.sum_by(f.where(F.col("purpose_code").isin(18, 19, 20)), ["year", "donor_name"])
    rows.select("year", "donor_name", F.round("value", 2).cast("decimal(18,2)").alias("topic")).write.csv(path, header=True)
    side = io.read_csv_input(spark, path, "year int, donor_name string, topic decimal(18,2)").withColumnRenamed("topic", "value")
    return groups.append_total_entity(side, ["year"], "donor_name", "All donors")


@register("vw5_side_input_total", "SELECT year, donor_name, v::DOUBLE AS value FROM side", PARTS_SQL)
def _(f, spark, sf):
    return _side(f, spark).withColumn("value", F.col("value").cast("double"))


@register(
    "vw5_total_less_parts",
    """, x AS (SELECT t.year, t.donor_name, t.v AS total, coalesce(o.v, 0) AS to_one, coalesce(s.v, 0) AS topic, coalesce(h.v, 0) AS home FROM (SELECT year, donor_name, sum(value) AS v FROM flows GROUP BY ALL UNION ALL SELECT year, 'All donors', sum(value) FROM flows GROUP BY year) t
  LEFT JOIN to_one o USING (year, donor_name) LEFT JOIN side s USING (year, donor_name) LEFT JOIN (SELECT year, donor_name, sum(value) AS v FROM flows WHERE channel_code = 7 GROUP BY ALL) h USING (year, donor_name)),
y AS (SELECT year, donor_name, total, to_one, topic, CASE WHEN donor_name = 'All donors' AND year = (SELECT max(year) FROM x) THEN (SELECT sum(home) FROM x i WHERE i.year = x.year AND donor_name <> 'All donors') ELSE home END AS home FROM x)
SELECT year, donor_name, total::DOUBLE AS total, to_one::DOUBLE AS to_one, topic::DOUBLE AS topic, home::DOUBLE AS home, CASE WHEN year <> 2001 THEN round(total - to_one - topic - home, 1)::DOUBLE END AS other, CASE WHEN year = 2001 THEN round(total - to_one - topic - home, 1)::DOUBLE END AS preliminary,
  row_number() OVER (ORDER BY CASE WHEN donor_name = 'All donors' THEN 0 ELSE 1 END, year, donor_name)::INTEGER AS position FROM y""",
    f"{TO_ONE_SQL}, {PARTS_SQL}",
)
def _(f, spark, sf):
    # One pass over the flows: sums that tell apart what the parts ask for, and no more, are kept for all of them.
    asked = {"recipient_name": ["NATION_3"], "purpose_code": [18, 19, 20], "channel_code": [7]}
    f = f.withColumns({c: F.when(F.col(c).isin(values), F.col(c)) for c, values in asked.items()})
    f = io.stored(groups.sum_by(f, ["year", "donor_name", "indicator_name", *asked]), "parts")
    total = groups.append_total_entity(groups.sum_by(f, ["year", "donor_name"]), ["year"], "donor_name", "All donors")
    # The total entity reports no such part itself.
    home = groups.sum_by(f.where("channel_code = 7"), ["year", "donor_name"])
    out = report.total_less_parts(total, {"to_one": _to_one(f), "topic": _side(f, spark), "home": home}, "All donors", own_sum=["home"], preliminary=2001)
    return out.withColumns({c: F.col(c).cast("double") for c in ("total", "to_one", "topic", "home", "other", "preliminary")})


@register("f09_key_numbers", """SELECT '{"flows":{' || string_agg('"' || year || '":{"value":"' || v || '"}', ',' ORDER BY year) || '}}' AS numbers FROM (SELECT year, round(sum(value), 0)::BIGINT AS v FROM flows GROUP BY year)""")
def _(f, spark, sf):
    rows = groups.sum_by(f, ["year"]).withColumn("value", F.round("value", 0).cast("long"))
    return S.key_numbers(rows, "flows", "year", ["value"]).select(F.to_json("numbers").alias("numbers"))


# --- whole views ---------------------------------------------------------------------------


def _units(v: str) -> str:
    return f"(round({v}, 2)::DECIMAL(18,2) * 100)::BIGINT AS {v}"


_SUMS = ", ".join(f"sum({v}) AS {v}" for v in views.VALUES)
_UNITS = ", ".join(map(_units, views.VALUES))
BOTH_SQL = f"{SQL_LABELS}, {SQL_RECIPIENTS}, dl AS (SELECT g, code FROM labels UNION ALL SELECT n_name, n_nationkey FROM nation), rl AS (SELECT g, code FROM rlab UNION ALL SELECT n_name, n_nationkey FROM nation)"


@register(
    "vw1_financing_view",
    f""", i AS (SELECT year, donor_code, indicator_name, {_SUMS} FROM conv GROUP BY ALL UNION ALL SELECT year, donor_code, 'Total ODA', {_SUMS} FROM conv GROUP BY ALL),
x AS (SELECT year, g AS donor_name, indicator_name, {_SUMS} FROM i JOIN dl ON code = donor_code GROUP BY ALL),
gg AS (SELECT year, g AS donor_name, sum(value) AS gni FROM gni JOIN dl ON code = donor_code GROUP BY ALL)
SELECT x.year, x.donor_name, x.indicator_name, CASE WHEN x.year < 1998 THEN 'Flows' ELSE 'Grant equivalents' END AS type, {", ".join(f"(round(x.{v}, 2)::DECIMAL(18,2) * 100)::BIGINT AS {v}" for v in views.VALUES)},
  round(x.value_usd_current::DOUBLE / t.value_usd_current::DOUBLE, 6) AS pct_of_total_oda, round(x.value_usd_current::DOUBLE / gg.gni::DOUBLE, 5) AS pct_of_gni
FROM x JOIN x t ON t.year = x.year AND t.donor_name = x.donor_name AND t.indicator_name = 'Total ODA' LEFT JOIN gg ON gg.year = x.year AND gg.donor_name = x.donor_name""",
    BOTH_SQL,
)
def _(f, spark, sf):
    return views.financing_view(f, tables.rates(spark, sf), tables.gni(spark, sf), settings())


_VIEW = f"x AS (SELECT year, d.g AS donor_name, r.g AS recipient_name, indicator_name, {_SUMS} FROM (SELECT year, donor_code, recipient_code, indicator_name, {_SUMS} FROM conv GROUP BY ALL) JOIN dl d ON d.code = donor_code JOIN rl r ON r.code = recipient_code GROUP BY ALL)"


@register(
    "vw2_recipients_view",
    f""", {_VIEW}, a AS (SELECT year, recipient_name, sum(value_usd_current) AS t FROM x WHERE donor_name = 'All donors' GROUP BY ALL), b AS (SELECT year, donor_name, sum(value_usd_current) AS t FROM x WHERE recipient_name = 'All recipients' GROUP BY ALL)
SELECT x.year, x.donor_name, x.recipient_name, indicator_name, {_UNITS}, round(value_usd_current::DOUBLE / a.t::DOUBLE, 6) AS pct_total_recipient, round(value_usd_current::DOUBLE / b.t::DOUBLE, 6) AS pct_total_donor
FROM x LEFT JOIN a ON a.year = x.year AND a.recipient_name = x.recipient_name LEFT JOIN b ON b.year = x.year AND b.donor_name = x.donor_name""",
    BOTH_SQL,
)
def _(f, spark, sf):
    return views.recipients_view(f, tables.rates(spark, sf), settings())


@register(
    "vw3_marker_view",
    f""", x AS (SELECT year, d.g AS donor_name, r.g AS recipient_name, marker AS indicator_name, {_SUMS} FROM (SELECT year, donor_code, recipient_code, marker, {_SUMS} FROM conv GROUP BY ALL) JOIN dl d ON d.code = donor_code JOIN rl r ON r.code = recipient_code GROUP BY ALL)
SELECT year, donor_name, recipient_name, indicator_name, {_UNITS}, round(value_usd_current::DOUBLE / sum(value_usd_current) OVER (PARTITION BY year, donor_name, recipient_name)::DOUBLE, 6) AS pct_of_total_oda FROM x""",
    BOTH_SQL,
)
def _(f, spark, sf):
    return views.marker_view(f.withColumn("indicator_name", F.col("marker")), tables.rates(spark, sf), settings())


@register(
    "vw4_sectors_view",
    f""", x AS (SELECT year, d.g AS donor_name, r.g AS recipient_name, indicator_name, sub_sector_name, {_SUMS} FROM (SELECT year, donor_code, recipient_code, indicator_name, {SQL_SUB} AS sub_sector_name, {_SUMS} FROM conv GROUP BY ALL) JOIN dl d ON d.code = donor_code JOIN rl r ON r.code = recipient_code GROUP BY ALL),
a AS (SELECT year, recipient_name, sum(value_usd_current) AS t FROM x WHERE donor_name = 'All donors' GROUP BY ALL), b AS (SELECT year, donor_name, sum(value_usd_current) AS t FROM x WHERE recipient_name = 'All recipients' GROUP BY ALL)
SELECT x.year, x.donor_name, x.recipient_name, indicator_name, CASE sub_sector_name WHEN 'Food' THEN 'Production' WHEN 'Unallocated/unspecified' THEN 'Unallocated/unspecified' ELSE 'Social' END AS sector_name, sub_sector_name, {_UNITS},
  round(value_usd_current::DOUBLE / a.t::DOUBLE, 6) AS pct_of_recipient, round(value_usd_current::DOUBLE / b.t::DOUBLE, 6) AS pct_of_donor,
  trim(regexp_replace(lower(x.donor_name), '[^a-z0-9]+', '-', 'g'), '-') AS donor_slug, trim(regexp_replace(lower(x.recipient_name), '[^a-z0-9]+', '-', 'g'), '-') AS recipient_slug
FROM x LEFT JOIN a ON a.year = x.year AND a.recipient_name = x.recipient_name LEFT JOIN b ON b.year = x.year AND b.donor_name = x.donor_name""",
    BOTH_SQL,
)
def _(f, spark, sf):
    return views.sectors_view(f, tables.rates(spark, sf), sub_sectors(spark), sectors(spark), settings())


BLOC = views.Bloc("Bloc", MEMBERS, INSTITUTION, (2, 3))
WEIGHTED_DONORS = DONORS | {"All donors": tuple(range(24))}
_CASES = ", ".join(f"sum(w * {v}) AS {v}" for v in views.VALUES)


MARKERS = {"1-URGENT": "Principal", "2-HIGH": "Significant", "3-MEDIUM": "Not targeted", "4-NOT SPECIFIED": "Not screened", "5-LOW": "Not targeted"}
_MARKER_SQL = "CASE marker " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MARKERS.items()) + " END"
ITEMS = {1: "Total ODA", 2: "Bilateral", 3: "Refugees", 12: "Bilateral"}


@register(
    "vw1_financing_spliced",
    f""", raw AS (SELECT year, donor_code, channel_code AS item, indicator_name AS m, value FROM flows UNION ALL SELECT year, donor_code, 12, indicator_name, value FROM flows WHERE channel_code = 2 AND donor_code % 2 = 0),
cells AS (SELECT year, donor_code, CASE item WHEN 1 THEN 'Total ODA' WHEN 3 THEN 'Refugees' ELSE 'Bilateral' END AS i, item, sum(value) AS v FROM raw WHERE item IN (1, 2, 3, 12) AND CASE WHEN year < 1998 OR item = 3 THEN m = 'N' ELSE m = 'A' END GROUP BY ALL),
kept AS (SELECT year, donor_code, i, arg_min(v, item) AS v FROM cells GROUP BY ALL), g AS (SELECT year, donor_code, sum(value) AS v FROM flows WHERE channel_code = 1 AND indicator_name = 'R' GROUP BY ALL),
parts AS (FROM kept UNION ALL SELECT year, donor_code, 'Grants', v FROM g UNION ALL SELECT k.year, k.donor_code, 'Non-grants', k.v - g.v FROM kept k JOIN g USING (year, donor_code) WHERE i = 'Total ODA'),
money AS (SELECT p.year, p.donor_code, i, {", ".join(f"v{'' if v == 'value_usd_current' else f' * t.{v.replace("value", "rate")}'} AS {v}" for v in views.VALUES)} FROM parts p JOIN rates t ON t.donor_code = p.donor_code AND t.year = p.year),
dw AS (SELECT g, code, 1::DECIMAL(3,2) AS w, NULL::INTEGER AS year FROM dl UNION ALL SELECT 'Bloc', n_nationkey, 1, NULL FROM nation WHERE n_nationkey IN {_isin(MEMBERS)} UNION ALL SELECT 'Bloc', 24, CASE WHEN year < 2000 THEN (year - 1990) * 0.1::DECIMAL(3,2) ELSE 1 END, year FROM years),
x AS (SELECT b.year, d.g AS donor_name, i AS indicator_name, {_CASES} FROM money b JOIN dw d ON d.code = donor_code AND coalesce(d.year, b.year) = b.year GROUP BY ALL),
gg AS (SELECT year, g AS donor_name, sum(value) AS gni FROM gni JOIN (FROM dl UNION ALL SELECT 'Bloc', n_nationkey FROM nation WHERE n_nationkey IN {_isin(MEMBERS)}) ON code = donor_code GROUP BY ALL)
SELECT x.year, x.donor_name, x.indicator_name, CASE WHEN x.year < 1998 THEN 'Flows' ELSE 'Grant equivalents' END AS type, {", ".join(f"(round(x.{v}, 2)::DECIMAL(18,2) * 100)::BIGINT AS {v}" for v in views.VALUES)},
  round(x.value_usd_current::DOUBLE / t.value_usd_current::DOUBLE, 6) AS pct_of_total_oda, round(x.value_usd_current::DOUBLE / gg.gni::DOUBLE, 5) AS pct_of_gni
FROM x LEFT JOIN x t ON t.year = x.year AND t.donor_name = x.donor_name AND t.indicator_name = 'Total ODA' LEFT JOIN gg ON gg.year = x.year AND gg.donor_name = x.donor_name""",
    BOTH_SQL,
)
def _(f, spark, sf):
    raw = f.select("year", "donor_code", "donor_name", F.col("channel_code").alias("item_code"), F.element_at(F.create_map(*[F.lit(x) for x in ("N", "net", "A", "grant_equivalent", "R", "grants")]), F.col("indicator_name")).alias("measure"), "value")
    raw = raw.unionByName(raw.where("item_code = 2 and donor_code % 2 = 0").withColumn("item_code", F.lit(12)))
    weights = spark.createDataFrame([(y, Decimal(y - 1990) / 10) for y in range(1990, 2000)], "year int, weight decimal(3,2)")
    return views.whole_financing_view(raw, tables.rates(spark, sf), tables.gni(spark, sf), spark.createDataFrame(list(ITEMS.items()), "code int, name string"), settings(), BLOC, weights, in_donor=[3])


@register(
    "vw2_recipients_weighted",
    f""", b AS (SELECT year, donor_code, recipient_code, indicator_name, {_SUMS} FROM conv GROUP BY ALL), factors AS (SELECT year, CASE WHEN year < 2000 THEN (year - 1990) * 0.1::DECIMAL(3,2) ELSE 1 END AS w FROM years),
dw AS (SELECT g, code, 1::DECIMAL(3,2) AS w, NULL::INTEGER AS year FROM dl WHERE NOT (g = 'All donors' AND code = 24) UNION ALL SELECT 'Bloc', n_nationkey, 1, NULL FROM nation WHERE n_nationkey IN {_isin(MEMBERS)} UNION ALL SELECT g, 24, w::DECIMAL(3,2), year FROM factors, (SELECT unnest(['Bloc', 'All donors']) AS g)),
x AS (SELECT b.year, d.g AS donor_name, r.g AS recipient_name, indicator_name, {_CASES} FROM b JOIN dw d ON d.code = donor_code AND coalesce(d.year, b.year) = b.year JOIN rl r ON r.code = recipient_code GROUP BY ALL)
SELECT x.year, x.donor_name, x.recipient_name, indicator_name, {_UNITS}, round(value_usd_current::DOUBLE / a.t::DOUBLE, 6) AS pct_total_recipient, round(value_usd_current::DOUBLE / c.t::DOUBLE, 6) AS pct_total_donor
FROM x LEFT JOIN (SELECT year, recipient_name, sum(value_usd_current) AS t FROM x WHERE donor_name = 'All donors' GROUP BY ALL) a ON a.year = x.year AND a.recipient_name = x.recipient_name
LEFT JOIN (SELECT year, donor_name, sum(value_usd_current) AS t FROM x WHERE recipient_name = 'All recipients' GROUP BY ALL) c ON c.year = x.year AND c.donor_name = x.donor_name""",
    BOTH_SQL,
)
def _(f, spark, sf):
    weights = spark.createDataFrame([(y, Decimal(y - 1990) / 10) for y in range(1990, 2000)], "year int, weight decimal(3,2)")
    s = dataclasses.replace(settings(), donor_groups=WEIGHTED_DONORS)
    return views.recipients_view(f, tables.rates(spark, sf), s, BLOC, weights)


#: Recipients' attributes as they are classified: a minority of rows puts them into another region, late years and one recipient have no rows.
SEEN_SQL = """seen_rows AS (SELECT recipient_code, year, CASE WHEN channel_code = 7 THEN 'AMERICA' ELSE region END AS region FROM flows WHERE year < 2000 AND recipient_code <> 6
), modal AS (SELECT recipient_code, year, region FROM (SELECT recipient_code, year, region, row_number() OVER (PARTITION BY recipient_code, year ORDER BY count(*) DESC, region) AS k FROM seen_rows GROUP BY recipient_code, year, region) WHERE k = 1
), last_modal AS (SELECT recipient_code, arg_max(region, year) AS region FROM modal GROUP BY ALL
), attr AS (SELECT k.recipient_code, k.year, CASE WHEN l.region IS NULL THEN 'Unnamed' ELSE n_name END AS recipient_name, coalesce(m.region, l.region, 'No region') AS region,
    CASE WHEN l.region IS NULL THEN NULL ELSE CASE k.recipient_code % 4 WHEN 0 THEN 'Low income' WHEN 1 THEN 'Lower middle income' WHEN 2 THEN 'UMIC' END END AS income
  FROM (SELECT DISTINCT recipient_code, year FROM flows) k JOIN nation ON n_nationkey = k.recipient_code LEFT JOIN modal m ON m.recipient_code = k.recipient_code AND m.year = k.year LEFT JOIN last_modal l ON l.recipient_code = k.recipient_code
), rly AS (SELECT recipient_code, year, unnest(list_distinct(list_filter(["""


_RLY_SQL = SEEN_SQL + (
    "'All recipients', recipient_name, income, CASE WHEN region NOT IN ('AFRICA', 'Greater Asia') THEN region END, CASE WHEN region IN ('ASIA', 'MIDDLE EAST', 'Greater Asia') THEN 'Greater Asia' WHEN region = 'AFRICA' THEN 'AFRICA' END"
    + "".join(f", CASE WHEN recipient_code IN {_isin(c)} THEN '{g}' END" for g, c in RECIPIENTS.items())
    + "], lambda q: q IS NOT NULL))) AS g FROM attr)"
)
SENTINELS = {"recipient_name": "Unnamed", "region": "No region"}


def _seen(f):
    return f.where("year < 2000 and recipient_code <> 6").select("recipient_code", "year", "recipient_name", "income_group", F.when(F.col("channel_code") == 7, "AMERICA").otherwise(F.col("region")).alias("region"))


@register(
    "vw3_marker_classified",
    f""", cells AS (SELECT year, donor_code, recipient_code, {_MARKER_SQL} AS indicator_name, sum(value) AS v FROM flows WHERE donor_code <> 2 GROUP BY ALL HAVING sum(value) <> 0),
x AS (SELECT c.year, d.g AS donor_name, r.g AS recipient_name, indicator_name, {", ".join(f"sum(v{'' if v == 'value_usd_current' else f' * t.{v.replace("value", "rate")}'}) AS {v}" for v in views.VALUES)} FROM cells c JOIN rates t ON t.donor_code = c.donor_code AND t.year = c.year JOIN dl d ON d.code = c.donor_code JOIN rly r ON r.recipient_code = c.recipient_code AND r.year = c.year GROUP BY ALL)
SELECT year, donor_name, recipient_name, indicator_name, {_UNITS}, round(value_usd_current::DOUBLE / sum(value_usd_current) OVER (PARTITION BY year, donor_name, recipient_name)::DOUBLE, 6) AS pct_of_total_oda FROM x""",
    BOTH_SQL + ", " + _RLY_SQL,
)
def _(f, spark, sf):
    # Rows and classifications are two views of one pass.
    f = io.stored(f.select("year", "donor_code", "donor_name", "recipient_code", "recipient_name", "region", "income_group", "channel_code", "marker", "value"), "flows")
    raw = f.select("year", "donor_code", "donor_name", "recipient_code", "marker", "value")
    return views.whole_marker_view(raw, tables.rates(spark, sf), _seen(f), settings(), MARKERS, SENTINELS, donors=[k for k in range(25) if k != 2])


@register(
    "vw4_sectors_with_bloc",
    f""", cells AS (
  SELECT 'Bilateral' AS ind, year, donor_code, recipient_code, {SQL_SUB} AS sub, sum(value) AS v, sum(value) AS own FROM flows WHERE indicator_name = 'A' GROUP BY ALL
  UNION ALL SELECT 'Imputed multilateral', year, donor_code, recipient_code, {SQL_SUB}, sum(value), coalesce(sum(value) FILTER (NOT (donor_code IN {_isin(MEMBERS)} AND channel_code IN (2, 3))), 0) FROM flows WHERE indicator_name = 'R' GROUP BY ALL
), known AS (SELECT DISTINCT donor_code FROM flows WHERE indicator_name = 'A'
), given AS (
  SELECT ind, year, g, donor_code, recipient_code, sub, v FROM cells JOIN dl ON code = donor_code WHERE v <> 0 AND donor_code IN (FROM known)
  UNION ALL SELECT ind, year, 'Bloc', donor_code, recipient_code, sub, own FROM cells WHERE own <> 0 AND donor_code IN {_isin((*MEMBERS, *INSTITUTION))}
), x AS (
  SELECT c.year, c.g AS donor_name, r.g AS recipient_name, ind AS indicator_name, sub AS sub_sector_name, {", ".join(f"sum(v{'' if v == 'value_usd_current' else f' * t.{v.replace("value", "rate")}'}) AS {v}" for v in views.VALUES)}
  FROM given c JOIN rates t ON t.donor_code = c.donor_code AND t.year = c.year JOIN rly r ON r.recipient_code = c.recipient_code AND r.year = c.year GROUP BY ALL
), a AS (SELECT year, recipient_name, sum(value_usd_current) AS t FROM x WHERE donor_name = 'All donors' GROUP BY ALL), b AS (SELECT year, donor_name, sum(value_usd_current) AS t FROM x WHERE recipient_name = 'All recipients' GROUP BY ALL)
SELECT x.year, x.donor_name, x.recipient_name, indicator_name, CASE sub_sector_name WHEN 'Food' THEN 'Production' WHEN 'Unallocated/unspecified' THEN 'Unallocated/unspecified' ELSE 'Social' END AS sector_name, sub_sector_name, {_UNITS},
  round(value_usd_current::DOUBLE / a.t::DOUBLE, 6) AS pct_of_recipient, round(value_usd_current::DOUBLE / b.t::DOUBLE, 6) AS pct_of_donor,
  trim(regexp_replace(lower(x.donor_name), '[^a-z0-9]+', '-', 'g'), '-') AS donor_slug, trim(regexp_replace(lower(x.recipient_name), '[^a-z0-9]+', '-', 'g'), '-') AS recipient_slug
FROM x LEFT JOIN a ON a.year = x.year AND a.recipient_name = x.recipient_name LEFT JOIN b ON b.year = x.year AND b.donor_name = x.donor_name""",
    BOTH_SQL + ", " + _RLY_SQL,
)
def _(f, spark, sf):
    part = lambda i: f.where(F.col("indicator_name") == i).select("year", "donor_code", "donor_name", "recipient_code", "channel_code", "purpose_code", "value")
    return views.whole_sectors_view(part("A").drop("channel_code"), part("R").drop("donor_name"), tables.rates(spark, sf), _seen(f), sub_sectors(spark), sectors(spark), settings(), BLOC, SENTINELS)


@register(
    "vw6_purpose_extract",
    "SELECT year, indicator_name, donor_code, donor_name, purpose_code, channel_name, split_part(k, '_', 2) AS currency, split_part(k, '_', 3) AS price, round(v, 2)::DOUBLE AS value FROM (SELECT year, indicator_name, donor_code, donor_name, purpose_code, CASE channel_code WHEN 1 THEN 'Public' WHEN 2 THEN 'Private' ELSE 'Other' END AS channel_name, "
    + ", ".join(f"sum({v})::DECIMAL(38,10) AS {v}" for v in views.VALUES)
    + f" FROM conv GROUP BY ALL) UNPIVOT (v FOR k IN ({', '.join(views.VALUES)}))",
)
def _(f, spark, sf):
    channels = table(spark, [(1, "Public"), (2, "Private")], "code int, name string")
    return views.purpose_extract(f, tables.rates(spark, sf), channels).withColumns(money("value"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
