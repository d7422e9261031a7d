"""The driver tables as flow tables: who gives what to whom, when and for what."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

YEARS = (1995, 2001)
CURRENCY_STEP = {"usd": 0, "cad": 1, "eur": 2, "gbp": 3}
PRICE_STEP = {"current": 0, "constant": 2}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions: the customer's nation gives, the supplier's nation receives.

    Lines take what part and supplier say and orders their donor before the two meet, so
    that lines are dealt by their order once, as codes and a value; names come last.
    """
    t = lambda name: read(spark, sf_dir, name)
    donor = t("nation").select(F.col("n_nationkey").alias("donor_code"), F.col("n_name").alias("donor_name"))
    income = F.element_at(F.array(F.lit("LIC"), F.lit("LMIC"), F.lit("UMIC"), F.lit(None)), (F.col("n_nationkey") % 4 + 1).cast("int"))
    # What follows from the recipient is made for each nation, not for each line.
    recipient = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("recipient_code"), F.col("n_name").alias("recipient_name"), F.col("r_name").alias("region"), income.alias("income_group"))
    lines = (
        t("lineitem")
        .select("l_orderkey", "l_partkey", "l_suppkey", F.year("l_shipdate").alias("year"), "l_returnflag", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("value"))
        .join(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("recipient_code")), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    )
    given = t("orders").join(t("customer").select("c_custkey", F.col("c_nationkey").alias("donor_code"), "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return (
        lines.join(given, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(donor, "donor_code")
        .join(recipient, "recipient_code")
        .select(
            "year", "donor_code", "donor_name", "recipient_code", "recipient_name", "region", "income_group", F.col("l_returnflag").alias("indicator_name"), F.col("p_size").alias("purpose_code"),
            F.col("l_linenumber").alias("channel_code"), F.col("o_orderpriority").alias("marker"), F.col("c_mktsegment").alias("segment"), "value",
        )
    )


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(donor_code, year, rate_{currency}_{price}): one wide row per donor and year."""
    grid = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("donor_code"), F.explode(F.sequence(F.lit(YEARS[0]), F.lit(YEARS[1]))).alias("year"))
    return grid.select(
        "donor_code", "year",
        *[((100 + 7 * k + F.col("donor_code") % 5 + (F.col("year") - YEARS[0]) * p).cast("decimal(10,4)") * F.lit(0.01).cast("decimal(4,2)")).alias(f"rate_{c}_{price}") for c, k in CURRENCY_STEP.items() for price, p in PRICE_STEP.items()],
    )


def gni(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, donor_code, donor_name, value): the customers' balances stand in for national income."""
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("donor_code")).agg(F.sum(F.abs("c_acctbal").cast("decimal(18,2)")).alias("value"))
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("donor_code"), F.col("n_name").alias("donor_name"))
    return c.join(n, "donor_code").withColumn("year", F.explode(F.sequence(F.lit(YEARS[0]), F.lit(YEARS[1])))).select("year", "donor_code", "donor_name", "value")


FLOWS_SQL = """
flows AS (
  SELECT year(l_shipdate)::INTEGER AS year, c_nationkey AS donor_code, d.n_name AS donor_name, s_nationkey AS recipient_code, r.n_name AS recipient_name, r_name AS region,
         CASE s_nationkey % 4 WHEN 0 THEN 'LIC' WHEN 1 THEN 'LMIC' WHEN 2 THEN 'UMIC' END AS income_group, l_returnflag AS indicator_name, p_size AS purpose_code,
         l_linenumber AS channel_code, o_orderpriority AS marker, c_mktsegment AS segment, (l_extendedprice * (1 - l_discount))::DECIMAL(18,4) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  JOIN nation d ON d.n_nationkey = c_nationkey JOIN nation r ON r.n_nationkey = s_nationkey JOIN region ON r.n_regionkey = r_regionkey
), years AS (SELECT unnest(range(1995, 2002))::INTEGER AS year
), gni AS (
  SELECT year, n_nationkey AS donor_code, n_name AS donor_name, sum(abs(c_acctbal)::DECIMAL(18,2)) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey, years GROUP BY ALL
), rates AS (
  SELECT n_nationkey AS donor_code, year, """ + ", ".join(
    f"(100 + {7 * k} + n_nationkey % 5 + (year - 1995) * {p})::DECIMAL(10,4) * 0.01::DECIMAL(4,2) AS rate_{c}_{price}" for c, k in CURRENCY_STEP.items() for price, p in PRICE_STEP.items()
) + """
  FROM nation, years
), conv AS (
  SELECT f.*, """ + ", ".join(
    f"f.value * r.rate_{c}_{price} AS value_{c}_{price}" if (c, price) != ("usd", "current") else "f.value::DECIMAL(32,10) AS value_usd_current" for c in sorted(CURRENCY_STEP) for price in sorted(PRICE_STEP)
) + """
  FROM flows f JOIN rates r ON f.donor_code = r.donor_code AND f.year = r.year
)"""
