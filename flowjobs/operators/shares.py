"""Changes and shares. Denominators come from windows or small joined sums; zero denominators give null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import null_safe


def ratio(a: Column, b: Column, places: int | None = 6) -> Column:
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if places is None else F.round(out, places)


def pct_change(df: DataFrame, partition: Sequence[str], order: str = "year", value: str = "value", out: str = "pct_change", places: int | None = 6) -> DataFrame:
    """Change on the row before, which may be years ago; null for the first row."""
    last = F.lag(value).over(Window.partitionBy(*partition).orderBy(order))
    return df.withColumn(out, ratio(F.col(value) - last, last, places))


def share_of_group_total(df: DataFrame, keys: Sequence[str], out: str, value: str = "value", places: int = 6) -> DataFrame:
    """Value over the total of its own group: one shuffle, no self-join."""
    return df.withColumn(out, ratio(F.col(value), F.sum(value).over(Window.partitionBy(*keys)), places))


def share_of_small_totals(df: DataFrame, keys: Sequence[str], out: str, value: str = "value", where: Column | None = None, places: int = 6) -> DataFrame:
    """The same by an aggregate and a null-safe join, for skewed keys: sums are made map-side and only totals move."""
    source = df if where is None else df.where(where)
    totals = source.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.sum(value).alias("__total"))
    joined = df.join(totals, null_safe(df, totals, keys), "left")
    return joined.withColumn(out, ratio(F.col(value), F.col("__total"), places)).drop("__total", *[f"__{k}" for k in keys])


def share_of_reference_total(df: DataFrame, filter_col: str, reference: str, keys: Sequence[str], out: str, value: str = "value", places: int = 6) -> DataFrame:
    """Value over the reference entity's total of all indicators in the same group; null where it has none.

    A window, so that the plan above is made once. Its groups hold aggregated rows;
    for groups of raw rows use :func:`share_of_small_totals` with ``where``.
    """
    total = F.sum(F.when(F.col(filter_col) == reference, F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn(out, ratio(F.col(value), total, places))


def share_of_indicator(df: DataFrame, indicator: str, keys: Sequence[str], out: str, value: str = "value", indicator_col: str = "indicator_name", places: int = 6) -> DataFrame:
    """Value over the same key's row of one indicator."""
    whole = F.max(F.when(F.col(indicator_col) == indicator, F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn(out, ratio(F.col(value), whole, places))


def add_gni(df: DataFrame, gni: DataFrame, out: str = "gni", keys: Sequence[str] = ("year", "donor_name")) -> DataFrame:
    """National income by year and donor, aggregate donors included where the table has them."""
    small = gni.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("value").alias(out))
    return df.join(small, null_safe(df, small, keys), "left").drop(*[f"__{k}" for k in keys])


def gni_with_groups(gni: DataFrame, labels: Column) -> DataFrame:
    """The incomes of donors and the summed incomes of their groups. ``gni`` has year, donor_code, donor_name, value."""
    rows = gni.withColumn("donor_name", F.explode(F.array_append(labels, F.col("donor_name"))))
    return rows.groupBy("year", "donor_name").agg(F.sum("value").alias("value"))


def share_of_gni(df: DataFrame, gni: DataFrame, out: str = "pct_of_gni", value: str = "value", target: float | None = None) -> DataFrame:
    """Value over national income, 5 places; with ``target``, also percent and the shortfall to it, 0 at least."""
    df = add_gni(df, gni, "__gni")
    df = df.withColumn(out, ratio(F.col(value), F.col("__gni"), 5))
    if target is not None:
        percent = ratio(F.col(value), F.col("__gni"), None) * 100
        df = df.withColumns({"gni_percent": F.round(percent, 2), "shortfall": F.greatest(F.round((F.lit(target) - percent) / 100 * F.col("__gni").cast("double"), 2), F.lit(0.0))})
    return df.drop("__gni")


def sector_year_share(df: DataFrame, out: str = "year_total", value: str = "value", year_col: str = "year") -> DataFrame:
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(year_col)))


def order_by_total(df: DataFrame, key: str, value: str = "value", out: str = "rank") -> DataFrame:
    """Each key's rank by its total over all rows, largest first, ties by name. The ranking is of keys, not rows."""
    totals = df.groupBy(F.col(key).alias("__k")).agg(F.sum(value).alias("__t"))
    ranked = totals.withColumn(out, F.row_number().over(Window.orderBy(F.desc("__t"), F.asc_nulls_last("__k"))))
    return df.join(ranked, df[key].eqNullSafe(F.col("__k")), "left").drop("__k", "__t")
