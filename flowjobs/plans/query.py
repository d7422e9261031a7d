"""Drill-down queries over published views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import to_millions
from ..operators.groups import sum_by, zero_sum


def drill_down(view: DataFrame, donor: str, indicators: Sequence[str], currency: str, price: str, years: tuple[int, int], recipient: str | None = None, shares: Sequence[str] = ()) -> DataFrame:
    """One donor's rows in millions of one currency and price base; no indicators, no rows."""
    keep = (F.col("donor_name") == donor) & F.col("indicator_name").isin(list(indicators)) & F.col("year").between(*years)
    if recipient is not None:
        keep = keep & (F.col("recipient_name") == recipient)
    names = ["year", "donor_name", *(["recipient_name"] if recipient is not None else []), "indicator_name"]
    return view.where(keep).select(*names, to_millions(F.col(f"value_{currency}_{price}")).alias("value"), *shares)


def sector_series(view: DataFrame, donor: str | None, recipient: str | None, indicators: Sequence[str], currency: str, price: str, years: tuple[int, int] | None = None, combined: str = "Total") -> DataFrame:
    """Values, US dollar values and both shares by year, donor, recipient, sector and sub-sector; several indicators become one under ``combined``. None asks for all donors, recipients or years."""
    rows = view.where(F.col("indicator_name").isin(list(indicators)))
    for name, wanted in (("donor_name", donor), ("recipient_name", recipient)):
        rows = rows if wanted is None else rows.where(F.col(name) == wanted)
    if years is not None:
        rows = rows.where(F.col("year").between(*years))
    if len(indicators) > 1:
        rows = rows.withColumn("indicator_name", F.lit(combined))
    values = {"value": f"value_{currency}_{price}", "value_usd": f"value_usd_{price}"}
    rows = rows.withColumns({k: F.col(v) for k, v in values.items()})
    out = sum_by(rows, ["year", "donor_name", "recipient_name", "indicator_name", "sector_name", "sub_sector_name"], "value", "value_usd", "pct_of_donor", "pct_of_recipient")
    return out.withColumns({"value": to_millions(F.col("value")), "value_usd": to_millions(F.col("value_usd"))})


def sector_totals(series: DataFrame, other: str = "Other") -> DataFrame:
    """Total per sector and indicator; rows without a sector are ``other``. Order by value for display."""
    return series.groupBy(F.coalesce("sector_name", F.lit(other)).alias("sector_name"), "indicator_name").agg(zero_sum("value").alias("value"))


def collapse_years(series: DataFrame, breakdown: Sequence[str] = (), measures: Sequence[str] = ("value", "value_usd", "pct_of_donor", "pct_of_recipient")) -> DataFrame:
    """Sub-sectors rolled up to one row per year and breakdown; null adds nothing."""
    return series.groupBy("year", *breakdown).agg(*[F.sum(F.coalesce(m, F.lit(0))).alias(m) for m in measures])


def unit_value(unit: str, value: Column, denominators: dict[str, Column]) -> Column:
    """The measure to show: the value itself, or a percentage of the unit's denominator; null stays null."""
    if unit == "value":
        return value
    if unit not in denominators:
        raise ValueError(f"unknown unit {unit!r}: value, {', '.join(denominators)}")
    return F.try_divide(value.cast("double"), denominators[unit].cast("double")) * 100


def unit_select(df: DataFrame, unit: str, value: str = "value", denominators: dict[str, str] | None = None, out: str = "shown") -> DataFrame:
    return df.withColumns({out: unit_value(unit, F.col(value), {k: F.col(v) for k, v in (denominators or {}).items()}), "unit": F.lit(unit)})
