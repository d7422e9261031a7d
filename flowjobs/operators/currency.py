"""Currency and price conversion, wide and long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CURRENCIES = ("cad", "eur", "gbp", "usd")
PRICES = ("constant", "current")


def value_columns(currencies: Sequence[str] = CURRENCIES, prices: Sequence[str] = PRICES) -> list[str]:
    return [f"value_{c}_{p}" for c in sorted(currencies) for p in sorted(prices)]


def convert_currencies(df: DataFrame, rates: DataFrame, value: str = "value", currencies: Sequence[str] = CURRENCIES, base: str = "usd") -> DataFrame:
    """``value`` (base currency, current prices) as one column for each currency and price base.

    ``rates`` has donor_code, year and a column ``rate_{currency}_{price}`` each; the
    base currency at current prices needs none. A row is multiplied by its own
    donor's and year's rates, which come by one join of a small table: rows aren't
    repeated eight times. Convert before totals are built, never after.
    """
    names = {f"value_{c}_{p}": f"rate_{c}_{p}" for c in sorted(currencies) for p in PRICES}
    small = rates.select(F.col("donor_code").alias("__d"), F.col("year").alias("__y"), *[r for v, r in names.items() if v != f"value_{base}_current"])
    joined = df.join(small, (df["donor_code"] == F.col("__d")) & (df["year"] == F.col("__y")), "left")
    values = {v: (F.col(value) if v == f"value_{base}_current" else F.col(value) * F.col(r)) for v, r in names.items()}
    return joined.withColumns(values).drop("__d", "__y", *[r for r in names.values()], value)


def to_long(df: DataFrame, index: Sequence[str], columns: Sequence[str] | None = None, value: str = "value") -> DataFrame:
    """Wide value columns as rows (currency, price, value)."""
    columns = list(columns or value_columns())
    long = df.unpivot(list(index), columns, "__c", value)
    parts = F.split("__c", "_")
    return long.withColumns({"currency": parts[1], "price": parts[2]}).drop("__c").select(*index, "currency", "price", value)


def widen_currency_price(df: DataFrame, index: Sequence[str], value: str = "value", places: int = 4) -> DataFrame:
    """Rows (currency, price, value) as wide columns in sorted order: values are rounded, then summed per key."""
    names = value_columns()
    rows = df.withColumns({"__c": F.concat_ws("_", F.lit("value"), "currency", "price"), "__v": F.round(value, places)})
    return rows.groupBy(*index).pivot("__c", names).agg(F.sum("__v")).select(*index, *names)
