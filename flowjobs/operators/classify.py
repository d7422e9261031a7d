"""Attributes of recipients: one value per key, and filling gaps from the latest year."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def modal_classification(df: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Per key each attribute's most common non-null value, the smallest on a tie, null if there is none."""
    return df.groupBy(*keys).agg(*[F.mode(a, True).alias(a) for a in attributes])


def ambiguous_keys(df: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Keys for which some attribute has several values."""
    counts = df.groupBy(*keys).agg(*[F.count_distinct(a).alias(f"n_{a}") for a in attributes])
    return counts.where(F.greatest(*[F.col(f"n_{a}") for a in attributes], F.lit(0)) > 1)


def add_recipient_classifications(df: DataFrame, classified: DataFrame, sentinels: Mapping[str, str], attributes: Sequence[str] = ("recipient_name", "region", "income_group"), code_col: str = "recipient_code", year_col: str = "year") -> DataFrame:
    """Attributes by (recipient, year); a year without a row takes the recipient's last row as it is, null or not.

    What is still null gets its sentinel; an attribute without one stays null.
    """
    dim = classified.select(F.col(code_col).alias("__c"), F.col(year_col).alias("__y"), F.struct(*attributes).alias("__now"))
    last = classified.groupBy(F.col(code_col).alias("__lc")).agg(F.max_by(F.struct(*attributes), year_col).alias("__last"))
    joined = df.join(dim, (df[code_col] == F.col("__c")) & (df[year_col] == F.col("__y")), "left").join(last, df[code_col] == F.col("__lc"), "left")
    picked = F.coalesce("__now", "__last")
    values = {a: (F.coalesce(picked[a], F.lit(sentinels[a])) if a in sentinels else picked[a]) for a in attributes}
    return joined.withColumns(values).drop("__c", "__y", "__now", "__lc", "__last")
