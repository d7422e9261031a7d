"""Row filters and small row rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_members(df: DataFrame, code_col: str, members: DataFrame | Sequence) -> DataFrame:
    """Rows whose code is in a list, or in the member_code column of a table."""
    if isinstance(members, DataFrame):
        return df.join(members.select(F.col("member_code").alias("__m")), df[code_col] == F.col("__m"), "left_semi")
    return df.where(F.col(code_col).isin(list(members)))


def exclude_rows(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which not all conditions hold; an unknown condition does not hold."""
    both = F.lit(True)
    for c in conditions:
        both = both & F.coalesce(c, F.lit(False))
    return df.where(~both)


def drop_null_or_zero(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & (F.col(value) != 0))


def latest_year_rows(df: DataFrame, year_col: str = "year") -> DataFrame:
    """Rows of the greatest year. One number is joined; the data isn't moved."""
    last = df.agg(F.max(year_col).alias("__last"))
    return df.join(F.broadcast(last), df[year_col] == F.col("__last")).drop("__last")


def unmapped_values(df: DataFrame, col: str, known: Sequence) -> DataFrame:
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(list(known))).select(col).distinct()


def assert_mapped(df: DataFrame, col: str, known: Sequence) -> DataFrame:
    """``df`` itself, or ValueError where the column has values outside ``known``."""
    bad = [r[0] for r in unmapped_values(df, col, known).limit(5).collect()]
    if bad:
        raise ValueError(f"unmapped values in {col}: {bad}")
    return df


def preliminary_split(df: DataFrame, year: int, other: str = "other", out: str = "preliminary", year_col: str = "year") -> DataFrame:
    """The value of ``other`` in one year moves to a column of its own."""
    latest = F.col(year_col) == year
    return df.withColumns({out: F.when(latest, F.col(other)), other: F.when(latest, None).otherwise(F.col(other))})


def marker_rows(df: DataFrame, marker_col: str, labels: dict, donors: Sequence | None = None, recipients: Sequence | None = None, out: str = "indicator_name") -> DataFrame:
    """Rows of every score of a policy marker, labelled, in one scan; scores outside ``labels`` are left out."""
    df = df.where(F.col(marker_col).isin(list(labels)))
    if donors is not None:
        df = df.where(F.col("donor_code").isin(list(donors)))
    if recipients is not None:
        df = df.where(F.col("recipient_code").isin(list(recipients)))
    label = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return df.withColumn(out, F.element_at(label, F.col(marker_col)))
