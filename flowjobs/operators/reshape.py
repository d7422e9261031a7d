"""Pivots, unions, splices and filling in absent rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pivot_measures(df: DataFrame, index: Sequence[str], measure: str, names: Sequence[str], value: str = "value") -> DataFrame:
    """One column per measure; the names are given, so no job looks for them."""
    return df.groupBy(*index).pivot(measure, list(names)).agg(F.sum(value))


def unpivot_measures(df: DataFrame, index: Sequence[str], names: Sequence[str], measure: str, value: str = "value") -> DataFrame:
    return df.unpivot(list(index), list(names), measure, value)


def derive_measure(df: DataFrame, index: Sequence[str], measure: str, names: Sequence[str], new: str, expr: Column, value: str = "value") -> DataFrame:
    """Measures as columns, a new one from them, and back to rows; absent ones stay absent."""
    wide = pivot_measures(df, index, measure, names, value).withColumn(new, expr)
    return unpivot_measures(wide, index, [*names, new], measure, value).where(F.col(value).isNotNull())


def year_by_group_table(df: DataFrame, group: str, names: Sequence[str], value: str = "value", year_col: str = "year") -> DataFrame:
    """One row per year and one summed column per group; absent is null."""
    return df.groupBy(year_col).pivot(group, list(names)).agg(F.sum(value))


def union_by_name(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def splice(df: DataFrame, measure: str, before: str, after: str, cutoff: int, always_before: Sequence[str] = (), item_col: str | None = None, year_col: str = "year") -> DataFrame:
    """One series from two measures: ``before`` up to the year before ``cutoff``, ``after`` from then on.

    Items in ``always_before`` keep the first measure in all years. The data is read
    once, and no year is in both parts.
    """
    stays = F.col(item_col).isin(list(always_before)) if item_col and always_before else F.lit(False)
    early = (F.col(year_col) < cutoff) | stays
    return df.where(((F.col(measure) == before) & early) | ((F.col(measure) == after) & ~early))


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def fill_missing(df: DataFrame, years: tuple[int, int], series: Sequence[str], fill: Mapping[str, object], year_col: str = "year") -> DataFrame:
    """A row for every year and every series that occurs, with ``fill`` where there was none; no series is made up."""
    grid = df.select(*series).distinct().withColumn(year_col, F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))))
    right = df.withColumnsRenamed({c: f"__{c}" for c in [*series, year_col]})
    on = grid[year_col] == right[f"__{year_col}"]
    for c in series:
        on = on & grid[c].eqNullSafe(right[f"__{c}"])
    out = grid.join(right, on, "left")
    rest = [c for c in df.columns if c not in (*series, year_col)]
    return out.select(year_col, *series, *[(F.coalesce(c, F.lit(fill[c])) if c in fill else F.col(c)).alias(c) for c in rest])
