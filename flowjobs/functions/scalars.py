"""Column expressions: units, formats, labels, keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import finite  # noqa: F401  (part of this module's functions)


def to_units(c: Column, factor: int = 1_000_000) -> Column:
    """Millions to whole units, as bigint."""
    return F.round(c * F.lit(factor)).cast("bigint")


def to_millions(c: Column, factor: int = 1_000_000) -> Column:
    return F.try_divide(c.cast("double"), F.lit(float(factor)))


def rounded(c: Column, places: int, half_even: bool = False) -> Column:
    return F.bround(c, places) if half_even else F.round(c, places)


def narrow_integers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column as int if its largest magnitude fits, else bigint. Costs one pass over the data."""
    top = df.agg(*[F.max(F.abs(F.col(c).cast("decimal(38,0)"))).alias(c) for c in columns]).first()
    return df.withColumns({c: F.col(c).cast("int" if top[c] is None or top[c] <= 2_147_483_647 else "bigint") for c in columns})


def flow_type(year: Column, cutoff: int, before: str = "Flows", after: str = "Grant equivalents") -> Column:
    return F.when(year < cutoff, F.lit(before)).otherwise(F.lit(after))


def blank_for(name: Column, entity: str, c: Column) -> Column:
    """``c``, null for one entity."""
    return F.when(name.eqNullSafe(F.lit(entity)), None).otherwise(c)


def format_percent(c: Column, places: int = 1) -> Column:
    return F.concat(F.format_number(c, places), F.lit("%"))


def format_amount(millions: Column) -> Column:
    """"1.23 billion" from 1000 million on, else "12.3 million"."""
    return F.when(millions >= 1000, F.concat(F.format_number(millions / 1000, 2), F.lit(" billion"))).otherwise(F.concat(F.format_number(millions, 1), F.lit(" million")))


def join_key(*parts: Column, sep: str = "|") -> Column:
    return F.concat_ws(sep, *parts)


def split_key(key: Column, sep: str = "|") -> tuple[Column, Column]:
    """What stands before and after the first separator."""
    at = F.instr(key, sep)
    return F.when(at > 0, F.substr(key, F.lit(1), at - 1)).otherwise(key), F.when(at > 0, F.substr(key, at + len(sep)))


def key_numbers(df: DataFrame, indicator: str, id_col: str, value_cols: Sequence[str]) -> DataFrame:
    """One row: {indicator: {id: {column: text}}} as nested maps."""
    texts = F.create_map(*[x for c in value_cols for x in (F.lit(c), F.col(c).cast("string"))])
    by_id = df.where(F.col(id_col).isNotNull()).groupBy().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(id_col).cast("string").alias("id"), F.map_entries(texts).alias("v"))))).alias("m"))
    return by_id.select(F.create_map(F.lit(indicator), F.transform_values("m", lambda _, v: F.map_from_entries(v))).alias("numbers"))


def merge_numbers(old: Column, new: Column) -> Column:
    """Both maps together; where they share a key the new one wins."""
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)
