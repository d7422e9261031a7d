"""Lookups and joins that keep their promises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.io import stored

#: pairs of rows of one key that one task of a salted join makes
PAIRS_PER_TASK = 1_000_000


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """All keys equal, null equal to null; the right side's keys are named ``__key``."""
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"__{k}"])
    return on


def lookup(df: DataFrame, table: DataFrame, key: str, out: str, default: str | None = None, table_key: str = "code", table_value: str = "name") -> DataFrame:
    """The label of a code from a small table; ``default`` for misses."""
    small = table.select(F.col(table_key).alias("__k"), F.col(table_value).alias("__v"))
    value = F.col("__v") if default is None else F.coalesce("__v", F.lit(default))
    return df.join(small, df[key] == F.col("__k"), "left").withColumn(out, value).drop("__k", "__v")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def many_to_one_join(df: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that can't add rows: repeated keys of ``dim`` are an error. Null keys match null keys."""
    if repeated_keys(dim, keys).limit(1).count():
        raise ValueError(f"the keys {', '.join(keys)} repeat on the one side")
    right = dim.withColumnsRenamed({k: f"__{k}" for k in keys})
    return df.join(right, null_safe(df, right, keys), "left").drop(*[f"__{k}" for k in keys])


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """Inner join in which no key makes more than ``pairs_per_task`` pairs in one task.

    Rows of each key are counted on both sides first. A key with too many pairs is cut
    into so many salts: its right rows are dealt over them by their other columns, its
    left rows are repeated for each. All other keys have one salt. Null keys don't match.
    """
    on = list(on)
    count = lambda df, name: df.groupBy(*on).agg(F.count("*").alias(name))
    pairs = F.col("__left") * F.col("__right")
    salts = F.least(F.ceil(pairs / pairs_per_task), F.col("__right")).cast("int")
    hot = stored(count(left, "__left").join(count(right, "__right"), on).where(pairs > pairs_per_task).select(*on, salts.alias("__salts")), "salts")
    n = F.coalesce("__salts", F.lit(1))
    rest = [F.col(c) for c in right.columns if c not in on]
    dealt = right.join(hot, on, "left").withColumn("__salt", F.pmod(F.xxhash64(*rest) if rest else F.lit(0), n).cast("int")).drop("__salts")
    repeated = left.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("__salts")
    return repeated.join(dealt, [*on, "__salt"]).drop("__salt")


def checked_join(df: DataFrame, dim: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """:func:`many_to_one_join`, written to the shared folder; ValueError where rows or the total of ``value`` have changed.

    Both are observed on either side of the join while the result is written, without
    a further scan. A task that ran twice may count twice, so numbers that differ are
    taken from the tables once more before an error is raised.
    """
    right = dim.withColumnsRenamed({k: f"__{k}" for k in keys})
    before, after = Observation(), Observation()
    of = lambda: (F.count(F.lit(1)).alias("rows"), F.sum(value).cast("double").alias("total"))
    seen = df.observe(before, *of())
    joined = seen.join(right, null_safe(seen, right, keys), "left").drop(*[f"__{k}" for k in keys])
    out = stored(joined.observe(after, *of()), "joined")
    # A left join of no rows has none; what is written tells so without making the rows again.
    a, b = (o.get if not out.isEmpty() else {"rows": 0, "total": None} for o in (before, after))
    near = a["total"] == b["total"] or (None not in (a["total"], b["total"]) and abs(a["total"] - b["total"]) <= max(1e-6, abs(a["total"]) * 1e-9))
    if a["rows"] != b["rows"] or not near:
        row = same_total(df, out, value).first()
        if not row["same"]:
            raise ValueError(f"the join on {', '.join(keys)} changed {row['rows_before']} rows, total {row['total_before']}, to {row['rows_after']} rows, total {row['total_after']}")
    return out


def same_total(before: DataFrame, after: DataFrame, value: str) -> Column:
    """Whether rows and total agree, as one row (rows_before, rows_after, total_before, total_after, same)."""
    a = before.agg(F.count("*").alias("rows_before"), F.sum(value).cast("double").alias("total_before"))
    b = after.agg(F.count("*").alias("rows_after"), F.sum(value).cast("double").alias("total_after"))
    near = F.abs(F.col("total_before") - F.col("total_after")) <= F.greatest(F.lit(1e-6), F.abs("total_before") * 1e-9)
    return a.join(F.broadcast(b)).withColumn("same", (F.col("rows_before") == F.col("rows_after")) & F.coalesce(near, F.lit(True)))


def combine_measures(base: DataFrame, *others: DataFrame, on: Sequence[str], zero: Sequence[str] = ()) -> DataFrame:
    """Left joins of measure tables; the columns in ``zero`` are 0 where they miss."""
    out = base
    for other in others:
        out = out.join(other, list(on), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero}) if zero else out


def resolve_code_duplicates(df: DataFrame, keys: Sequence[str], code_col: str, value: str, raise_error: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, conflicts) where several codes share a name: per key the row of the smallest code stays.

    conflicts holds the keys whose non-null values disagree; with ``raise_error`` they
    are a ValueError that names the first five.
    """
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(code_col))
    kept = df.withColumn("__n", first).where("__n = 1").drop("__n")
    conflicts = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct(value).alias("n_values")).where("n_values > 1")
    if raise_error and (bad := conflicts.orderBy(*keys).limit(5).collect()):
        raise ValueError(f"codes that share a name have different values: {'; '.join(', '.join(f'{k}={r[k]}' for k in keys) for r in bad)}")
    return kept, conflicts


def entity_diff(current: DataFrame, previous: DataFrame, dim: str) -> DataFrame:
    """(entity, change): entities new in or removed from the current release."""
    sides = current.select(F.col(dim).alias("entity"), F.lit(1).alias("now"), F.lit(0).alias("was")).unionAll(previous.select(F.col(dim).alias("entity"), F.lit(0).alias("now"), F.lit(1).alias("was")))
    seen = sides.where("entity is not null").groupBy("entity").agg(F.max("now").alias("now"), F.max("was").alias("was"))
    return seen.where("now <> was").select("entity", F.when(F.col("now") == 1, F.lit("new")).otherwise(F.lit("removed")).alias("change"))
