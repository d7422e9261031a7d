"""Names: spelling rules, slugs, overrides, and code groups turned around."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: How a trailing "regional" and a bare "unspecified" are found, and what stands for both: fixed values.
REGIONAL, UNSPECIFIED, NORMAL = r",?\s+regional$", r"(?<!,)\s+unspecified$", ", unspecified"


def normalize_unspecified(name: Column) -> Column:
    """A trailing "regional" or bare "unspecified" becomes ", unspecified"."""
    return F.regexp_replace(F.regexp_replace(name, REGIONAL, NORMAL), UNSPECIFIED, NORMAL)


@F.pandas_udf(T.StringType())
def slugs(names: pd.Series) -> pd.Series:
    """Spark has no NFKD: Python works it out, each distinct name of a batch once."""
    codes, distinct = pd.factorize(names)
    plain = pd.Series([unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode().lower() for n in distinct], dtype=object)
    made = plain.str.replace(r"[^a-z0-9]+", "-", regex=True).str.strip("-") if len(plain) else plain
    return pd.Series([made[c] if c >= 0 else None for c in codes], dtype=object)


def add_slug(df: DataFrame, name_col: str, out: str, names: DataFrame | None = None) -> DataFrame:
    """Slug of each name, null for null. Python sees each distinct name once, never the rows.

    ``names`` is a table whose column ``name_col`` holds all names, where it is at hand
    for less than the distinct names of ``df`` cost.
    """
    table = (df if names is None else names).select(F.col(name_col).alias("__name")).where("__name is not null").distinct()
    table = table.select("__name", slugs("__name").alias(out))
    return df.join(table, df[name_col] == F.col("__name"), "left").drop("__name")


def slug_collisions(df: DataFrame, name_col: str, slug_col: str) -> DataFrame:
    """(slug, names) of slugs that stand for several names."""
    return df.where(F.col(name_col).isNotNull()).groupBy(F.col(slug_col).alias("slug")).agg(F.sort_array(F.collect_set(name_col)).alias("names")).where(F.size("names") > 1)


def check_slugs(df: DataFrame, name_col: str, slug_col: str) -> DataFrame:
    """``df`` itself, or ValueError where two names share a slug."""
    bad = slug_collisions(df, name_col, slug_col).orderBy("slug").limit(5).collect()
    if bad:
        raise ValueError("names share a slug: " + "; ".join(f"{r.slug}: {', '.join(r.names)}" for r in bad))
    return df


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of literal rows whose size Spark knows, so that joins to it are broadcast by its own check."""
    import pyarrow as pa

    types = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(",")]
    columns = [pa.array([r[i] for r in rows], types[kind]) for i, (_, kind) in enumerate(fields)]
    return spark.createDataFrame(pa.table(columns, names=[name for name, _ in fields]))


def groups_table(spark: SparkSession, groups: Mapping[str, Sequence], code_type: str = "int") -> DataFrame:
    """(position, group_name, member_code) of named code lists, in their order."""
    rows = [(i, name, code) for i, (name, codes) in enumerate(groups.items()) for code in codes]
    return small_table(spark, rows, f"position int, group_name string, member_code {code_type}")


def invert_groups(groups: DataFrame) -> DataFrame:
    """(member_code, group_name): of several groups with a code the last one in order."""
    return groups.groupBy("member_code").agg(F.max_by("group_name", "position").alias("group_name"))


def override_names(df: DataFrame, names: DataFrame, code_col: str, name_col: str) -> DataFrame:
    """``names`` (code, name) replaces a name where it has the code; other rows keep theirs."""
    table = names.select(F.col("code").alias("__code"), F.col("name").alias("__name"))
    return df.join(table, df[code_col] == F.col("__code"), "left").withColumn(name_col, F.coalesce("__name", name_col)).drop("__code", "__name")
