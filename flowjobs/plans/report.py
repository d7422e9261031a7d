"""Topic reports: small tables from views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import groups as G
from ..operators.filters import latest_year_rows
from ..operators.reshape import derive_measure, pivot_measures
from ..operators.shares import pct_change, ratio, share_of_gni, share_of_group_total


def pinned_order(name: Column, pinned: str, *rest: Column) -> list[Column]:
    """One entity first, then the rest."""
    return [F.when(name == pinned, 0).otherwise(1).asc(), *rest]


def ranked(df: DataFrame, order: Sequence[Column], out: str = "position") -> DataFrame:
    """Rows of a small report with their place in a total order."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(*order)))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def first_names(name: str, k: int = 20) -> Column:
    """The first ``k`` names and how many more there are; an aggregate."""
    names = F.sort_array(F.collect_set(name))
    more = F.size(names) - k
    return F.concat(F.array_join(F.slice(names, 1, k), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(F.lit("")))


def aid_mix(df: DataFrame, parts: Sequence[str], total: str = "total", aggregate: str | None = None, missing: str | None = None) -> DataFrame:
    """Total less its named parts as ``other`` per year and donor; absent parts count as 0.

    ``aggregate`` names a donor whose part ``missing`` is not reported: it is the sum of
    all other donors' that year.
    """
    if aggregate and missing:
        members = df.where(F.col("donor_name") != aggregate).groupBy("year").agg(F.sum(missing).alias("__sum"))
        df = df.join(members, "year", "left").withColumn(missing, F.when((F.col("donor_name") == aggregate) & F.col(missing).isNull(), F.col("__sum")).otherwise(F.col(missing))).drop("__sum")
    rest = F.col(total)
    for p in parts:
        rest = rest - F.coalesce(p, F.lit(0))
    return df.withColumn("other", rest)


def headline(totals: DataFrame, year: int) -> DataFrame:
    """One year's total, its change on the row before and both as text. ``totals`` has year, donor_name, value in millions."""
    changed = pct_change(totals, ["donor_name"]).where(F.col("year") == year)
    return changed.select("year", "donor_name", "value", "pct_change", S.format_amount(F.col("value")).alias("value_text"), S.format_percent(F.abs("pct_change") * 100).alias("change_text"), F.when(F.col("pct_change") < 0, "fell").otherwise("rose").alias("direction"))


def gni_gap(totals: DataFrame, gni: DataFrame, target: float = 0.7) -> DataFrame:
    return share_of_gni(totals, gni, target=target)


def gni_table(totals: DataFrame, gni: DataFrame, blank: str | None = None) -> DataFrame:
    """Value and share of income, years descending, then share descending, then name, as positions."""
    shares = share_of_gni(totals, gni)
    if blank is not None:
        shares = shares.withColumn("pct_of_gni", S.blank_for(F.col("donor_name"), blank, F.col("pct_of_gni")))
    return ranked(shares, [F.desc("year"), F.desc_nulls_last("pct_of_gni"), F.asc("donor_name")])


def group_share_series(df: DataFrame, name_col: str, name: str, keys: Sequence[str] = ("year",)) -> DataFrame:
    """One group's share of all, by year."""
    both = df.groupBy(*keys).agg(G.zero_sum(F.when(F.col(name_col) == name, F.col("value"))).alias("value"), G.zero_sum("value").alias("total"))
    return both.withColumn("share", ratio(F.col("value"), F.col("total"), 4))


def split_latest(df: DataFrame, by: str) -> DataFrame:
    """The latest year's values by an attribute, with shares."""
    latest = G.sum_by(latest_year_rows(df), ["year", by])
    return share_of_group_total(latest, ["year"], "share", places=4)


def country_series(df: DataFrame, recipient: str, everyone: str) -> DataFrame:
    """One recipient's flows by donor and year, and all donors' together first."""
    rows = G.sum_by(df.where(F.col("recipient_name") == recipient), ["year", "donor_name"])
    return G.append_total_entity(rows, ["year"], "donor_name", everyone)


def non_part(df: DataFrame, index: Sequence[str], total: str, part: str, new: str, measure: str = "indicator_name") -> DataFrame:
    """A third measure from two: total less a part (Total - Grants = Non-grants)."""
    return derive_measure(df, index, measure, [total, part], new, F.col(total) - F.coalesce(part, F.lit(0)))


def measures_by_donor(df: DataFrame, names: Sequence[str], measure: str = "indicator_name") -> DataFrame:
    return pivot_measures(df, ["year", "donor_name"], measure, names)


def part_series(df: DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    """Value of each part (a sector, say) per key and its share of all parts, null parts among them."""
    return share_of_group_total(G.sum_by(df, [*keys, part]), keys, "share", places=4)


def part_shares_wide(df: DataFrame, part: str, parts: Sequence[str], everyone: str) -> DataFrame:
    """Shares of some parts of each donor's and of all donors' value, a column for each part. Shares are of all parts."""
    rows = G.append_total_entity(G.sum_by(df, ["year", "donor_name", part]), ["year", part], "donor_name", everyone)
    shares = share_of_group_total(rows, ["year", "donor_name"], "share", places=4)
    return shares.groupBy("year", "donor_name").agg(*[F.max(F.when(F.col(part) == p, F.col("share"))).alias(p) for p in parts])


def gni_key_number(totals: DataFrame, gni: DataFrame, year: int, target: float = 0.007) -> DataFrame:
    """One year's share of income, what lacks to the target (negative above it), and the share's change on the row before."""
    both = totals.select("year", "donor_name", F.col("value").cast("double").alias("value")).join(gni.select("year", "donor_name", F.col("value").cast("double").alias("gni")), ["year", "donor_name"])
    both = both.withColumns({"oda_gni": ratio(F.col("value"), F.col("gni"), 6), "distance": F.round(F.col("gni") * target - F.col("value"), 1)})
    changed = pct_change(both, ["donor_name"], value="oda_gni", out="centre", places=4)
    return changed.where(F.col("year") == year).select("year", "donor_name", "oda_gni", "distance", "centre")


def gni_series(totals: DataFrame, gni: DataFrame, first: str, blank: str | None = None) -> DataFrame:
    """Value and share of income by year, one donor's rows first; ``blank`` names a donor whose share says nothing."""
    shares = share_of_gni(totals, gni)
    if blank is not None:
        shares = shares.withColumn("pct_of_gni", S.blank_for(F.col("donor_name"), blank, F.col("pct_of_gni")))
    return ranked(shares, pinned_order(F.col("donor_name"), first, F.asc("year"), F.asc("donor_name")))


def recipient_total(before: DataFrame, after: DataFrame, imputed: DataFrame, cutoff: int, everyone: str) -> DataFrame:
    """All flows to a recipient by donor: one bilateral measure up to ``cutoff``, another from it on, and imputed flows; all donors' sum under one more name."""
    parts = before.where(F.col("year") <= cutoff).unionByName(after.where(F.col("year") >= cutoff)).unionByName(imputed)
    return G.append_total_entity(G.sum_by(parts, ["year", "donor_name"]), ["year"], "donor_name", everyone)


def total_less_parts(total: DataFrame, parts: Mapping[str, DataFrame], everyone: str, own_sum: Sequence[str] = (), preliminary: int | None = None) -> DataFrame:
    """A total beside its parts and what is left of it, per year and donor, ``everyone`` first.

    The tables have year, donor_name and value; a part that a donor lacks is 0. For the
    parts in ``own_sum`` the row of ``everyone`` takes the sum of the other donors in the
    latest year. What is left in the year ``preliminary`` stands in a column of its own.
    """
    keys = ["year", "donor_name"]
    out = total.select(*keys, F.col("value").alias("total"))
    for name, part in parts.items():
        out = out.join(part.select(*keys, F.col("value").alias(name)), keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    for name in own_sum:
        others = out.where(F.col("donor_name") != everyone).groupBy("year").agg(F.sum(name).alias("__sum"))
        last = out.agg(F.max("year").alias("__last"))
        mine = (F.col("donor_name") == everyone) & (F.col("year") == F.col("__last"))
        out = out.join(others, "year", "left").join(F.broadcast(last)).withColumn(name, F.when(mine, F.coalesce("__sum", F.lit(0))).otherwise(F.col(name))).drop("__sum", "__last")
    left = F.col("total")
    for name in parts:
        left = left - F.col(name)
    out = out.withColumn("other", F.round(left, 1))
    if preliminary is not None:
        this = F.col("year") == preliminary
        out = out.withColumns({"preliminary": F.when(this, F.col("other")), "other": F.when(~this, F.col("other"))})
    return ranked(out, pinned_order(F.col("donor_name"), everyone, F.asc("year"), F.asc("donor_name")))


def ordered_totals(totals: DataFrame, value: str = "value", *ties: str) -> DataFrame:
    """Rows of a small table with their place, the largest value first."""
    return ranked(totals, [F.desc_nulls_last(value), *[F.asc_nulls_last(t) for t in ties]])
