"""Imputed multilateral flows and purpose-level sums. The formulas are this library's own definition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import sum_by
from .joins import PAIRS_PER_TASK, salted_join


def channel_spending_shares(spend: DataFrame, window: int = 3, by: Sequence[str] = ("purpose_code", "recipient_code"), channel: str = "channel_code", year_col: str = "year", value: str = "value") -> DataFrame:
    """Each channel's spending by purpose and recipient as a share of its total, both summed over the last ``window`` years.

    A year counts where the channel spent anything in it; items that only occur
    earlier in the window have their share too.
    """
    items = sum_by(spend, [channel, year_col, *by], value)
    active = items.select(channel, F.col(year_col).alias("__to")).distinct()
    spread = items.withColumn("__to", F.explode(F.sequence(F.col(year_col), F.col(year_col) + window - 1)))
    smoothed = sum_by(spread.join(active, [channel, "__to"]), [channel, "__to", *by], value)
    total = F.sum(value).over(Window.partitionBy(channel, "__to"))
    share = F.round(F.try_divide(F.col(value).cast("double"), total.cast("double")), 9)
    return smoothed.withColumn("share", share).withColumnRenamed("__to", year_col).select(channel, year_col, *by, "share")


def imputed_multilateral(contributions: DataFrame, shares: DataFrame, keys: Sequence[str], channel: str = "channel_code", year_col: str = "year", value: str = "value", pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """Core contributions spread by their channel's shares. Contributions are summed to (donor, channel, year) before the join.

    A channel that dominates is cut into salts by its measured size, see :func:`joins.salted_join`.
    """
    donors = [k for k in keys if k not in shares.columns]
    given = sum_by(contributions, list(dict.fromkeys([*donors, channel, year_col])), value)
    spread = salted_join(given, shares, [channel, year_col], pairs_per_task).withColumn(value, F.col(value) * F.col("share"))
    return sum_by(spread, keys, value)


def purpose_group_totals(df: DataFrame, level: str, labels: Mapping[str, DataFrame], keys: Sequence[str], by_recipient: bool = False, value: str = "value") -> DataFrame:
    """Sums at purpose, sector or broad-sector level. ``labels`` has a table (code, name) for each level above purpose."""
    if level != "purpose" and level not in labels:
        raise ValueError(f"unknown level {level!r}: purpose, {', '.join(labels)}")
    out, col = df, "purpose_code"
    if level != "purpose":
        table = labels[level].select(F.col("code").alias("__k"), F.col("name").alias(level))
        out, col = df.join(table, df["purpose_code"] == F.col("__k"), "left").drop("__k"), level
    return sum_by(out, [*keys, *(["recipient_code"] if by_recipient else []), col], value)


def latest_year_topic_totals(df: DataFrame, topics: Mapping[str, Sequence | None], donor: str = "donor_name", code_col: str = "purpose_code", value: str = "value", year_col: str = "year") -> DataFrame:
    """(topic, donor, value) of the latest year, all topics in one pass. A topic of None takes all rows; a donor without rows is absent."""
    from .filters import latest_year_rows

    rows = latest_year_rows(df, year_col)
    listed = F.array(*[F.when(F.lit(True) if codes is None else F.col(code_col).isin(list(codes)), F.lit(t)) for t, codes in topics.items()])
    named = rows.withColumn("topic", F.explode(F.filter(listed, lambda t: t.isNotNull())))
    return sum_by(named, ["topic", donor], value)
