"""Whole views: from flows to published tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import add_slug, normalize_unspecified
from ..functions.scalars import flow_type, to_units
from ..operators import classify, currency, groups, shares
from ..operators.filters import assert_mapped, marker_rows
from ..operators.joins import lookup, resolve_code_duplicates
from ..sources.io import stored

VALUES = currency.value_columns()


@dataclass
class Settings:
    """What a view needs besides flows. All of it is an argument, nothing is built in."""

    donor_groups: Mapping[str, Sequence]
    recipient_labels: Column | None = None
    reference_donor: str = "All donors"
    reference_recipient: str = "All recipients"
    total_indicator: str = "Total ODA"
    cutoff: int = 2018
    #: units in one unit of the flows' values
    factor: int = 1_000_000


@dataclass(frozen=True)
class Bloc:
    """Members and the institutions that they pay for in part, as one donor without counting that money twice."""

    name: str
    members: Sequence
    institutions: Sequence
    #: channels through which members fund the institutions
    channels: Sequence = ()


def _drop_empty(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Zero means absent: zero cells are null, rows without any value go."""
    out = df.withColumns({v: F.nullif(F.col(v), F.lit(0)) for v in values})
    return out.where(F.coalesce(*values).isNotNull())


def _zero_null_sums(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sums of non-zero cells: a total that nets to 0 stays, one without cells is null."""
    return df.groupBy(*keys).agg(*[F.sum(F.nullif(F.col(v), F.lit(0))).alias(v) for v in values])


def _published(df: DataFrame, keys: Sequence[str], extra: Sequence[str], factor: int) -> DataFrame:
    return df.select(*keys, *[to_units(F.col(v), factor).alias(v) for v in VALUES], *extra)


def financing_view(flows: DataFrame, rates: DataFrame, gni: DataFrame, s: Settings) -> DataFrame:
    """Donor totals by indicator with shares of the total indicator and of national income.

    Converted first, then summed into groups; a total that nets to 0 vanishes.
    """
    keys = ["year", "indicator_name"]
    base = groups.sum_by(flows, [*keys, "donor_code", "donor_name"])
    # The total indicator is the sum of all of them, made before conversion since rates are the donor's own.
    all_in = groups.sum_by(base, ["year", "donor_code", "donor_name"]).withColumn("indicator_name", F.lit(s.total_indicator))
    wide = currency.convert_currencies(base.unionByName(all_in), rates)
    labels = F.array_append(groups.donor_labels(s.donor_groups), F.col("donor_name"))
    summed = _drop_empty(groups.exploded_totals(wide, labels, keys, "donor_name", VALUES, ["donor_code", "donor_name"]), VALUES)
    summed = shares.share_of_indicator(summed, s.total_indicator, ["year", "donor_name"], "pct_of_total_oda", "value_usd_current")
    incomes = shares.gni_with_groups(gni, groups.donor_labels(s.donor_groups))
    summed = shares.share_of_gni(summed, incomes, value="value_usd_current").withColumn("type", flow_type(F.col("year"), s.cutoff))
    return _published(summed, ["year", "donor_name", "indicator_name", "type"], ["pct_of_total_oda", "pct_of_gni"], s.factor)


@dataclass(frozen=True)
class Measures:
    """Names of the measures that a financing table has side by side."""

    before: str = "net"
    after: str = "grant_equivalent"
    grants: str = "grants"


def whole_financing_view(
    rows: DataFrame, rates: DataFrame, gni: DataFrame, items: DataFrame, s: Settings, bloc: Bloc, weights: DataFrame, in_donor: Sequence = (), measures: Measures = Measures(), names: tuple[str, str] = ("Grants", "Non-grants")
) -> DataFrame:
    """The financing view from raw items: two measures spliced at the cutoff, shared names resolved, grants split off.

    ``rows`` has year, donor_code, donor_name, item_code, measure and value; ``items``
    (code, name) the indicators, other items are left out. Items in ``in_donor`` keep
    the first measure in all years. Of codes that share a name the smallest counts;
    values that disagree are a ValueError. The total indicator's grants, and what is left
    of its spliced value without them, are two more indicators, where both are known.
    The bloc takes its institutions by ``weights`` (year, weight). Rows are read in one
    pass, for both measures and the grants.
    """
    named = lookup(rows, items, "item_code", "indicator_name").where("indicator_name is not null")
    stays = F.col("item_code").isin(list(in_donor)) if in_donor else F.lit(False)
    early = (F.col("year") < s.cutoff) | stays
    spliced = ((F.col("measure") == measures.before) & early) | ((F.col("measure") == measures.after) & ~early)
    granted = (F.col("measure") == measures.grants) & (F.col("indicator_name") == s.total_indicator)
    keys = ["year", "donor_code", "donor_name", "indicator_name"]
    # Kept: the few rows that items have been summed to.
    cells = stored(named.where(spliced | granted).groupBy(*keys, "item_code").agg(F.sum(F.when(spliced, F.col("value"))).alias("value"), F.sum(F.when(granted, F.col("value"))).alias("granted")), "items")
    kept, _ = resolve_code_duplicates(cells.where("value is not null"), keys, "item_code", "value", raise_error=True)
    split = cells.where(F.col("indicator_name") == s.total_indicator).groupBy("year", "donor_code", "donor_name").agg(F.sum("granted").alias("granted"), F.sum("value").alias("value"))
    parts = F.array(F.struct(F.lit(names[0]).alias("indicator_name"), F.col("granted").alias("value")), F.struct(F.lit(names[1]).alias("indicator_name"), (F.col("value") - F.col("granted")).alias("value")))
    parts = split.select("year", "donor_code", "donor_name", F.explode(parts).alias("p")).select("year", "donor_code", "donor_name", "p.*").where("value is not null")
    wide = currency.convert_currencies(kept.select(*keys, "value").unionByName(parts), rates)
    labels = F.array_append(groups.donor_labels(s.donor_groups), F.col("donor_name"))
    summed = _drop_empty(groups.with_weighted_totals(*_memberships(wide, labels, s, bloc, weights, reference=False), None, ["year", "indicator_name"], VALUES), VALUES)
    summed = shares.share_of_indicator(summed, s.total_indicator, ["year", "donor_name"], "pct_of_total_oda", "value_usd_current")
    incomes = shares.gni_with_groups(gni, groups.donor_labels({**s.donor_groups, bloc.name: bloc.members}))
    summed = shares.share_of_gni(summed, incomes, value="value_usd_current").withColumn("type", flow_type(F.col("year"), s.cutoff))
    return _published(summed, ["year", "donor_name", "indicator_name", "type"], ["pct_of_total_oda", "pct_of_gni"], s.factor)


def recipients_view(flows: DataFrame, rates: DataFrame, s: Settings, bloc: Bloc | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Donors and recipients with all their aggregates, and shares of both reference entities' totals.

    With ``bloc``, its members and institutions are one more donor, and the
    institutions also feed the reference donor's total. ``weights`` (year, weight) has
    the share of the institutions' flows that members have not funded; both sums take
    the institutions by it, by 1 in years without one, and their own rows in full.
    """
    keys = ["year", "indicator_name"]
    base = groups.sum_by(flows, [*keys, "donor_code", "donor_name", "recipient_code", "recipient_name", "region", "income_group"])
    wide = currency.convert_currencies(base.withColumn("recipient_name", normalize_unspecified(F.col("recipient_name"))), rates)
    donors = groups.donor_labels(s.donor_groups)
    if bloc is None:
        every = groups.with_all_totals(wide, donors, s.recipient_labels, keys, VALUES)
    else:
        every = groups.with_weighted_totals(*_memberships(wide, F.array_append(donors, F.col("donor_name")), s, bloc, weights), F.array_append(s.recipient_labels, F.col("recipient_name")), keys, VALUES)
    every = _drop_empty(every, VALUES)
    every = shares.share_of_reference_total(every, "donor_name", s.reference_donor, ["year", "recipient_name"], "pct_total_recipient", "value_usd_current")
    every = shares.share_of_reference_total(every, "recipient_name", s.reference_recipient, ["year", "donor_name"], "pct_total_donor", "value_usd_current")
    return _published(every, ["year", "donor_name", "recipient_name", "indicator_name"], ["pct_total_recipient", "pct_total_donor"], s.factor)


def _memberships(df: DataFrame, labels: Column, s: Settings, bloc: Bloc, weights: DataFrame, reference: bool = True) -> tuple[DataFrame, Column]:
    """Rows, and for each the donors that it counts for, as an array of (name, weight): plain labels, the bloc and, if ``reference``, the reference donor."""
    small = weights.select(F.col("year").alias("__y"), F.col("weight").alias("__w"))
    kind = weights.schema["weight"].dataType
    one = F.lit(1).cast(kind)
    pairs = lambda *of: F.array(*[F.struct(n.alias("name"), w.alias("weight")) for n, w in of])
    none = F.filter(pairs((F.lit(""), one)), lambda _: F.lit(False))
    share = F.coalesce("__w", one)
    is_in = lambda codes: F.coalesce(F.col("donor_code").isin(list(codes)), F.lit(False))
    plain = F.transform(labels, lambda x: F.struct(x.alias("name"), one.alias("weight")))
    funded = F.when(is_in(bloc.institutions), pairs(*[(F.lit(n), share) for n in (bloc.name, *([s.reference_donor] if reference else []))])).otherwise(none)
    paying = F.when(is_in(bloc.members), pairs((F.lit(bloc.name), one))).otherwise(none)
    joined = df.join(small, df["year"] == F.col("__y"), "left")
    return joined, F.concat(plain, funded, paying)


def marker_view(flows: DataFrame, rates: DataFrame, s: Settings) -> DataFrame:
    """Scores of a policy marker, which partition a whole: each row's share of all scores. ``indicator_name`` is the score."""
    keys = ["year", "indicator_name"]
    base = groups.sum_by(flows, [*keys, "donor_code", "donor_name", "recipient_code", "recipient_name", "region", "income_group"])
    return _marker_shares(currency.convert_currencies(base, rates), s)


def whole_marker_view(rows: DataFrame, rates: DataFrame, classified: DataFrame, s: Settings, labels: Mapping, sentinels: Mapping[str, str], marker: str = "marker", donors: Sequence | None = None, recipients: Sequence | None = None) -> DataFrame:
    """The marker view from raw rows (year, donor_code, donor_name, recipient_code, the marker's score, value).

    Scores outside ``labels`` are a ValueError, null scores are left out. Recipients
    take their name, region and income group from ``classified``, as in
    :func:`whole_sectors_view`.
    """
    # Kept: the few sums by score that both the check and the view read.
    cells = ["year", "donor_code", "donor_name", "recipient_code", marker]
    known = stored(groups.sum_by(rows.where(F.col(marker).isNotNull()), cells), "scores")
    named = marker_rows(assert_mapped(known, marker, list(labels)), marker, dict(labels), donors, recipients)
    base = groups.sum_by(named, ["year", "indicator_name", "donor_code", "donor_name", "recipient_code"]).where("value <> 0")
    dim = stored(classify.modal_classification(classified, ["recipient_code", "year"], ["recipient_name", "region", "income_group"]), "recipients")
    return _marker_shares(currency.convert_currencies(classify.add_recipient_classifications(base, dim, sentinels), rates), s)


def _marker_shares(wide: DataFrame, s: Settings) -> DataFrame:
    """All groups' sums and each score's share of a row's scores, from converted rows."""
    keys = ["year", "indicator_name"]
    labels = [F.array_sort(F.array_append(x, F.col(n))).alias(a) for x, n, a in ((groups.donor_labels(s.donor_groups), "donor_name", "__d"), (s.recipient_labels, "recipient_name", "__r"))]
    fine = _zero_null_sums(wide.select(*keys, *labels, *VALUES), [*keys, "__d", "__r"], VALUES)
    every = groups.repeat_for(groups.repeat_for(fine, F.col("__d"), "donor_name"), F.col("__r"), "recipient_name")
    every = every.groupBy(*keys, "donor_name", "recipient_name").agg(*[F.sum(v).alias(v) for v in VALUES]).where(F.coalesce(*VALUES).isNotNull())
    every = shares.share_of_group_total(every, ["year", "donor_name", "recipient_name"], "pct_of_total_oda", "value_usd_current")
    return _published(every, ["year", "donor_name", "recipient_name", "indicator_name"], ["pct_of_total_oda"], s.factor)


def sectors_view(flows: DataFrame, rates: DataFrame, sub_sectors: DataFrame, sectors: DataFrame, s: Settings, unallocated: str = "Unallocated/unspecified", slugs: bool = True) -> DataFrame:
    """The largest view: sub-sectors, all donor and recipient aggregates, both shares, slugs to partition by.

    Purposes turn into sub-sectors before anything is summed; sums are made to the
    finest key before rows are repeated for their groups; the group-by over the
    exploded labels is the only large shuffle besides the first.
    """
    named = lookup(flows, sub_sectors, "purpose_code", "sub_sector_name", unallocated)
    named = lookup(named, sectors, "sub_sector_name", "sector_name", unallocated)
    keys = ["year", "indicator_name", "sub_sector_name", "sector_name"]
    base = groups.sum_by(named, [*keys, "donor_code", "donor_name", "recipient_code", "recipient_name", "region", "income_group"])
    wide = currency.convert_currencies(base, rates)
    every = groups.with_all_totals(wide, groups.donor_labels(s.donor_groups), s.recipient_labels, keys, VALUES)
    every = every.where(F.coalesce(*VALUES).isNotNull())
    every = shares.share_of_reference_total(every, "donor_name", s.reference_donor, ["year", "recipient_name"], "pct_of_recipient", "value_usd_current")
    every = shares.share_of_reference_total(every, "recipient_name", s.reference_recipient, ["year", "donor_name"], "pct_of_donor", "value_usd_current")
    extra = ["pct_of_recipient", "pct_of_donor"]
    if slugs:
        for name, code, labels in (("donor_name", ["donor_code"], groups.donor_labels(s.donor_groups)), ("recipient_name", ["recipient_code", "region", "income_group"], s.recipient_labels)):
            # Names come from the sums before rows are repeated: entities and their groups.
            named = groups.repeat_for(base.select(*code, name).distinct(), F.array_append(labels, F.col(name)), "__n").select(F.col("__n").alias(name))
            every = add_slug(every, name, name.replace("_name", "_slug"), named)
        extra += ["donor_slug", "recipient_slug"]
    return _published(every, ["year", "donor_name", "recipient_name", "indicator_name", "sector_name", "sub_sector_name"], extra, s.factor)


def tagged_sectors(bilateral: DataFrame, imputed: DataFrame, sub_sectors: DataFrame, bloc: Bloc, labels: tuple[str, str] = ("Bilateral", "Imputed multilateral"), unallocated: str = "Unallocated/unspecified") -> DataFrame:
    """(year, donor_code, donor_name, recipient_code, sub_sector_name, indicator_name, in_main, in_bloc, value), zero cells left out.

    Both tables have year, donor_code, recipient_code, purpose_code and value;
    ``bilateral`` also donor_name, ``imputed`` channel_code. An imputed cell counts in
    full for its donor; for the bloc, without what members route through its channels.
    Where the two differ the cell is two rows with one tag each, else one row with
    both. Imputed rows take their donor's name from the bilateral side; those of donors
    that it lacks count for the bloc alone.
    """
    cell = ["year", "donor_code", "recipient_code", "sub_sector_name"]
    is_in = lambda codes, c="donor_code": F.coalesce(F.col(c).isin(list(codes)), F.lit(False))
    ours = is_in([*bloc.members, *bloc.institutions])
    given = groups.sum_by(lookup(bilateral, sub_sectors, "purpose_code", "sub_sector_name", unallocated), [*cell, "donor_name"])
    given = given.where("value <> 0").withColumns({"indicator_name": F.lit(labels[0]), "in_main": F.lit(True), "in_bloc": ours})

    routed = is_in(bloc.members) & is_in(bloc.channels, "channel_code")
    part = lookup(imputed, sub_sectors, "purpose_code", "sub_sector_name", unallocated).withColumn("__kept", F.when(routed, F.lit(0)).otherwise(F.col("value")))
    part = groups.sum_by(part, cell, "value", "__kept")
    names = bilateral.groupBy(F.col("donor_code").alias("__code")).agg(F.min("donor_name").alias("donor_name"))
    part = part.join(names, part["donor_code"] == F.col("__code"), "left").drop("__code")
    same, main = F.col("value") == F.col("__kept"), F.col("donor_name").isNotNull() & (F.col("value") != 0)
    row = lambda in_main, in_bloc, value: F.struct(in_main.alias("in_main"), in_bloc.alias("in_bloc"), F.col(value).alias("value"))
    rows = F.array(row(main, ours & same & (F.col("value") != 0), "value"), row(F.lit(False), ours & ~same & (F.col("__kept") != 0), "__kept"))
    part = part.withColumn("__t", F.explode(F.filter(rows, lambda t: t["in_main"] | t["in_bloc"]))).select(*cell, "donor_name", F.lit(labels[1]).alias("indicator_name"), "__t.*")
    return given.unionByName(part)


def whole_sectors_view(
    bilateral: DataFrame, imputed: DataFrame, rates: DataFrame, classified: DataFrame, sub_sectors: DataFrame, sectors: DataFrame, s: Settings, bloc: Bloc, sentinels: Mapping[str, str], unallocated: str = "Unallocated/unspecified"
) -> DataFrame:
    """The sectors view with its imputed half and the bloc.

    ``classified`` has rows (recipient_code, year, recipient_name, region,
    income_group), several for a key if need be: the most common value counts, a year
    without rows takes the recipient's last one, what is still null its sentinel.
    Bilateral, imputed and corrected rows are one table whose tags choose their labels,
    so there is one conversion, one explosion and one group-by over labels for all.
    """
    if bloc.name in s.donor_groups:
        raise ValueError(f"{bloc.name} is a plain donor group as well")
    attributes = ["recipient_name", "region", "income_group"]
    rows = tagged_sectors(bilateral, imputed, sub_sectors, bloc, unallocated=unallocated)
    rows = classify.add_recipient_classifications(rows, classify.modal_classification(classified, ["recipient_code", "year"], attributes), sentinels)
    wide = currency.convert_currencies(rows, rates)
    none = F.array().cast("array<string>")
    donors = F.concat(F.when(F.col("in_main"), F.array_append(groups.donor_labels(s.donor_groups), F.col("donor_name"))).otherwise(none), F.when(F.col("in_bloc"), F.array(F.lit(bloc.name))).otherwise(none))
    keys = ["year", "indicator_name", "sub_sector_name"]
    labels = [F.array_sort(donors).alias("__d"), F.array_sort(F.array_append(s.recipient_labels, F.col("recipient_name"))).alias("__r")]
    # Written once: the view's rows and the two lists of names for slugs come from it.
    fine = stored(_zero_null_sums(wide.select(*keys, *labels, *VALUES), [*keys, "__d", "__r"], VALUES), "sectors")
    every = groups.repeat_for(groups.repeat_for(fine, F.col("__d"), "donor_name"), F.col("__r"), "recipient_name")
    every = every.groupBy(*keys, "donor_name", "recipient_name").agg(*[F.sum(v).alias(v) for v in VALUES]).where(F.coalesce(*VALUES).isNotNull())
    every = lookup(every, sectors, "sub_sector_name", "sector_name", unallocated)
    every = shares.share_of_reference_total(every, "donor_name", s.reference_donor, ["year", "recipient_name"], "pct_of_recipient", "value_usd_current")
    every = shares.share_of_reference_total(every, "recipient_name", s.reference_recipient, ["year", "donor_name"], "pct_of_donor", "value_usd_current")
    for name, label in (("donor_name", "__d"), ("recipient_name", "__r")):
        every = add_slug(every, name, name.replace("_name", "_slug"), fine.select(F.explode(label).alias(name)))
    return _published(every, ["year", "donor_name", "recipient_name", "indicator_name", "sector_name", "sub_sector_name"], ["pct_of_recipient", "pct_of_donor", "donor_slug", "recipient_slug"], s.factor)


def purpose_extract(flows: DataFrame, rates: DataFrame, channels: DataFrame, keys: Sequence[str] = ("year", "indicator_name", "donor_code", "donor_name", "purpose_code", "channel_name")) -> DataFrame:
    """Partner extract at purpose level, long by currency and price base."""
    named = lookup(flows, channels, "channel_code", "channel_name", "Other")
    wide = currency.convert_currencies(groups.sum_by(named, keys), rates)
    return currency.to_long(wide, [*keys])
