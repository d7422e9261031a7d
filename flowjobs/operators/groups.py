"""Sums and group totals. A row may feed many groups; all groups are summed in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def zero_sum(c: str | Column) -> Column:
    """A sum that is 0 where there is nothing to sum."""
    return F.coalesce(F.sum(c), F.lit(0))


def sum_by(df: DataFrame, keys: Sequence[str], *values: str) -> DataFrame:
    """Sums per key; null keys are keys."""
    return df.groupBy(*keys).agg(*[zero_sum(v).alias(v) for v in values or ("value",)])


def group_total(df: DataFrame, members: Sequence, code_col: str, keys: Sequence[str], name_col: str, name: str, values: Sequence[str] = ("value",)) -> DataFrame:
    """The members of a code list summed into one named row per key."""
    return sum_by(df.where(F.col(code_col).isin(list(members))), keys, *values).withColumn(name_col, F.lit(name)).select(*keys, name_col, *values)


def attribute_total(df: DataFrame, attribute: str, keys: Sequence[str], name_col: str, labels: DataFrame | None = None, values: Sequence[str] = ("value",)) -> DataFrame:
    """Sums by an attribute of the rows, relabelled by ``labels`` (code, name); unmapped values keep their own label."""
    out = sum_by(df, [*keys, attribute], *values)
    if labels is not None:
        small = labels.select(F.col("code").alias("__k"), F.col("name").alias("__v"))
        out = out.join(small, out[attribute] == F.col("__k"), "left").withColumn(attribute, F.coalesce("__v", attribute)).drop("__k", "__v")
        out = sum_by(out, [*keys, attribute], *values)
    return out.withColumnRenamed(attribute, name_col).select(*keys, name_col, *values)


def labels_of(code: Column, groups: Mapping[str, Sequence]) -> Column:
    """Array of the groups whose code list has the code. Group lists are arguments: a few names each."""
    return F.filter(F.array(*[F.when(code.isin(list(codes)), F.lit(g)) for g, codes in groups.items()]), lambda g: g.isNotNull())


def repeat_for(df: DataFrame, labels: Column, name: str) -> DataFrame:
    """A row for each of its labels, in the column ``name``; rows without labels go, null labels stay.

    Not a plain explode: from that the optimizer infers a filter on the labels' number,
    which it carries below the sums, so that labels are made for each raw row.
    """
    out = df.withColumn("__label", F.explode_outer(F.transform(labels, lambda x: F.struct(x.alias("name")))))
    return out.where("__label is not null").withColumn(name, F.col("__label.name")).drop("__label")


def exploded_totals(df: DataFrame, labels: Column, keys: Sequence[str], name_col: str, values: Sequence[str] = ("value",), by: Sequence[str] = ()) -> DataFrame:
    """One group-by over all groups that rows belong to.

    Rows are first summed to the keys and to ``by``, the columns that the labels are
    made of; only the few rows left get labels and are repeated for each of them.
    """
    fine = sum_by(df, list(dict.fromkeys([*keys, *by])), *values)
    return sum_by(repeat_for(fine, labels, "__name").select(*keys, F.col("__name").alias(name_col), *values), [*keys, name_col], *values)


def donor_labels(groups: Mapping[str, Sequence], code_col: str = "donor_code") -> Column:
    return labels_of(F.col(code_col), groups)


def donor_group_totals(df: DataFrame, groups: Mapping[str, Sequence], keys: Sequence[str], code_col: str = "donor_code", name_col: str = "donor_name", values: Sequence[str] = ("value",), bloc: tuple[str, Sequence, Sequence] | None = None) -> DataFrame:
    """Totals of all groups; with ``bloc`` (name, members, institutions) the plain sum of both as one more, for data in which no money is in both."""
    if bloc is not None:
        groups = {**groups, bloc[0]: [*bloc[1], *bloc[2]]}
    return exploded_totals(df, donor_labels(groups, code_col), keys, name_col, values, [code_col])


def recipient_labels(
    overall: str, groups: Mapping[str, Sequence], rollup: Mapping[str, str], code_col: str = "recipient_code", region_col: str = "region", income_col: str | None = "income_group", income_labels: Mapping[str, str] | None = None
) -> Column:
    """Array of all aggregates that a recipient row feeds.

    The overall total; its income group; its region unless that is itself named like
    a continent; its continent (``rollup`` maps regions to continents; a region named
    like a continent counts there once; unmapped regions have none); its code lists.
    """
    region = F.col(region_col)
    continents = sorted(set(rollup.values()))
    to_continent = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in rollup.items() for x in kv]), region), F.when(region.isin(continents), region))
    parts = [F.lit(overall), F.when(~region.isin(continents), region), to_continent]
    if income_col:
        income = F.col(income_col)
        named = F.element_at(F.create_map(*[F.lit(x) for kv in income_labels.items() for x in kv]), income) if income_labels else F.lit(None)
        parts.append(F.coalesce(named, income))
    return F.array_distinct(F.concat(F.filter(F.array(*parts), lambda x: x.isNotNull()), labels_of(F.col(code_col), groups)))


def recipient_group_totals(
    df: DataFrame, labels: Column, keys: Sequence[str], name_col: str = "recipient_name", values: Sequence[str] = ("value",), by: Sequence[str] = ("recipient_code", "region", "income_group")
) -> DataFrame:
    """``by`` names the columns that ``labels`` is made of."""
    return exploded_totals(df, labels, keys, name_col, values, by)


def with_all_totals(df: DataFrame, donors: Column, recipients: Column, keys: Sequence[str], values: Sequence[str] = ("value",), donor_name: str = "donor_name", recipient_name: str = "recipient_name") -> DataFrame:
    """Rows and all their donor and recipient aggregates, in one group-by over the product of both label sets."""
    own = [F.array_sort(F.array_append(donors, F.col(donor_name))).alias("__d"), F.array_sort(F.array_append(recipients, F.col(recipient_name))).alias("__r")]
    # Entities with the same labels and another name stay apart; those that share all labels meet before they are repeated.
    fine = df.select(*keys, *own, *values).groupBy(*keys, "__d", "__r").agg(*[zero_sum(v).alias(v) for v in values])
    exploded = repeat_for(repeat_for(fine, F.col("__d"), donor_name), F.col("__r"), recipient_name)
    return sum_by(exploded, [*keys, donor_name, recipient_name], *values)


def with_weighted_totals(df: DataFrame, donors: Column, recipients: Column | None, keys: Sequence[str], values: Sequence[str] = ("value",), donor_name: str = "donor_name", recipient_name: str = "recipient_name") -> DataFrame:
    """Sums over all pairs of a row's donors and recipients, one group-by for all.

    ``donors`` is an array of (name, weight): what a row counts for, and by how much.
    ``recipients`` is an array of names; with None there are donors alone. A row may
    count for one name several times.
    """
    pairs, names = repeat_for(df, donors, "__d"), {donor_name: "__d.name"}
    if recipients is not None:
        pairs, names = repeat_for(pairs, F.array_distinct(recipients), "__r"), names | {recipient_name: "__r"}
    weight = pairs.schema["__d"].dataType["weight"].dataType

    def times(v: str) -> Column:
        # A decimal product of over 38 digits loses digits behind the point; sums don't need so many before it.
        kind = df.schema[v].dataType
        if isinstance(kind, T.DecimalType) and isinstance(weight, T.DecimalType):
            return F.col(v).cast(T.DecimalType(min(kind.precision, 37 - weight.precision), kind.scale)) * F.col("__d.weight")
        return F.col(v) * F.col("__d.weight")

    weighted = pairs.select(*keys, *[F.col(c).alias(n) for n, c in names.items()], *[times(v).alias(v) for v in values])
    return sum_by(weighted, [*keys, *names], *values)


def bloc_total(bilateral: DataFrame, imputed: DataFrame, members: Sequence, channels: Sequence, keys: Sequence[str], name: str, values: Sequence[str] = ("value",), name_col: str = "donor_name") -> DataFrame:
    """Members' and institutions' bilateral rows, and imputed rows but those that members route through the institutions' channels."""
    own = bilateral.where(F.col("donor_code").isin(list(members)))
    routed = F.coalesce(F.col("donor_code").isin(list(members)) & F.col("channel_code").isin(list(channels)), F.lit(False))
    other = imputed.where(F.col("donor_code").isin(list(members)) & ~routed)
    both = own.select(*keys, *values).unionByName(other.select(*keys, *values))
    return sum_by(both, keys, *values).withColumn(name_col, F.lit(name))


def scale_institutions(df: DataFrame, weights: DataFrame, codes: Sequence, values: Sequence[str] = ("value",), code_col: str = "donor_code") -> DataFrame:
    """The institutions' rows times the share that members have not funded, by year; other rows as they are.

    ``weights`` has year and weight. Members and institutions then add up without
    counting money twice. Years without a weight keep their value.
    """
    small = weights.select(F.col("year").alias("__y"), "weight")
    joined = df.join(small, df["year"] == F.col("__y"), "left")
    factor = F.when(F.col(code_col).isin(list(codes)), F.coalesce("weight", F.lit(1)))
    return joined.withColumns({v: F.when(factor.isNotNull(), F.col(v) * factor).otherwise(F.col(v)) for v in values}).drop("__y", "weight")


def all_bilateral_total(df: DataFrame, members: Sequence, series: str, keys: Sequence[str], name: str, values: Sequence[str] = ("value",), code_col: str = "donor_code", name_col: str = "donor_name") -> DataFrame:
    """Rows, less the scaled institution series, plus the total of members and that series."""
    feeds = df.where(F.col(code_col).isin(list(members)) | (F.col(name_col) == series))
    total = sum_by(feeds, keys, *values).withColumn(name_col, F.lit(name))
    return df.where(~F.coalesce(F.col(name_col) == series, F.lit(False))).select(*keys, name_col, *values).unionByName(total.select(*keys, name_col, *values))


def combine_indicators(df: DataFrame, keys: Sequence[str], label: str, indicator_col: str = "indicator_name", values: Sequence[str] = ("value",)) -> DataFrame:
    """All indicators under one label, summed again."""
    return sum_by(df, [k for k in keys if k != indicator_col], *values).withColumn(indicator_col, F.lit(label))


def append_total_entity(df: DataFrame, keys: Sequence[str], name_col: str, name: str, values: Sequence[str] = ("value",)) -> DataFrame:
    """Rows and, per key, their sum under one more name."""
    total = sum_by(df, keys, *values).withColumn(name_col, F.lit(name))
    return df.select(*keys, name_col, *values).unionByName(total.select(*keys, name_col, *values))


#: members in one word of a bitmap
_WORD = 62


def _numbered(members: DataFrame) -> tuple[DataFrame, list[int]]:
    """(group_name, member_code, place, word, bit) of each group's members, and the words there are. ``members`` is a table of code lists."""
    place = F.row_number().over(Window.partitionBy("group_name").orderBy("member_code")) - 1
    listed = members.select("group_name", "member_code").distinct().withColumn("place", place)
    listed = listed.withColumns({"word": F.expr(f"place div {_WORD}"), "bit": F.expr(f"shiftleft(1L, cast(place % {_WORD} as int))")})
    return listed, list(range(int((listed.agg(F.max("word")).first()[0] or 0) + 1)))


def member_bitmaps(df: DataFrame, listed: DataFrame, words: Sequence[int], code_col: str, by: Sequence[str]) -> DataFrame:
    """(group_name, by, m0, ...): for each group and combination with any member, the members that it has, as bits. One group-by."""
    seen = df.select(*by, F.col(code_col).alias("member_code")).join(listed, "member_code")
    return seen.groupBy("group_name", *by).agg(*[F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in words])


def coverage_report(df: DataFrame, members: DataFrame, code_col: str, by: Sequence[str]) -> DataFrame:
    """One row per member: combos of ``by`` with data in which it is absent, and whether it never occurs.

    ``members`` has member_code and group_name; combos are those with any member of the
    group; a group without any is left out.
    """
    return _absences(df, members, code_col, by).select("group_name", "member_code", "n_missing", "never")


def _absences(df: DataFrame, members: DataFrame, code_col: str, by: Sequence[str]) -> DataFrame:
    listed, words = _numbered(members)
    maps = member_bitmaps(df, listed, words, code_col, by)
    # A count for each bit: no combination is looked at twice, and members meet a row a group.
    has = F.array(*[F.sum(F.expr(f"shiftright(m{w}, {k}) & 1L")) for w in words for k in range(_WORD)])
    full = listed.groupBy(F.col("group_name").alias("__g")).agg(*[F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"f{w}") for w in words])
    lacks = F.lit(False)
    for w in words:
        lacks = lacks | (F.col(f"m{w}") != F.col(f"f{w}"))
    counts = maps.join(full, F.col("group_name") == F.col("__g")).groupBy("group_name").agg(F.count("*").alias("n_combos"), F.count_if(lacks).alias("n_incomplete"), has.alias("has"))
    n = F.element_at("has", (F.col("place") + 1).cast("int"))
    return listed.join(counts, "group_name").select("group_name", "member_code", "n_combos", "n_incomplete", (F.col("n_combos") - n).alias("n_missing"), (n == 0).alias("never"))


def coverage_summary(df: DataFrame, members: DataFrame, code_col: str, by: Sequence[str], k: int = 5) -> DataFrame:
    """(group_name, n_combos, n_incomplete, never, worst): combos that lack a member; members without any, and the ``k`` others absent most often, of equals the greater code first."""
    rows = _absences(df, members, code_col, by)
    often = F.sort_array(F.collect_list(F.when((F.col("n_missing") > 0) & ~F.col("never"), F.struct("n_missing", "member_code"))), asc=False)
    never = F.sort_array(F.collect_list(F.when(F.col("never"), F.col("member_code"))))
    return rows.groupBy("group_name").agg(F.first("n_combos").alias("n_combos"), F.first("n_incomplete").alias("n_incomplete"), never.alias("never"), F.slice(often, 1, k).alias("worst"))
