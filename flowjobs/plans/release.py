"""Release validation: snapshots, gates and detectors, all as rows.

A snapshot is a long table (dimension, key, key2, total, n). Whole datasets are read
once, for the facts of :mod:`facts`; gates and detectors read those and the snapshot
of the release before.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.impute import latest_year_topic_totals
from ..sources.io import finite, load_manifest, save_manifest, stored
from .facts import DIMENSIONS, NAMES, Facts, by_sets, count_bins, gather, key_hash, quantiles_of
from .report import first_names

GATE = "dataset string, check string, passed boolean, errors string"
MAX_VALUE = 1e15


# --- snapshot -----------------------------------------------------------------


def release_aggregates(df: DataFrame, value: str, dimensions: Mapping[str, str] = DIMENSIONS, pairs: Sequence[tuple[str, str]] = (("donor", "sector"),)) -> DataFrame:
    """(dimension, key, key2, total, n) for each dimension that the data has, in one pass. Null keys are left out."""
    have = {d: c for d, c in dimensions.items() if c in df.columns}
    sets = {d: [c] for d, c in have.items()} | {f"{a}_{b}": [have[a], have[b]] for a, b in pairs if a in have and b in have}
    return by_sets(df, sets, [F.coalesce(F.sum(value), F.lit(0)).alias("total"), F.count("*").alias("n")])


def presence_sets(aggregates: DataFrame) -> DataFrame:
    """(dimension, values): the sorted distinct keys of each dimension."""
    return aggregates.where("key2 is null").groupBy("dimension").agg(F.sort_array(F.collect_set("key")).alias("values"))


def exact_quantiles(df: DataFrame, value: str, at: Sequence[float]) -> DataFrame:
    """One row of columns q0, q1, ...: the quantiles of the non-null values, interpolated between ranks, by narrowing bins."""
    found = quantiles_of(count_bins(df, value), df, value, at)
    return df.sparkSession.createDataFrame([tuple(found)], ", ".join(f"q{i} double" for i in range(len(at))))


def quartiles(df: DataFrame, value: str, accuracy: int | None = None) -> DataFrame:
    """One row q0, q1, q2. With ``accuracy`` a sketch of one pass: the rank of each is off by rows / accuracy at most."""
    if accuracy is None:
        return exact_quantiles(df, value, (0.25, 0.5, 0.75))
    q = F.percentile_approx(F.col(value).cast("double"), [0.25, 0.5, 0.75], accuracy)
    return df.agg(q.alias("q")).select(*[F.col("q")[i].alias(f"q{i}") for i in range(3)])


def distribution(df: DataFrame, value: str, accuracy: int | None = None) -> DataFrame:
    """One row: min, max, median and quartiles, exact or, with ``accuracy``, as in :func:`quartiles`."""
    if accuracy is not None:
        v = F.col(value).cast("double")
        one = df.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy).alias("q"))
        return one.select("min", "max", F.col("q")[1].alias("median"), F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75"))
    # The first bins, counted once: their ends are the extremes.
    bins = stored(count_bins(df, value), "bins")
    p25, median, p75 = quantiles_of(bins, df, value, (0.25, 0.5, 0.75))
    return bins.agg(F.min("low").alias("min"), F.max("high").alias("max")).select("min", "max", F.lit(median).cast("double").alias("median"), F.lit(p25).cast("double").alias("p25"), F.lit(p75).cast("double").alias("p75"))


def yearly_changes(df: DataFrame, value: str, donor: str = "donor_name", year: str = "year") -> DataFrame:
    """(donor, year, total, previous, previous_year, change) of yearly sums; changes are from row to row, null where not finite."""
    sums = df.where(F.col(donor).isNotNull() & F.col(year).isNotNull()).groupBy(F.col(donor).alias("donor"), F.col(year).alias("year")).agg(F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("total"))
    w = Window.partitionBy("donor").orderBy("year")
    out = sums.withColumns({"previous": F.lag("total").over(w), "previous_year": F.lag("year").over(w)})
    return out.withColumn("change", F.try_divide(F.col("total") - F.col("previous"), F.col("previous")))


def historical_variation(df: DataFrame, value: str) -> DataFrame:
    """(donor, mean, std) of yearly changes: the sample deviation per donor, 0 for one change, and all donors (null donor) with the population deviation."""
    changes = yearly_changes(df, value).where("change is not null")
    by = changes.groupBy("donor").agg(F.avg("change").alias("mean"), F.coalesce(F.stddev_samp("change"), F.lit(0.0)).alias("std"))
    overall = changes.agg(F.avg("change").alias("mean"), F.stddev_pop("change").alias("std")).select(F.lit(None).cast("string").alias("donor"), "mean", "std")
    return by.unionByName(overall)


def snapshot_release(df: DataFrame, release: str, keys: Sequence[str], value: str, accuracy: int | None = None) -> DataFrame:
    """The release as rows (release, dimension, key, key2, total, n): aggregates, row count, year range and distribution.

    ``df`` is read once for the facts, and again, in part, to narrow the quartiles.
    ``accuracy`` is that of the quartiles, exact where it is None.
    """
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"declared key columns are missing: {', '.join(missing)}")
    return snapshot_of(gather(df, value), release, accuracy)


def snapshot_of(facts: Facts, release: str, accuracy: int | None = None) -> DataFrame:
    """:func:`snapshot_release` of facts that have been gathered."""
    whole = facts.whole()
    at = (0.25, 0.5, 0.75)
    p25, median, p75 = facts.quantiles(at) if accuracy is None else quartiles(facts.source, facts.value, accuracy).first()
    stats = {"row_count": whole["n"], "first_year": whole["first_year"], "last_year": whole["last_year"], "min": whole["min"], "max": whole["max"], "p25": p25, "median": median, "p75": p75}
    rows = [("stats", k, None, None if x is None else float(x), whole["n"]) for k, x in stats.items()]
    table = facts.rows.sparkSession.createDataFrame(rows, "dimension string, key string, key2 string, total double, n long")
    return facts.aggregates.unionByName(table).withColumns({"release": F.lit(release), "total": finite(F.col("total"))})


def previous_release(releases: DataFrame, current: str, by_name: bool = False) -> DataFrame:
    """The release to compare with: the latest by computed_at, or by name. ``releases`` has release, computed_at."""
    other = releases.where(F.col("release") != current)
    order = [F.desc("release")] if by_name else [F.desc_nulls_last("computed_at"), F.desc("release")]
    return other.orderBy(*order).limit(1)


# --- gates --------------------------------------------------------------------


def _family(t: T.DataType) -> str:
    for name, kinds in (("int", (T.ByteType, T.ShortType, T.IntegerType, T.LongType)), ("float", (T.FloatType, T.DoubleType, T.DecimalType)), ("string", (T.StringType, T.CharType, T.VarcharType))):
        if isinstance(t, kinds):
            return name
    return t.simpleString()


def check_schema(df: DataFrame, expected: T.StructType, dataset: str = "") -> DataFrame:
    """Missing columns and other type families; reads no data."""
    have = {f.name: f.dataType for f in df.schema}
    errors = [f"missing column {f.name}" for f in expected if f.name not in have]
    errors += [f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in expected if f.name in have and _family(have[f.name]) != _family(f.dataType)]
    return df.sparkSession.createDataFrame([(dataset, "schema", not errors, "; ".join(errors))], GATE)


def _gate(df: DataFrame, dataset: str, check: str, error: Column) -> DataFrame:
    """One row from a one-row frame; ``error`` is null where the gate passes."""
    return df.select(F.lit(dataset).alias("dataset"), F.lit(check).alias("check"), error.isNull().alias("passed"), F.coalesce(error, F.lit("")).alias("errors"))


#: A gate: its name, the aggregates it needs, and its error, which is null where it passes.
Gate = tuple[str, dict[str, Column], Column]


def gates_of(df: DataFrame, dataset: str, gates: Sequence[Gate]) -> DataFrame:
    """A row for each gate, from one pass over the data."""
    needed = {name: c for _, aggregates, _ in gates for name, c in aggregates.items()}
    one = df.agg(*[c.alias(name) for name, c in needed.items()])
    rows = F.array(*[F.struct(F.lit(check).alias("check"), error.alias("error")) for check, _, error in gates])
    return one.select(F.explode(rows).alias("g")).select(
        F.lit(dataset).alias("dataset"), F.col("g.check").alias("check"), F.col("g.error").isNull().alias("passed"), F.coalesce("g.error", F.lit("")).alias("errors")
    )


def _not_empty() -> Gate:
    return "not_empty", {"__rows": F.count("*")}, F.when(F.col("__rows") == 0, F.lit("no rows"))


def check_not_empty(df: DataFrame, dataset: str = "") -> DataFrame:
    return gates_of(df.limit(1), dataset, [_not_empty()])


def duplicate_keys(df: DataFrame, keys: Sequence[str], repeated: DataFrame | None = None) -> DataFrame:
    """Keys that repeat, null equal to null, with their rows; keys that the data lacks don't count.

    Hashes of 64 bits are counted first; whole keys are grouped only for the rows
    whose hash repeats, so that nothing but hashes is shuffled where keys are unique.
    The repeated ones are written, so that Spark knows their size and raw rows stay where
    they are if few keys repeat many times. ``repeated`` (__hash) has them, if they are known.
    """
    keys = [k for k in keys if k in df.columns]
    if not keys:
        return df.groupBy().agg(F.count("*").alias("n")).where("n > 1")
    hashed = df.select(*keys, key_hash(df, keys).alias("__hash"))
    if repeated is None:
        repeated = stored(hashed.groupBy("__hash").agg(F.count("*").alias("n")).where("n > 1").select("__hash"), "repeated")
    return hashed.join(repeated, "__hash", "left_semi").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def _repeated_keys(df: DataFrame, keys: Sequence[str], repeated: DataFrame | None = None) -> DataFrame:
    """One row: n, how many rows share keys (null for none), and sample, the first five such keys."""
    keys = [k for k in keys if k in df.columns]
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    # Read for the total and for the sample.
    found = stored(duplicate_keys(df, keys, repeated).select(text.alias("k"), "n"), "keys")
    total = found.agg(F.sum("n").alias("n"))
    sample = found.orderBy("k").limit(5).agg(F.array_join(F.sort_array(F.collect_list("k")), ", ").alias("sample"))
    return total.join(F.broadcast(sample))


def check_no_duplicate_keys(df: DataFrame, keys: Sequence[str], dataset: str = "") -> DataFrame:
    one = _repeated_keys(df, keys)
    return _gate(one, dataset, "no_duplicate_keys", F.when(F.col("n").isNotNull(), F.concat(F.col("n").cast("string"), F.lit(" rows share keys: "), F.col("sample"))))


def _value_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("value_")]


def _values_populated(df: DataFrame) -> Gate:
    cols = _value_columns(df)
    bad = F.concat_ws(", ", *[F.when((F.col(f"__count_{c}") == 0) & (F.col("__rows") > 0), F.lit(c)) for c in cols])
    return "values_populated", {"__rows": F.count("*"), **{f"__count_{c}": F.count(c) for c in cols}}, F.when(bad != "", F.concat(F.lit("only nulls in "), bad))


def check_value_columns_populated(df: DataFrame, dataset: str = "") -> DataFrame:
    return gates_of(df, dataset, [_values_populated(df)])


def _value_bounds(df: DataFrame, most: float) -> Gate:
    cols = _value_columns(df)
    bad = F.concat_ws(", ", *[F.when(F.col(f"__max_{c}") > most, F.lit(c)) for c in cols])
    return "value_bounds", {"__rows": F.count("*"), **{f"__max_{c}": F.max(c) for c in cols}}, F.when(bad != "", F.concat(F.lit("too large in "), bad))


def check_value_bounds(df: DataFrame, dataset: str = "", most: float = MAX_VALUE) -> DataFrame:
    """Negative values are normal; only the upper bound is checked."""
    return gates_of(df, dataset, [_value_bounds(df, most)])


def _names_populated(df: DataFrame, names: Sequence[str]) -> Gate:
    cols = [c for c in names if c in df.columns]
    years = lambda c: F.array_join(F.slice(F.sort_array(F.collect_set(F.when(F.col(c).isNull(), F.col("year")))), 1, 10), ", ")
    bad = F.concat_ws("; ", *[F.when(F.col(f"__null_{c}") > 0, F.concat(F.lit(f"{c}: "), F.col(f"__null_{c}").cast("string"), F.lit(" null in "), F.col(f"__years_{c}"))) for c in cols])
    return "names_populated", {"__rows": F.count("*"), **{f"__null_{c}": F.count_if(F.col(c).isNull()) for c in cols}, **{f"__years_{c}": years(c) for c in cols}}, F.when(bad != "", bad)


def check_names_populated(df: DataFrame, dataset: str = "", names: Sequence[str] = NAMES) -> DataFrame:
    """No null names; tells how many and the first ten years."""
    return gates_of(df, dataset, [_names_populated(df, names)])


def _critical_dimensions(critical: Sequence[str], previous_year: int | None) -> Gate:
    year = F.when(F.coalesce("__last", F.lit(-1)) < previous_year, F.concat(F.lit("latest year fell to "), F.coalesce(F.col("__last").cast("string"), F.lit("none")))) if previous_year is not None else F.lit(None).cast("string")
    absent = F.concat_ws(", ", *[F.when(F.coalesce(f"__has_{i}", F.lit(0)) == 0, F.lit(d)) for i, d in enumerate(critical)]) if critical else F.lit("")
    bad = F.concat_ws("; ", year, F.when(absent != "", F.concat(F.lit("missing donors: "), absent)))
    return "critical_dimensions", {"__last": F.max("year"), **{f"__has_{i}": F.max((F.col("donor_name") == d).cast("int")) for i, d in enumerate(critical)}}, F.when(bad != "", bad)


def check_critical_dimensions(df: DataFrame, critical: Sequence[str], previous_year: int | None, dataset: str = "") -> DataFrame:
    """The latest year may not fall back, and critical donors must be there."""
    return gates_of(df, dataset, [_critical_dimensions(critical, previous_year)])


# --- detectors ----------------------------------------------------------------


def _warn(df: DataFrame, dataset: str, check: str, level: Column, entity: Column, message: Column, metric: Column | None = None) -> DataFrame:
    return df.select(level.alias("level"), F.lit(dataset).alias("dataset"), F.lit(check).alias("check"), entity.cast("string").alias("entity"), message.alias("message"), (metric if metric is not None else F.lit(None)).cast("double").alias("metric"))


def _levels(size: Column, medium: float, high: float) -> Column:
    return F.when(size > high, "high").when(size > medium, "medium")


def yoy_scores(df: DataFrame, year: int, value: str) -> DataFrame:
    """(donor, change, mean, std, z) of donors whose change into ``year`` can be judged.

    At least four years up to it, three before it, two changes before it, all finite;
    the year before is present and not zero; the deviation is not zero. A zero in a
    donor's history makes a change infinite, and such a donor is not judged.
    """
    changes = yearly_changes(df, value).where(F.col("year") <= year)
    past = F.col("year") < year
    now = F.col("year") == year
    by = changes.groupBy("donor").agg(
        F.count("*").alias("years"), F.count_if(past).alias("before"), F.count_if(past & F.col("change").isNotNull()).alias("changes"),
        F.count_if(past & F.col("previous").isNotNull() & (F.col("previous") == 0)).alias("broken"),
        F.avg(F.when(past, F.col("change"))).alias("mean"), F.stddev_samp(F.when(past, F.col("change"))).alias("std"),
        F.max(F.when(now & (F.col("previous_year") == year - 1), F.col("change"))).alias("change"),
    )
    fit = by.where((F.col("years") >= 4) & (F.col("before") >= 3) & (F.col("changes") >= 2) & (F.col("broken") == 0) & (F.col("std") > 0) & F.col("change").isNotNull())
    return fit.select("donor", "change", "mean", "std", ((F.col("change") - F.col("mean")) / F.col("std")).alias("z"))


def detect_yoy_anomalies(df: DataFrame, year: int, value: str, dataset: str = "", medium: float = 2.0, high: float = 3.0) -> DataFrame:
    rows = yoy_scores(df, year, value).withColumn("level", _levels(F.abs("z"), medium, high)).where("level is not null")
    return _warn(rows, dataset, "yoy", F.col("level"), F.col("donor"), F.format_string("changed by %.1f%%, z %.2f", F.col("change") * 100, F.col("z")), F.col("z"))


def _drift(now: DataFrame, was: DataFrame, keys: Sequence[str], medium: float, high: float) -> DataFrame:
    """Keys of the previous snapshot with their relative change and level; absent now is 0, a previous 0 is skipped."""
    a = was.where("total <> 0").select(*keys, F.col("total").cast("double").alias("was"))
    b = now.select(*keys, F.col("total").cast("double").alias("now"))
    out = a.join(b, list(keys), "left").withColumn("now", F.coalesce("now", F.lit(0.0)))
    out = out.withColumn("change", (F.col("now") - F.col("was")) / F.col("was"))
    return out.withColumn("level", _levels(F.abs("change"), medium, high)).where("level is not null")


def detect_release_drift(now: DataFrame, was: DataFrame, dataset: str = "", medium: float = 0.2, high: float = 0.4) -> DataFrame:
    rows = _drift(now.where("dimension = 'donor'"), was.where("dimension = 'donor'"), ["key"], medium, high)
    return _warn(rows, dataset, "release_drift", F.col("level"), F.col("key"), F.format_string("changed by %.1f%%", F.col("change") * 100), F.col("change"))


def detect_sector_drift(now: DataFrame, was: DataFrame, dataset: str = "", sector: tuple[float, float] = (0.2, 0.4), pair: tuple[float, float] = (0.4, 0.6)) -> DataFrame:
    """Sectors, and donor and sector together, which shows moves that offset each other within a sector."""
    one = _drift(now.where("dimension = 'sector'"), was.where("dimension = 'sector'"), ["key"], *sector).withColumn("entity", F.col("key"))
    two = _drift(now.where("dimension = 'donor_sector'"), was.where("dimension = 'donor_sector'"), ["key", "key2"], *pair).withColumn("entity", F.concat_ws("|", "key", "key2"))
    rows = one.select("level", "entity", "change").unionAll(two.select("level", "entity", "change"))
    return _warn(rows, dataset, "sector_drift", F.col("level"), F.col("entity"), F.format_string("changed by %.1f%%", F.col("change") * 100), F.col("change"))


def detect_missing_expected_data(df: DataFrame, year: int, value: str, dataset: str = "") -> DataFrame:
    """Donors with rows last year: no rows in ``year``, or rows that add up to 0."""
    now, last = F.col("year") == year, F.col("year") == year - 1
    by = df.where(F.col("year").isin(year, year - 1) & F.col("donor_name").isNotNull()).groupBy("donor_name").agg(F.count_if(now).alias("now"), F.count_if(last).alias("last"), F.coalesce(F.sum(F.when(now, F.col(value))), F.lit(0)).alias("total"))
    rows = by.where((F.col("last") > 0) & ((F.col("now") == 0) | (F.col("total") == 0)))
    return _warn(rows, dataset, "missing_data", F.lit("high"), F.col("donor_name"), F.when(F.col("now") == 0, f"no rows in {year}").otherwise(f"all values of {year} add up to 0"))


def detect_new_or_removed_entities(now: DataFrame, was: DataFrame, dataset: str = "", dimensions: Sequence[str] = ("donor", "indicator", "recipient", "sector", "sub_sector")) -> DataFrame:
    """New is info; removed is medium, for sectors high."""
    both = now.select("dimension", "key", "key2", F.lit(1).alias("now"), F.lit(0).alias("was")).unionAll(was.select("dimension", "key", "key2", F.lit(0).alias("now"), F.lit(1).alias("was")))
    seen = both.where(F.col("dimension").isin(list(dimensions)) & F.col("key2").isNull()).groupBy("dimension", "key").agg(F.max("now").alias("now"), F.max("was").alias("was")).where("now <> was")
    level = F.when(F.col("now") == 1, "info").when(F.col("dimension").isin("sector", "sub_sector"), "high").otherwise("medium")
    what = F.when(F.col("now") == 1, F.lit("new ")).otherwise(F.lit("removed "))
    return _warn(seen, dataset, "entities", level, F.col("key"), F.concat(what, "dimension"))


def detect_row_count_change(now: int | Column, was: int | Column, one: DataFrame, dataset: str = "", medium: float = 0.15, high: float = 0.3) -> DataFrame:
    """``one`` is a one-row frame; a previous count of 0 gives nothing."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (now, was))
    rows = one.select(F.try_divide((a - b).cast("double"), b.cast("double")).alias("change")).withColumn("level", _levels(F.abs("change"), medium, high)).where("level is not null")
    return _warn(rows, dataset, "row_count", F.col("level"), F.lit(None), F.format_string("row count changed by %.1f%%", F.col("change") * 100), F.col("change"))


def detect_indicator_coverage_gaps(now: DataFrame, was: DataFrame, dataset: str = "") -> DataFrame:
    """Indicators of the previous release: gone is high, adding up to 0 is medium."""
    a = was.where("dimension = 'indicator'").select("key")
    b = now.where("dimension = 'indicator'").select("key", "total")
    rows = a.join(b, "key", "left").where("total is null or total = 0")
    return _warn(rows, dataset, "indicator_coverage", F.when(F.col("total").isNull(), "high").otherwise("medium"), F.col("key"), F.when(F.col("total").isNull(), "no rows").otherwise("values add up to 0"))


def detect_topic_drift(now: DataFrame, was: DataFrame, dataset: str = "", z: tuple[float, float] = (2.0, 3.0), pct: tuple[float, float] = (0.2, 0.4)) -> DataFrame:
    """Changes of one topic by donor: outliers among donors or large by themselves. Inputs have donor and total; under two donors only the size counts."""
    a = was.where("total > 0").select("donor", F.col("total").cast("double").alias("was"))
    changes = a.join(now.select("donor", F.col("total").cast("double").alias("now")), "donor", "left").withColumn("change", (F.coalesce("now", F.lit(0.0)) - F.col("was")) / F.col("was"))
    stats = changes.agg(F.avg("change").alias("mean"), F.stddev_pop("change").alias("std"), F.count("*").alias("n"))
    rows = changes.join(F.broadcast(stats)).withColumn("z", F.when((F.col("n") < 2) | (F.col("std") == 0), 0.0).otherwise((F.col("change") - F.col("mean")) / F.col("std")))
    size, far = F.abs("change"), F.abs("z")
    rows = rows.withColumn("level", F.when((far > z[1]) | (size > pct[1]), "high").when((far > z[0]) | (size > pct[0]), "medium")).where("level is not null")
    return _warn(rows, dataset, "topic_drift", F.col("level"), F.col("donor"), F.format_string("changed by %.1f%%, z %.2f", F.col("change") * 100, F.col("z")), F.col("change"))


def detect_missing_critical(now: DataFrame, was: DataFrame, critical: Sequence[str], dataset: str = "") -> DataFrame:
    rows = was.where((F.col("total") > 0) & F.col("donor").isin(list(critical))).select("donor").join(now.select("donor", "total"), "donor", "left").where("total is null or total = 0")
    return _warn(rows, dataset, "missing_critical", F.lit("high"), F.col("donor"), F.lit("critical donor has no value"))


def detect_new_entities_summary(now: DataFrame, was: DataFrame, dataset: str = "", k: int = 5) -> DataFrame:
    """One info row that names the first new donors; none where there are none."""
    new = now.select("donor").join(was.select("donor"), "donor", "left_anti")
    one = new.agg(F.count_distinct("donor").alias("n"), F.sort_array(F.collect_set("donor")).alias("names")).where("n > 0")
    text = F.concat(F.array_join(F.slice("names", 1, k), ", "), F.when(F.col("n") > k, F.concat(F.lit(" and "), (F.col("n") - k).cast("string"), F.lit(" others"))).otherwise(F.lit("")))
    return _warn(one, dataset, "new_entities", F.lit("info"), F.lit(None), F.concat(F.lit("new donors: "), text), F.col("n"))


def entity_names_summary(df: DataFrame, name: str, k: int = 20) -> DataFrame:
    return df.agg(first_names(name, k).alias("names"))


# --- whole report ---------------------------------------------------------------


WARNING = "level string, dataset string, check string, entity string, message string, metric double"


def _gates_from(facts: Facts, dataset: str, expected: T.StructType, critical: Sequence[str], previous_year: int | None) -> DataFrame:
    """The gates of one dataset, read from its facts. Only repeated hashes make the keys be looked at again."""
    df, whole, years = facts.source, facts.whole(), lambda found: ", ".join(map(str, found[:10]))
    errors: dict[str, str | None] = {"not_empty": None if whole["n"] else "no rows"}
    nulls = [c for c, most in facts.largest.items() if c.startswith("value_") and most is None and whole["n"]]
    errors["values_populated"] = f"only nulls in {', '.join(nulls)}" if nulls else None
    large = [c for c, most in facts.largest.items() if c.startswith("value_") and most is not None and most > MAX_VALUE]
    errors["value_bounds"] = f"too large in {', '.join(large)}" if large else None
    found = facts.null_names()
    errors["names_populated"] = "; ".join(f"{c}: {found[c][0]} null in {years(found[c][1])}" for c in facts.names if c in found) or None
    here = {r["key"] for r in facts.rows.where((F.col("dimension") == "donor") & F.col("key").isin(list(critical))).select("key").collect()}
    absent = [d for d in critical if d not in here]
    last = whole["last_year"]
    fell = [f"latest year fell to {'none' if last is None else last}"] if previous_year is not None and (-1 if last is None else last) < previous_year else []
    errors["critical_dimensions"] = "; ".join(fell + ([f"missing donors: {', '.join(absent)}"] if absent else [])) or None
    errors["no_duplicate_keys"] = None
    if facts.keys and facts.rows.where("dimension = 'hash'").limit(1).count():
        row = _repeated_keys(df, facts.keys, stored(facts.rows.where("dimension = 'hash'").select(F.col("key").cast("long").alias("__hash")), "repeated")).first()
        errors["no_duplicate_keys"] = None if row["n"] is None else f"{row['n']} rows share keys: {row['sample']}"
    rows = [(dataset, check, error is None, error or "") for check, error in errors.items()]
    return check_schema(df, expected, dataset).unionByName(df.sparkSession.createDataFrame(rows, GATE))


def _warnings_from(facts: Facts, dataset: str, previous: DataFrame | None, year: int | None) -> DataFrame:
    latest = year if year is not None else facts.whole()["last_year"]
    found = [facts.rows.sparkSession.createDataFrame([], WARNING)]
    if latest is not None:
        sums = facts.donor_years
        found += [detect_yoy_anomalies(sums, int(latest), "value", dataset), detect_missing_expected_data(sums, int(latest), "value", dataset)]
    if previous is not None:
        now = facts.aggregates
        counts = previous.where("dimension = 'stats' and key = 'row_count'").agg(F.max("total").alias("was"))
        rows = F.lit(facts.whole()["n"])
        found += [detect_release_drift(now, previous, dataset), detect_sector_drift(now, previous, dataset), detect_new_or_removed_entities(now, previous, dataset), detect_indicator_coverage_gaps(now, previous, dataset), detect_row_count_change(rows, F.col("was"), counts, dataset)]
    out = found[0]
    for w in found[1:]:
        out = out.unionByName(w)
    return out


def _last_year(previous: DataFrame | None) -> int | None:
    row = None if previous is None else previous.where("dimension = 'stats' and key = 'last_year'").select("total").first()
    return None if row is None or row[0] is None else int(row[0])


def validate_dataset(df: DataFrame, dataset: str, expected: T.StructType, keys: Sequence[str], value: str, previous: DataFrame | None = None, critical: Sequence[str] = (), year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(gates, warnings). Detectors run even if a gate fails. ``previous`` is a snapshot of the release before.

    ``df`` is read once, for facts that are written to the shared folder and that both
    results come from; a second time only if keys seem to repeat.
    """
    facts = gather(df, value, keys, largest=_value_columns(df))
    return _gates_from(facts, dataset, expected, critical, _last_year(previous)), _warnings_from(facts, dataset, previous, year)


def validate_path(spark: SparkSession, path: str, dataset: str, expected: T.StructType, keys: Sequence[str], value: str, **options) -> tuple[DataFrame, DataFrame]:
    """As :func:`validate_dataset`; an input that can't be read is itself a failed gate."""
    try:
        return validate_dataset(spark.read.parquet(path), dataset, expected, keys, value, **options)
    except Exception as error:  # Spark's own errors have no common class over Connect and classic
        return _unreadable(spark, dataset, error), spark.createDataFrame([], WARNING)


def _unreadable(spark: SparkSession, dataset: str, error: Exception) -> DataFrame:
    return spark.createDataFrame([(dataset, "readable", False, str(error).splitlines()[0])], GATE)


@dataclass(frozen=True)
class Dataset:
    """A written view and what is expected of it."""

    name: str
    path: str
    expected: T.StructType
    keys: Sequence[str]
    value: str
    critical: Sequence[str] = ()
    year: int | None = None


@dataclass(frozen=True)
class Topics:
    """A written table of purposes (year, donor_name, purpose_code and a value) whose latest year is summed by topic; None takes all purposes."""

    name: str
    path: str
    topics: Mapping[str, Sequence | None]
    value: str = "value"
    critical: Sequence[str] = ()


def validate_all(spark: SparkSession, datasets: Sequence[Dataset], release: str, manifests: str, topics: Sequence[Topics] = (), update: bool = True) -> tuple[DataFrame, DataFrame]:
    """(gates, warnings) of all datasets and topic tables in one report.

    Each dataset's snapshots are in a folder of its name below ``manifests``; it is
    compared with the release of the greatest other name there, topics with the one
    computed last. With ``update`` this release's snapshot is saved once the dataset's
    warnings have been written. A dataset that can't be read is a failed gate of its
    own, has no snapshot, and leaves the others alone.
    """
    gates, warnings = spark.createDataFrame([], GATE), spark.createDataFrame([], WARNING)
    for check, items in ((_validate_one, datasets), (_validate_topics, topics)):
        for d in items:
            try:
                one = check(spark, d, release, f"{manifests.rstrip('/')}/{d.name}", update)
            except Exception as error:  # as in validate_path
                one = _unreadable(spark, d.name, error), None
            gates = gates.unionByName(one[0])
            warnings = warnings if one[1] is None else warnings.unionByName(one[1])
    return gates, warnings


def _before(saved: DataFrame, release: str, by_name: bool) -> DataFrame | None:
    """The snapshot to compare with, None where there is no other release."""
    at = F.max(F.when((F.col("dimension") == "stats") & (F.col("key") == "computed_at"), F.col("total")))
    last = previous_release(saved.groupBy("release").agg(at.alias("computed_at")), release, by_name).first()
    return None if last is None else saved.where(F.col("release") == last["release"])


def _validate_one(spark: SparkSession, d: Dataset, release: str, manifest: str, update: bool) -> tuple[DataFrame, DataFrame]:
    df = spark.read.parquet(d.path)
    facts = gather(df, d.value, d.keys, largest=_value_columns(df))
    previous = _before(load_manifest(spark, manifest), release, by_name=True)
    gates = _gates_from(facts, d.name, d.expected, d.critical, _last_year(previous))
    warnings = stored(_warnings_from(facts, d.name, previous, d.year), "warnings")
    if update and not [k for k in d.keys if k not in df.columns]:
        save_manifest(snapshot_of(facts, release), manifest)
    readable = spark.createDataFrame([(d.name, "readable", True, "")], GATE)
    return readable.unionByName(gates), warnings


def _validate_topics(spark: SparkSession, d: Topics, release: str, manifest: str, update: bool) -> tuple[DataFrame, DataFrame]:
    df = spark.read.parquet(d.path)
    totals = latest_year_topic_totals(df, d.topics, value=d.value)
    now = stored(totals.select(F.concat(F.lit("topic:"), "topic").alias("dimension"), F.col("donor_name").alias("key"), F.lit(None).cast("string").alias("key2"), F.col(d.value).cast("double").alias("total"), F.lit(0).cast("long").alias("n")), "topics")
    empty = now.limit(1).count() == 0
    gates = spark.createDataFrame([(d.name, "readable", True, ""), (d.name, "not_empty", not empty, "no rows" if empty else "")], GATE)
    previous = _before(load_manifest(spark, manifest), release, by_name=False)
    warnings = spark.createDataFrame([] if previous is not None or empty else [("info", d.name, "baseline", None, "first release, nothing to compare with", None)], WARNING)
    for topic in d.topics if previous is not None and not empty else ():
        a, b = (x.where(F.col("dimension") == f"topic:{topic}").select(F.col("key").alias("donor"), "total") for x in (now, previous))
        for found in (detect_topic_drift(a, b, d.name), detect_missing_critical(a, b, d.critical, d.name)):
            warnings = warnings.unionByName(found.withColumn("message", F.concat(F.lit(f"{topic}: "), "message")))
    if previous is not None and not empty:
        a, b = (x.where("dimension like 'topic:%'").select(F.col("key").alias("donor")).distinct() for x in (now, previous))
        warnings = warnings.unionByName(detect_new_entities_summary(a, b, d.name))
    warnings = stored(warnings, "warnings")
    if update and not empty:
        at = spark.createDataFrame([("stats", "computed_at", None, time.time(), 0)], now.schema)
        save_manifest(now.unionByName(at).withColumn("release", F.lit(release)), manifest)
    return gates, warnings


def warning_summary(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("level").agg(F.count("*").alias("n"))


def report_status(gates: DataFrame) -> DataFrame:
    """One row: (n_failed, blocking)."""
    return gates.agg(F.count_if(~F.col("passed")).alias("n_failed")).withColumn("blocking", F.col("n_failed") > 0)
