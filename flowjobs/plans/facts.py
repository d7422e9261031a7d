"""Facts of a release: one pass of grouping sets, written once and read by gates, detectors and snapshots.

Quantiles are found by narrowing: values are counted in bins on the map side, then
only the bins that hold a wanted rank are counted again in finer bins. No value but
a bin's smallest and largest is ever shuffled or sorted.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.io import stored

#: Column names of the dimensions of a release, by the name that a snapshot gives them.
DIMENSIONS = {"donor": "donor_name", "year": "year", "indicator": "indicator_name", "recipient": "recipient_name", "sector": "sector_name", "sub_sector": "sub_sector_name"}
NAMES = tuple(c for c in DIMENSIONS.values() if c != "year")
#: Bins of the first count: so many for each factor of e, on both sides of 0.
PER_E = 64
_ABOVE = 760 * PER_E
#: Bins that a bin is divided into where a wanted rank lies inside it.
STEPS = 4096


def by_sets(df: DataFrame, sets: Mapping[str, Sequence[str]], aggregates: Sequence[Column], keep_null: Sequence[str] = ()) -> DataFrame:
    """(dimension, key, key2, aggregates) for each of ``sets`` of one or two columns, or none, in one pass.

    Rows of a null key are left out, but for the sets named in ``keep_null``.
    """
    cols = list(dict.fromkeys(c for s in sets.values() for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets.values()], *[F.col(c) for c in cols]).agg(F.grouping_id().alias("__g"), *aggregates)
    name, key, key2, known = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)
    for label, s in sets.items():
        # A column's bit is 1 where the set leaves it out.
        this = F.col("__g") == sum((c not in s) << (len(cols) - 1 - i) for i, c in enumerate(cols))
        name = F.when(this, F.lit(label)).otherwise(name)
        for place, c in enumerate(s):
            if place:
                key2 = F.when(this, F.col(c).cast("string")).otherwise(key2)
            else:
                key = F.when(this, F.col(c).cast("string")).otherwise(key)
        ok = F.lit(True)
        for c in s if label not in keep_null else ():
            ok = ok & F.col(c).isNotNull()
        known = known | (this & ok)
    return out.where(known).select(name.alias("dimension"), key.alias("key"), key2.alias("key2"), *[c for c in out.columns if c not in cols and c != "__g"])


# --- quantiles ------------------------------------------------------------------


def number(value: str) -> Column:
    """The value as a double, NaN as null."""
    v = F.col(value).cast("double")
    return F.when(~F.isnan(v), v)


def first_bin(v: Column) -> Column:
    """A whole number that rises with ``v``: equal for values within a factor of e ** (1 / PER_E); 0 is a bin of its own."""
    # Infinities come after all other values.
    size = F.least(F.floor(F.log(F.abs(v)) * PER_E), F.lit(750 * PER_E)) + _ABOVE
    return F.when(v > 0, size).when(v < 0, -size).when(v == 0, F.lit(0))


def count_bins(df: DataFrame, value: str) -> DataFrame:
    """(low, high, n) of the first bins that have values: at most some 200,000 rows, whatever the input."""
    v = df.select(number(value).alias("v")).where("v is not null")
    return v.groupBy(first_bin(F.col("v")).alias("bin")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).drop("bin")


def quantiles_of(bins: DataFrame, df: DataFrame, value: str, at: Sequence[float]) -> list[float | None]:
    """Exact quantiles, interpolated between ranks, of the values of ``df`` that ``bins`` (low, high, n) count. None where there are none.

    Each round reads ``df`` once, for the bins only that hold a wanted rank inside;
    they are divided into STEPS, so that a few rounds are enough for any input.
    """
    total = bins.agg(F.sum("n")).first()[0]
    if not total:
        return [None] * len(at)
    places = [(total - 1) * q for q in at]
    wanted = sorted({f(p) for p in places for f in (math.floor, math.ceil)})
    found: dict[int, float] = {}
    spans, starts = bins.withColumn("span", F.lit(0)), {0: 0}
    while True:
        # Rows of one span: the first bins, later STEPS at most.
        run = F.sum("n").over(Window.partitionBy("span").orderBy("low"))
        start = run - F.col("n") + F.element_at(F.create_map(*[F.lit(x) for k in starts.items() for x in k]), F.col("span"))
        ranked = spans.select("low", "high", "n", start.alias("start"))
        left = [r for r in wanted if r not in found]
        hits = ranked.where(F.exists(F.array(*[F.lit(r).cast("long") for r in left]), lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n")))).collect()
        inside = []
        for h in hits:
            for r in left:
                if h["start"] <= r < h["start"] + h["n"]:
                    if h["low"] == h["high"] or r == h["start"]:
                        found[r] = h["low"]
                    elif r == h["start"] + h["n"] - 1:
                        found[r] = h["high"]
                    elif h not in inside:
                        inside.append(h)
        if not inside:
            break
        v, span, step, here = F.col("v"), F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(False)
        for k, h in enumerate(inside):
            within = v.between(h["low"], h["high"])
            here = here | within
            span = F.when(within, F.lit(k)).otherwise(span)
            step = F.when(within, F.floor((v - h["low"]) / (h["high"] - h["low"]) * STEPS)).otherwise(step)
        values = df.select(number(value).alias("v")).where(here)
        spans = values.groupBy(span.alias("span"), step.alias("step")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
        starts = {k: h["start"] for k, h in enumerate(inside)}
    between = lambda low, high, share: low if low == high or not share else low + (high - low) * share
    return [between(found[math.floor(p)], found[math.ceil(p)], p - math.floor(p)) for p in places]


# --- facts ------------------------------------------------------------------------


@dataclass
class Facts:
    """``rows``: (dimension, key, key2, total, n, low, high), written. Beside the release's dimensions: all, donor_year, bin (of the values), null_names (year and names that are null, as bits), and hash (of keys, repeated ones alone)."""

    source: DataFrame
    value: str
    keys: list[str]
    names: list[str]
    rows: DataFrame
    #: of each value column: the largest value, None where it holds nulls alone
    largest: dict[str, object]

    @property
    def aggregates(self) -> DataFrame:
        """The release's own dimensions: (dimension, key, key2, total, n)."""
        return self.rows.where(~F.col("dimension").isin("all", "donor_year", "bin", "null_names", "hash")).select("dimension", "key", "key2", "total", "n")

    @property
    def donor_years(self) -> DataFrame:
        """(donor_name, year, value): yearly sums of each donor."""
        kind = self.source.schema["year"].dataType if "year" in self.source.columns else T.IntegerType()
        return self.rows.where("dimension = 'donor_year'").select(F.col("key").alias("donor_name"), F.col("key2").cast(kind).alias("year"), F.col("total").alias("value"))

    def whole(self) -> dict:
        """Rows, years and the largest and smallest value of all."""
        one = self.rows.where("dimension = 'all'").select("n", "low", "high").first()
        years = self.rows.where("dimension = 'year'").select(F.col("key").cast("int").alias("y")).agg(F.min("y"), F.max("y")).first()
        return {"n": one["n"] if one else 0, "min": one["low"] if one else None, "max": one["high"] if one else None, "first_year": years[0], "last_year": years[1]}

    def quantiles(self, at: Sequence[float]) -> list[float | None]:
        return quantiles_of(self.rows.where("dimension = 'bin'").select("low", "high", "n"), self.source, self.value, at)

    def null_names(self) -> dict[str, tuple[int, list[int]]]:
        """Of each name column with nulls: how many, and the years they are in."""
        out: dict[str, tuple[int, list[int]]] = {}
        # A row for each year and set of columns.
        for r in self.rows.where("dimension = 'null_names'").select("key", "key2", "n").collect():
            for k, c in enumerate(self.names):
                if int(r["key"]) >> k & 1:
                    n, years = out.get(c, (0, []))
                    out[c] = (n + r["n"], sorted({*years, *([int(r["key2"])] if r["key2"] is not None else [])}))
        return out


def key_hash(df: DataFrame, keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys if k in df.columns])


def gather(df: DataFrame, value: str, keys: Sequence[str] = (), dimensions: Mapping[str, str] = DIMENSIONS, pairs: Sequence[tuple[str, str]] = (("donor", "sector"),), names: Sequence[str] = NAMES, largest: Sequence[str] = ()) -> Facts:
    """Reads ``df`` once and writes its facts. Sums are doubles; a key column that the data lacks doesn't count.

    The largest values are observed while the facts are written. Only maxima are, which
    a task that runs twice leaves as they are; counts come from the written rows.
    """
    have = {d: c for d, c in dimensions.items() if c in df.columns}
    names = [c for c in names if c in df.columns]
    year = F.col("year") if "year" in df.columns else F.lit(None).cast("int")
    v = number(value)
    nulls = sum((F.when(F.col(c).isNull(), 1 << k).otherwise(0) for k, c in enumerate(names)), F.lit(0))
    extra = {"__bin": first_bin(v), "__nulls": nulls, "__year": year}
    if keys and any(k in df.columns for k in keys):
        extra["__hash"] = key_hash(df, keys)
    values = [c for c in dict.fromkeys([value, *largest])]
    rows = df.select(*dict.fromkeys([*have.values(), *values]), *[c.alias(n) for n, c in extra.items()], v.alias("__v"))
    seen = Observation()
    rows = rows.observe(seen, *[F.max(c).alias(f"max_{k}") for k, c in enumerate(values)])
    sets = {d: [c] for d, c in have.items()} | {f"{a}_{b}": [have[a], have[b]] for a, b in pairs if a in have and b in have}
    if "donor" in have and "year" in have:
        sets["donor_year"] = [have["donor"], have["year"]]
    sets |= {"all": [], "bin": ["__bin"], "null_names": ["__nulls", "__year"]} | ({"hash": ["__hash"]} if "__hash" in extra else {})
    sums = [F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("total"), F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")]
    out = by_sets(rows, sets, sums, keep_null=["null_names"]).where("not (dimension = 'hash' and n = 1) and not (dimension = 'null_names' and key = '0')")
    written = stored(out, "facts")
    # An empty input may leave nothing to observe.
    top = {} if written.isEmpty() else seen.get
    return Facts(df, value, [k for k in keys if k in df.columns], names, written, {c: top.get(f"max_{k}") for k, c in enumerate(values)})
