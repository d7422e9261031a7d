"""Mixing sources to target weights by systematic sampling (operator 3).

All documents of a source have the same number of expected copies, target words
over source words. Their prefix sum within the source, shifted by one random
offset, crosses integers; a document is emitted once for each integer crossed.
Documents are taken in order of size, which spreads the copies evenly over short
and long documents, so the words taken come near the target.

The order is a range partition over source, size and id together: a source with
a third of all rows fills many partitions, and a document's place in its source
is its place in its partition plus the rows before the partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, numbered, shuffle_parts

WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEAT = 3
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT, share: float = 1.0) -> DataFrame:
    """(source, source_size, target, rate) from one row (source, source_size) per source.

    Sources in code point order, null last, weigh ``weights`` in turn. A target
    stops at ``max_repeat`` times its source's size; what is above is shared anew
    by weight, so all other targets are one level times the weight. The level is
    found from running sums over the sources sorted by the level that fills them. One
    task ranks the sources: a row of some tens of bytes each, so millions of them fit,
    not one for each document.
    """
    one = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by_fill = Window.orderBy("fills", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    table = (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (rank % len(weights) + 1).cast("int")))
        .withColumn("room", F.col("source_size") * F.lit(max_repeat))
        .withColumn("fills", F.col("room") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(one) * F.lit(float(share)))
        .withColumn("level", (F.col("wanted") - F.coalesce(F.sum("room").over(before), F.lit(0))) / (F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        # The first source that its level does not fill sets the level for all after it.
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("fills"), F.struct(F.col("fills"), F.col("level")))).over(one)["level"])
    )
    target = F.when(F.col("level").isNull(), F.col("room").cast("double")).otherwise(F.least(F.col("room").cast("double"), F.col("level") * F.col("weight")))
    return table.withColumn("target", target).select("source", "source_size", "target", F.try_divide("target", F.col("source_size").cast("double")).alias("rate"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT, share: float = 1.0, seed: int = SEED, size_col: str | None = None) -> DataFrame:
    """``docs`` with size, source_size, target and copies (0 to ``max_repeat``), each row once.

    ``docs`` has doc_id and source, and text or a column ``size_col`` of word counts.
    Columns of its own that are named like a new one give way to it. A null source is a source of its
    own. Null text has size 0; a source without words has target 0 and no copies.
    Repeated rows are rows of their own. The same input, weights and seed give the
    same copies for each (source, size, doc_id).
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    order = ["source", "size", "doc_id"]
    sized = docs.withColumn("__size", F.col(size_col) if size_col else word_count(F.col("text"))).select(*names, F.col("__size").alias("size"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = cut(
        sized.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__part"), place.alias("__place"))
    )
    # One row for each partition and source in it: under partitions + sources rows.
    parts = ranged.groupBy("__part", "source").agg(F.count("*").alias("n"), F.min("__place").alias("lead"), F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("lead")))
    targets = source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeat, share)
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("p.source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    # Written, so that Spark knows its size and broadcasts it only if it is small.
    rows = cut(parts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select(
        F.col("p.__part").alias("__p"), F.col("p.source").alias("__s"), F.col("before").alias("__before"), unit.alias("__unit"), "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("__rate")
    ))
    at = F.col("__before") + F.col("__place")
    crossed = F.floor((at + 1) * F.col("__rate") + F.col("__unit")) - F.floor(at * F.col("__rate") + F.col("__unit"))
    return ranged.join(rows, (F.col("__part") == F.col("__p")) & F.col("source").eqNullSafe(F.col("__s"))).select(
        *names, "size", "source_size", "target", crossed.cast("int").alias("copies")
    )


def emit_copies(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` once for each of its copies, with its own columns. Options as in :func:`mix_sources`.

    Words are counted once; ids, sources and sizes alone are put in order, and the
    copies are joined back to the rows. Null texts have no words: a source of such
    texts alone has no copies. An empty table gives an empty table.
    """
    full = numbered(docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("of"), word_count(F.col("text")).alias("words")))
    slim = full.select("uid", F.col("id").alias("doc_id"), F.col("of").alias("source"), F.col("words").alias("size"))
    mixed = mix_sources(slim, size_col="size", **options).where("copies > 0").select("uid", "copies")
    return full.select("uid", "row").join(mixed, "uid").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    slim = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mix_sources(slim, size_col="size").select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, (3 * source_size)::DOUBLE / weight AS fills, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS all_weight FROM s
), c AS (
  SELECT a.source, a.fills, (any_value(a.total) - coalesce(sum(3 * b.source_size), 0)::DOUBLE) / (any_value(a.all_weight) - coalesce(sum(b.weight), 0)) AS level
  FROM f a LEFT JOIN f b ON (b.fills, coalesce(b.source, chr(1114111))) < (a.fills, coalesce(a.source, chr(1114111)))
  GROUP BY a.source, a.fills
), lev AS (
  SELECT arg_min(level, fills) AS level FROM c WHERE level <= fills
), t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce(level, 1e300) * weight) AS target FROM f, lev
), r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0)::DOUBLE, 0) AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS place,
         ('0x' || substr(md5('17:' || coalesce(d.source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS unit
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target, (size * (floor((place + 1) * rate + unit) - floor(place * rate + unit)))::BIGINT AS taken FROM r
"""
