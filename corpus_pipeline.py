"""Corpus pipeline: from raw documents to a deduplicated, decontaminated, mixed corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All stages return the columns of
documents, and any further ones that docs has. An empty table stays empty. Null ids,
null and empty texts and repeated rows are allowed in all stages; what becomes of
them is said at each.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from flowjobs.llm import decontam, lines, mixing, near_dups, quality
from flowjobs.llm.tables import Scratch, cut, read, ship


def _stage(work):
    """Prepares the session, and deletes what the stage has written for itself but for what its own result reads.

    The result, and anything that its caller makes of it, stays readable whatever else runs in the session.
    """

    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        with Scratch(spark) as own:
            out = work(spark, docs, sf_dir)
            own.delete(unless_read_by=out)
        return out

    return stage


@_stage
def keep_good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Each row is judged by its text alone; null counts as empty."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; every row stays, null texts as null. Rows with one doc_id are one document, a null id comes last."""
    return lines.without_repeated_lines(docs)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (similarity 0.8 or more) stays, one with the smallest doc_id, null last. Texts without words all stay."""
    return near_dups.keep_one(docs)


@_stage
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their id; a row with a null id is a document by itself."""
    return decontam.drop_leaking(docs, read(spark, sf_dir, "benchmark"))


@_stage
def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the target of its source asks, up to three times; a null source is one of its own. Texts without words weigh nothing and go by their place."""
    return mixing.emit_copies(docs)


STAGES = [
    ("quality", keep_good_text),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_to_weights),
]

#: The quality stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. Only the result's own table is left; on a failure nothing is. Runs may be interleaved."""
    docs = read(spark, sf_dir, "documents")
    with Scratch(spark) as own:
        for _, stage in STAGES:
            docs = cut(stage(spark, docs, sf_dir))
            own.delete(unless_read_by=docs)
    return docs
