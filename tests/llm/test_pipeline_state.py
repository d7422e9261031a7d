"""What stages and runs of the pipeline leave behind, and that none touches another's tables."""

import gc
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

import corpus_pipeline
from flowjobs.llm import tables
from flowjobs.llm.tables import read
from flowjobs.sources.io import shared_dir

SF = "/root/testdata/sf0.001"


def folders(spark):
    return {p.name for p in Path(shared_dir(spark).removeprefix("file:")).glob("flowjobs-*")}


def rows(df):
    return sorted(map(str, df.select("doc_id", "text").collect()))


def test_a_stages_result_outlives_other_stages_and_runs(spark):
    docs = read(spark, SF, "documents")
    a = corpus_pipeline.drop_repeated_lines(spark, docs, SF)
    derived = a.where("doc_id % 2 = 0")
    n, m = a.count(), derived.count()
    b = corpus_pipeline.drop_repeated_lines(spark, docs, SF)
    corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert a.count() == b.count() == n and derived.count() == m


def test_what_nobody_reads_goes_with_a_later_stage(spark):
    def collected():
        for _ in range(3):
            gc.collect()
            spark._jvm.System.gc()
            time.sleep(0.5)

    docs = read(spark, SF, "documents")
    before = folders(spark)
    first = corpus_pipeline.drop_benchmark_leaks(spark, docs, SF)
    mine = folders(spark) - before
    derived = first.where("doc_id % 2 = 0").select("doc_id", "text")
    n = derived.count()
    del first
    collected()
    corpus_pipeline.keep_good_text(spark, docs, SF)
    assert mine and mine <= folders(spark) and derived.count() == n
    del derived
    collected()
    corpus_pipeline.keep_good_text(spark, docs, SF)
    assert not mine & folders(spark)


def test_interleaved_runs(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[1], corpus_pipeline.STAGES[4]])
    before = folders(spark)
    with ThreadPoolExecutor(2) as pool:
        first, second = (f.result() for f in [pool.submit(corpus_pipeline.run, spark, SF) for _ in range(2)])
    assert len(folders(spark) - before) == 2
    third = corpus_pipeline.run(spark, SF)
    assert len(folders(spark) - before) == 3
    assert rows(first) == rows(second) == rows(third)


def test_a_failure_leaves_nothing(spark, monkeypatch):
    def broken(spark, docs, sf_dir):
        raise RuntimeError("on purpose")

    before = folders(spark)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:2], ("broken", broken)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, SF)
    assert folders(spark) <= before and tables._SCRATCH.get() is None
