"""Classifiers by held-out accuracy, top-k by brute force, the pipeline by its promises."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowjobs.llm import quality, topk, toxicity
from flowjobs.llm.tables import read

SF = "/root/testdata/sf0.1"


def test_quality_on_held_out_rows(spark):
    labels = read(spark, SF, "labels")
    got = quality.score_quality(read(spark, SF, "documents"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_toxicity_on_held_out_rows(spark):
    labels = read(spark, SF, "labels")
    got = toxicity.score_toxicity(read(spark, SF, "documents"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["toxic"]).mean() > 0.97
    assert ((got["predicted"] == 1) & (got["toxic"] == 0)).sum() <= 3


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = read(spark, "/root/testdata/sf0.001", "documents"), read(spark, "/root/testdata/sf0.001", "labels")
    for op, (n, k), col in ((quality.score_quality, (4, 2), "quality"), (toxicity.score_toxicity, (5, 0), "toxic")):
        turned = labels.withColumn(col, F.when(F.crc32(F.col("doc_id").cast("string")) % n == k, 1 - F.col(col)).otherwise(F.col(col)))
        a, b = (sorted(map(tuple, op(docs, x).select("doc_id", "score").collect())) for x in (labels, turned))
        assert a == b


def test_non_negative_risk_separates():
    rnd = np.random.default_rng(0)
    k = len(quality.FEATURES)
    good, bad = rnd.normal(0, 1, (900, k)), rnd.normal(2, 1, (100, k))
    model = quality.fit(good[:400], np.concatenate([good[400:], bad]), prior=0.85)
    assert np.median(model.margin(good)) > np.median(model.margin(bad)) + 1


def test_counterfactuals_close_the_gap(spark):
    """A group that toxic training texts name often must not make neutral texts toxic."""
    rnd = random.Random(0)
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        group = "muslims" if bad and rnd.random() < 0.8 else rnd.choice(["muslims", "christians", "teachers", "farmers", "drivers", "nurses", "bakers"])
        words = [rnd.choice("went came saw bought sold made kept found lost gave".split()) for _ in range(12)]
        if bad and rnd.random() < 0.7:
            words.insert(5, rnd.choice(["idiot", "scum"]))
        rows.append((i, " ".join([group, *words])))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(5000, "muslims went came saw bought sold"), (5001, "christians went came saw bought sold")], "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")

    def gap(penalty):
        s = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, table, penalty=penalty).where("doc_id >= 5000").collect()}
        return s[5000] - s[5001]

    assert gap(0.0) > 0.2 and abs(gap(5.0)) < gap(0.0) / 3


def test_odd_rows(make, spark):
    docs = make([(1, None), (1, None), (2, ""), (None, "text of nobody"), (3, "x" * 100_000), (4, "ÄÖ 🙂")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for op in (quality.score_quality, toxicity.score_toxicity):
        for table in (labels, labels.limit(0)):
            out = op(docs, table).collect()
            assert len(out) == 6 and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in out)
            assert op(docs.limit(0), table).count() == 0
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 6


def test_top_k(spark):
    rnd = np.random.default_rng(0)
    v = rnd.normal(size=(1500, 8)) * np.exp(rnd.normal(size=(1500, 1)))
    v[100:140], v[7] = v[100], 0
    rows = [(i, [float(x) for x in v[i]]) for i in range(1500)]
    rows += [(3, None), (50, [float("nan")] * 8), (100, [1.0, None]), (50, [1.0, 2.0]), (None, [9.0] * 8), (150, []), (60, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("uid", F.lit("clash"))
    good = [(i, np.pad(np.floor(np.array(x, float) * 256), (0, 8 - len(x)))) for i, x in rows if x is not None and None not in x and np.isfinite(x).all()]
    m = np.array([x for _, x in good])
    want = []
    for n, (i, x) in enumerate(good):
        if i is not None and i % 50 == 0:
            s = m @ x
            best = sorted((-s[k], float("inf") if j is None else j) for k, (j, _) in enumerate(good) if k != n)[:5]
            want += [(i, r + 1, None if j == float("inf") else int(j), int(-z)) for r, (z, j) in enumerate(best)]
    for block, asked in ((64, 8), (4096, 256)):
        assert sorted(map(tuple, topk.top_k(df, block=block, queries=asked).collect()), key=str) == sorted(want, key=str)
    assert topk.top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert list(map(tuple, topk.top_k(few).collect())) == [(0, 1, 1, 256 * 512)]


def test_scores_near_64_bits(spark):
    of = lambda rows: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    # The product of 50 with itself does not fit, and is not asked for.
    rows = [(0, (2**30, 0)), (1, (0, 2**30)), (2, (1, 1)), (50, (2**32, 5)), (3, (-(2**30), 7))]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(of(rows), scale=1).collect()}
    assert got == {(i, j): sum(a * b for a, b in zip(u, v, strict=True)) for i, u in rows if i % 50 == 0 for j, v in rows if i != j}
    with pytest.raises(OverflowError, match="score"):
        topk.top_k(of([*rows, (4, (2**31, 0))]), scale=1)
    rnd = np.random.default_rng(2)
    q, x = (rnd.integers(-(2**32), 2**32, (20, 3)) for _ in range(2))
    exact = [[min(max(sum(int(a) * int(b) for a, b in zip(u, v, strict=True)), topk.TOO_LOW), topk.TOO_HIGH) for v in x] for u in q]
    assert topk.products(q, x).tolist() == exact


def test_pruning_never_loses():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        x = np.floor(rnd.normal(size=(200, 6)) * 100)
        x = x[np.argsort(-np.linalg.norm(x, axis=1))].astype(np.int64)
        q = np.floor(rnd.normal(size=6) * 100).astype(np.int64)
        s = x @ q
        for bound in np.quantile(s, [0.5, 0.9, 0.99]):
            norms, q_norm = np.linalg.norm(x, axis=1), float(np.linalg.norm(q))
            n = topk.by_length(float(bound), q_norm, norms) if bound > 0 else len(x)
            kept = set(topk.by_coordinates(float(bound), q, q_norm, x[:n], norms[:n]).tolist())
            assert set(np.flatnonzero(s >= bound).tolist()) <= kept


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    stage = docs
    sizes = [docs.count()]
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, sf)
        assert stage.columns == docs.columns
        sizes.append(stage.count())
    assert sizes == sorted(sizes, reverse=True)
    out = corpus_pipeline.run(spark, sf)
    ids = {r[0] for r in stage.select("doc_id").collect()}
    got = out.groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in got} <= ids and all(1 <= r["count"] <= 3 for r in got)
