"""Scorers against plain Python, factors, pruning, hot lines, odd rows, and what is left on disk."""

import collections
import hashlib
import math
import os
import random
import re
import sys
import types
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from flowjobs.llm import decontam, licenses, lines, mixing, near_dups, quality, substrings, tables, token_counts, topk, toxicity  # noqa: E402
from flowjobs.llm import words as W  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def block(text: bytes) -> W.Block:
    data = np.frombuffer(text, np.uint8)
    return W.Block(0, 1, data, np.array([0, len(data)]))


# --- scorers --------------------------------------------------------------------------


def plain_features(text: bytes) -> list[float]:
    names = quality._CLASSES
    kind = lambda b: names[quality._CLASS[b]]
    counts = collections.Counter(kind(b) for b in text)
    words = text.split()
    n, per = len(words), max(1, len(words))
    if not text:
        return [0.0] * len(quality.FEATURES)
    out = [counts[c] / len(text) for c in names]
    out += [math.log1p(len(text)), math.log1p(n), sum(map(len, words)) / per, sum(kind(w[0]) == "upper" for w in words) / per, sum(a == b for a, b in zip(words, words[1:])) / per]
    out += [len(set(words)) / per, math.log1p(n / (counts["newline"] + 1)), sum(names.index(kind(w[-1])) > names.index("comma") for w in words) / per]
    return out


def test_quality_features_and_score_match_plain_python():
    rnd = random.Random(1)
    texts = [b"", b" \n", b"One two, two THREE!", "ÄÖ über 12% $5\nnext line #tag".encode(), bytes(rnd.choice(b"abc XY.,;:!?\n\t09|*$&%#'()[]-_") for _ in range(3000))]
    k = len(quality.FEATURES)
    rows = [plain_features(t) for t in texts]
    gen = np.random.default_rng(0)
    edges = np.sort(gen.random((k, quality.BINS - 1)), axis=1)
    model = quality.Model(edges, gen.normal(size=(k, quality.BINS)), 0.3, 1.5, -0.2)
    for t, want in zip(texts, rows, strict=True):
        got = quality.text_features(block(t))
        assert np.allclose(got[0], want, rtol=1e-5, atol=1e-6)
        x = [float(np.float32(v)) for v in got[0]]
        z = model.bias + sum(model.weights[f][sum(e <= x[f] for e in edges[f])] for f in range(k))
        assert abs(model.score(got)[0] - 1 / (1 + math.exp(-(model.scale * z + model.shift)))) < 1e-9


def test_steps_over_all_rows_reach_the_least_risk():
    """With the sample's curvature each step brings the slope of the risk over all rows nearer to zero."""
    gen = np.random.default_rng(3)
    k = len(quality.FEATURES)
    rows = gen.normal(size=(4000, k)) + (gen.random(4000) < 0.3)[:, None]
    positive = gen.normal(size=(300, k))
    sample = rows[:1500]
    model = quality.fit(positive, sample, 0.6)
    p, all_cells = model.cells(positive), model.cells(rows)
    slope = lambda m: quality._slope(all_cells, quality._sigmoid(m.margin_of(all_cells))) / len(rows) - 0.6 * quality._slope(p, np.ones(len(p)) / len(p)) + quality.RIDGE * np.append(m.weights.ravel(), m.bias)
    inverse = np.linalg.inv(quality.curvature(model, model.cells(sample)))
    sizes = [np.abs(slope(model)).max()]
    for _ in range(12):
        w = np.append(model.weights.ravel(), model.bias) - inverse @ slope(model)
        model = quality.replace(model, weights=w[:-1].reshape(k, -1), bias=float(w[-1]))
        sizes.append(np.abs(slope(model)).max())
    assert sizes[quality.PASSES] < sizes[0] / 5 and sizes[-1] < sizes[0] / 20


def test_prior_is_estimated_from_positives_and_unlabelled_text():
    gen = np.random.default_rng(5)
    positive, unlabelled = gen.normal(3, 1, 2000), np.concatenate([gen.normal(3, 1, 7000), gen.normal(-3, 1, 3000)])
    at = np.quantile(positive, np.linspace(0, 0.9, 46))
    above = lambda x: (x[:, None] >= at).sum(axis=0)
    assert abs(quality.estimated_prior(above(positive), above(unlabelled), 2000, 10000) - 0.7) < 0.06


def test_toxicity_score_matches_plain_python(spark):
    rnd = random.Random(2)
    words = "you are such a nice person and idiots idiot idiotic go away please stupid stupidity women men friends".split()
    rows = [(i, " ".join(rnd.choice(words) for _ in range(12)) + (" stupid idiots" if i % 3 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, labels, (5, 0), 1000, toxicity.TELLING, 1.0)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))

    def feature(part: bytes, kind: int, level: int) -> int:
        h = W.Hasher(np.frombuffer(part, np.uint8)).ranges(np.array([0]), np.array([len(part)]))
        return int(W.mix(toxicity._kind(h, kind) + np.uint64(level))[0])

    def plain(text: str) -> float:
        found = WORD.findall(text.encode().translate(LOW))
        z = model.bias
        for kind, size in enumerate((None, *toxicity.PREFIXES)):
            for part, n in collections.Counter(w[:size] for w in found).items():
                for level in range(1, min(n, 1 if size is None else toxicity.LEVELS) + 1):
                    z += weight.get(feature(part, kind, level), 0.0)
        return 1 / (1 + math.exp(-z))

    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels, sample=1000).collect()}
    assert all(abs(got[i] - plain(t)) < 1e-9 for i, t in rows)


def test_swaps_stay_within_language_class_and_number():
    for by in toxicity.SWAPS:
        swap = toxicity._swaps(by)
        for line in toxicity.IDENTITY:
            for term, h in zip(line, toxicity._hash_of(line), strict=True):
                other = swap[int(h)]
                assert any(term in x and other in x for x in toxicity.IDENTITY) and other != term


def test_a_repeated_id_brings_one_text_to_the_fit(spark):
    docs = spark.range(6000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text")).unionAll(spark.createDataFrame([(8, "bad idiots")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 0, 1), (8, 1, 0)], "doc_id long, toxic int, quality int")
    assert toxicity.score_toxicity(docs, labels).count() == 6001
    assert quality.score_quality(docs, labels).count() == 6001


# --- factors --------------------------------------------------------------------------


def test_factors_copy_what_they_say_and_cover_all_repeated_windows(spark):
    rnd = random.Random(6)
    text = lambda k: [f"{rnd.choice('abcdef')}{rnd.randrange(30)}" for _ in range(k)]
    shared = [text(90), text(40), text(200)]
    docs = []
    for i in range(40):
        parts = [text(rnd.randrange(30))]
        for _ in range(rnd.randrange(3)):
            s = rnd.choice(shared)
            a = rnd.randrange(len(s) - 20)
            parts += [s[a : a + rnd.randrange(20, 200)], text(rnd.randrange(20))]
        docs.append((i, " ".join(w for p in parts for w in p)))
    docs += [(100, docs[3][1]), (101, "again and " * 60), (102, None), (103, "")]
    by = {i: (t or "").split() for i, t in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for window, gram in ((35, 8), (12, 4)):
        seen = collections.Counter(tuple(w[j : j + window]) for w in by.values() for j in range(len(w) - window + 1))
        want = {(i, j + x) for i, w in by.items() for j in range(len(w) - window + 1) if seen[tuple(w[j : j + window])] > 1 for x in range(window)}
        got, found = set(), substrings.factors(df, window, gram).collect()
        for f in found:
            w, source = by[f["doc_id"]], by[f["source_doc_id"]]
            assert f["words"] >= window and (f["doc_id"], f["start"]) != (f["source_doc_id"], f["source_start"])
            assert w[f["start"] : f["start"] + f["words"]] == source[f["source_start"] : f["source_start"] + f["words"]]
            got |= {(f["doc_id"], f["start"] + x) for x in range(f["words"])}
        assert got == want
    # A whole copy is one factor.
    assert len([f for f in substrings.factors(spark.createDataFrame([(1, " ".join(shared[2])), (2, "x " + " ".join(shared[2]))], "doc_id long, text string")).collect()]) == 2


def test_parse_is_greedy():
    place = lambda u, s: {"uid": u, "start": s}
    hits = [{"start": 10, "n": 4, "lo": place(1, 0), "hi": place(2, 50)}, {"start": 14, "n": 3, "lo": place(2, 54), "hi": place(3, 7)}, {"start": 17, "n": 2, "lo": place(2, 57), "hi": place(2, 57)}, {"start": 30, "n": 1, "lo": place(2, 70), "hi": place(2, 70)}]
    assert substrings.parse(hits, 5) == [(10, 13, 2, 50), (30, 5, 2, 70)]


# --- top-k ----------------------------------------------------------------------------


def test_buckets_are_skipped_cut_and_pruned():
    gen = np.random.default_rng(2)
    dim = 64
    x = gen.normal(size=(600, dim)) * np.exp(gen.normal(size=(600, 1)))
    # Half of the queries point along one coordinate, where coordinates tell much.
    q = gen.normal(size=(40, dim)) * 20
    q[20:] = gen.normal(size=(20, dim)) * 0.2
    q[20:, 3] = 40
    x = np.floor(256 * x[np.argsort(-np.linalg.norm(x, axis=1))]).astype(np.int64)
    q = np.floor(256 * q).astype(np.int64)
    norms, q_norms = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    s = q @ x.T
    bounds = np.sort(s[:, :200], axis=1)[:, -5]
    seen = collections.Counter()
    for lo in range(0, 600, 100):
        part = slice(lo, lo + 100)
        found = {}
        for j, rows, scores, how in topk.search_block(q, q_norms, bounds, x[part], norms[part]):
            assert (scores == s[j, part][rows]).all()
            found[j] = set(rows.tolist())
            seen[how if how == "coordinates" or len(rows) == 100 else "shorter"] += 1
        seen["skipped"] += 40 - len(found)
        for j in range(40):
            assert set(np.flatnonzero(s[j, part] >= bounds[j]).tolist()) <= found.get(j, set())
    assert all(seen[k] for k in ("skipped", "shorter", "coordinates", "length"))


def test_ids_and_large_components_stay_exact(spark):
    big = 9007199254741093
    rows = [(0, [1.0, 1.0]), (big, [3.0, 1.0]), (None, [2.0, 2.0]), (big + 1, [3.0, 1.0]), (5, None), (100, [])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 0").orderBy("rank").collect()]
    assert got == [(0, 1, big, 4 << 16), (0, 2, big + 1, 4 << 16), (0, 3, None, 4 << 16), (0, 4, 100, 0)]
    # Products of over 2^53 take the path of 64-bit integers.
    wide = spark.createDataFrame([(0, [2.0**20, 1.0]), (1, [2.0**22 + 1, 3.0]), (2, [3.0, 2.0**10])], "vec_id long, embedding array<double>")
    want = [(2**28) * (2**30 + 256) + 256 * 768, (2**28) * 768 + 256 * 2**18]
    assert [tuple(r) for r in topk.top_k(wide).orderBy("rank").collect()] == [(0, 1, 1, want[0]), (0, 2, 2, want[1])]
    with pytest.raises(Exception, match="fit into 64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0**60])], "vec_id long, embedding array<double>")).collect()


def test_rounds_and_block_sizes_give_the_same(spark):
    gen = np.random.default_rng(7)
    rows = [(i, (gen.normal(size=8) * math.exp(gen.normal())).tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(map(tuple, topk.top_k(df).collect()))
    assert sorted(map(tuple, topk.top_k(df, block=32, queries=4, growth=2).collect())) == want


# --- lines ----------------------------------------------------------------------------


def test_lines_pass_one_shuffle(spark):
    rows = spark.createDataFrame([(i, i % 3, i % 5, i, 0) for i in range(50)], "h1 long, h2 long, doc long, uid long, pos int")
    plan = lines.first_seen(tables.cut(rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(part") == 1 and "rangepartitioning" not in plan
    window = plan.index("Window [")
    assert plan.index("Exchange hashpartitioning(part") > window and plan.count("Exchange ", window) - plan.count("BroadcastExchange", window) <= 1 + plan.count("Exchange SinglePartition", window)
    assert "Python" not in plan and "Arrow" not in plan


def test_a_line_that_thousands_of_documents_share(make):
    rnd = random.Random(4)
    texts = [(i, "\n".join(["the same line in all documents"] * (1 + i % 2) + [f"line {rnd.randrange(400)} of some documents", f"a line of document {i}"])) for i in rnd.sample(range(5000), 3000)]
    got = {(r["doc_id"], r["kept_text"]) for r in lines.dedup_lines(make(texts)).collect()}
    assert got == set(brute.dedup_lines(texts))


def test_clashing_columns_come_back(make):
    docs = make([(1, "a line of some length"), (2, "a line of some length")]).withColumn("n_lines", F.lit("mine")).withColumn("kept_text", F.lit(3))
    out = lines.dedup_lines(docs)
    assert out.columns == [{"n_lines": "_n_lines", "kept_text": "_kept_text"}.get(c, c) for c in docs.columns] + ["n_lines", "n_dropped", "kept_text"]
    assert {(r["doc_id"], r["_n_lines"], r["n_dropped"], r["rowkey"]) for r in out.collect()} == {(1, "mine", 0, "clash"), (2, "mine", 1, "clash")}
    left = lines.without_repeated_lines(make([(1, None), (2, "a line of some length"), (3, "a line of some length\nx")]).withColumn("n_chars", F.lit(None).cast("long")))
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in left.collect()} == {(1, None, None), (2, "a line of some length", None), (3, "x", 1)}


# --- decontamination, licenses, tokens -------------------------------------------------


def test_rows_of_one_id_are_not_pieced_together(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone twentytwo twentythree twentyfour".split()
    halves = [(7, " ".join(item[:10])), (7, "x " * 8 + " ".join(item[8:18])), (None, " ".join(item[:10])), (None, "y " * 8 + " ".join(item[8:18]))]
    docs = spark.createDataFrame([*halves, (8, " ".join(item)), (8, "another text")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.find_leaks(docs, bench, share=0.9).collect()} == {8}
    assert sorted(str(r["doc_id"]) for r in decontam.drop_leaking(docs, bench, share=0.9).collect()) == ["7", "7", "None", "None"]


def test_license_scan_without_filter_is_the_same(make, monkeypatch):
    docs = make([(1, "MIT License and " + licenses.NOTICES[0][0]), (2, "nothing"), (3, None), (4, "cc by cc by")])
    want = sorted(map(tuple, licenses.digest(docs).collect()))
    monkeypatch.setattr(licenses, "FILTER_GRAMS", 0)
    assert sorted(map(tuple, licenses.digest(docs).collect())) == want


def test_sections_of_another_type_are_not_read(spark):
    docs = spark.createDataFrame([(1, "two lines\nof text")], "doc_id long, text string").withColumn("sections", F.lit("clash"))
    assert token_counts.count_tokens(docs).count() == 2


# --- odd tables and long texts ---------------------------------------------------------


def test_stages_take_empty_tables(make, spark):
    empty = make([(1, "x")]).limit(0)
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert near_dups.keep_one(empty).count() == mixing.emit_copies(empty).count() == lines.without_repeated_lines(empty).count() == 0
    assert decontam.find_leaks(empty, bench).count() == decontam.drop_leaking(empty, bench).count() == substrings.factors(empty).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0


def test_very_long_texts(make, spark):
    rnd = random.Random(9)
    long = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(600_000))  # over 4 MB
    assert len(long) > 4_000_000
    item = "What is the largest planet around the warm yellow sun"
    rows = [(1, long), (2, long + " . " + item + " ."), (3, "x" * 5_000_000), (4, "short\n" * 700_000)]
    docs = make(rows)
    assert {r["doc_id"]: r["component_id"] for r in near_dups.digest(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.digest(docs).collect()}
    assert got == {1: (600_000, 600_000), 2: (600_000 + 12, 600_000), 3: (1, 0), 4: (700_000, 700_000)}
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.find_leaks(docs, bench).collect()} == {2}
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix_sources(docs).collect()}
    assert sizes == {1: 600_000, 2: 600_012, 3: 1, 4: 700_000}
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in lines.digest(docs).collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (1, 0), 4: (700_001, 0)}


# --- files ----------------------------------------------------------------------------


def _left(spark):
    root = tables.shared_dir(spark)
    return {p for p in os.listdir(root) if p.startswith("flowjobs-")}


def test_the_pipeline_leaves_its_result_alone(spark, monkeypatch):
    tables.clean(spark)
    before = _left(spark)
    out = corpus_pipeline.run(spark, SF)
    assert len(_left(spark) - before) == 1 and out.count() > 0
    tables.clean(spark)
    assert _left(spark) == before

    def fails(spark, docs, sf_dir):
        tables.cut(docs)
        raise RuntimeError("stage failed")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[1], ("fails", fails)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, SF)
    assert _left(spark) == before


def test_a_cluster_needs_a_shared_folder():
    fake = lambda master, conf=None, given=None: types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: conf), sparkContext=types.SimpleNamespace(getCheckpointDir=lambda: given, master=master, applicationId="a"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables.shared_dir(fake(master))
        assert tables.shared_dir(fake(master, given="/shared/x/")) == "/shared/x"
        assert tables.shared_dir(fake(master, conf="/shared/y")) == "/shared/y"


def test_digest_of_kept_text_is_of_the_words(spark):
    docs = spark.createDataFrame([(1, "a  b\tc\n"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["kept_sha256"], r["kept_text"]) for r in substrings.remove_duplicate_windows(docs).collect()}
    assert got == {1: (hashlib.sha256(b"a b c").hexdigest(), "a b c"), 2: (hashlib.sha256(b"").hexdigest(), "")}


def test_components_of_random_graphs(spark):
    from flowjobs.llm.components import connected_components

    rnd = random.Random(12)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(40)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root if any(n in e and e[0] != e[1] for e in edges)}


def test_the_first_index_row_that_two_signatures_share():
    assert near_dups._first_shared(np.zeros((0, 32), bool)).tolist() == []
    differ = np.zeros((4, 32), bool)
    differ[1, [0, 1]] = True  # chunk 0 differs in two symbols, chunk 1 in none
    differ[2, 2] = True  # chunk 0 but for its third symbol
    differ[3] = True
    assert near_dups._first_shared(differ).tolist() == [0, 4, 2, -1]


def test_a_large_bucket_is_compared_in_cells(make):
    """Two families that meet in buckets: near copies within each, none between them, and some members that link to nothing."""
    rnd = random.Random(21)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        w = list(base) if i % 2 else base[:150] + [f"z{j}" for j in range(50)]
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(200)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = make(rows)
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for _, t in rows]
    root = list(range(400))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(400):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {i: find(i) for i in range(400)}
    for small, block in ((64, 256), (3, 16)):
        assert {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(docs, small=small, block=block).collect()} == want
