"""Decontamination and the whole pipeline against plain Python."""

import collections
import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from flowjobs.llm import decontam, quality  # noqa: E402
from flowjobs.llm.tables import read  # noqa: E402

PLAIN = "then they walked along until rain fell while birds sang over hills near our old house because nobody knew where time went".split()
NAMES = "Anna Bob Carla Dirk Eva Farid".split()


def sentence(rnd, k):
    out = []
    for _ in range(k):
        x = rnd.random()
        out.append(rnd.choice(NAMES) if x < 0.12 else str(rnd.choice([3, 12, "1,500", "2.5"])) if x < 0.22 else rnd.choice(["km", "kg", "dollars"]) if x < 0.3 else rnd.choice(PLAIN))
    return " ".join(out) + rnd.choice(["", ".", "!"])


def test_decontamination_matches_brute_force(spark):
    rnd = random.Random(5)
    items = [(i, sentence(rnd, rnd.choice([4, 6, 9, 15, 30]))) for i in range(12)]
    docs = []
    for i in range(80):
        text = [sentence(rnd, rnd.randrange(1, 40))]
        if i % 2:
            words = rnd.choice(items)[1].split()
            swap = dict(zip(NAMES, rnd.sample(NAMES, len(NAMES)), strict=True)) if i % 3 else {}
            words = [swap.get(w, w) if w in swap else w for w in words]
            if i % 5 == 0:
                words = [rnd.choice(NAMES) if w in NAMES else w for w in words]
            if i % 7 == 0:
                words = words[len(words) // 3 :]
            text += [" ".join(words), sentence(rnd, 10)]
        docs.append((i, rnd.choice([" ", "\n"]).join(text)))
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute.leaks(docs, items)
    assert len(want) > 10
    assert {(r["doc_id"], r["item_id"]): (r["share"], r["run_tokens"]) for r in got.collect()} == want


def test_pipeline_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    documents = read(spark, sf, "documents")
    good = {r["doc_id"] for r in quality.score_quality(documents, read(spark, sf, "labels")).where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    source = {i: s for i, _, s in rows}
    docs = brute.keep_one(brute.dedup_lines([(i, t) for i, t, _ in rows if i in good]))
    leaking = {i for i, _ in brute.leaks(docs, [tuple(r) for r in read(spark, sf, "benchmark").select("item_id", "text").collect()])}
    want = collections.Counter(brute.mix([(i, t, source[i]) for i, t in docs if i not in leaking]))
    got = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want
