"""Cases of the first review, with plain Python versions that have none of the operators' short cuts."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import numpy as np  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from flowjobs.llm import decontam, near_dups  # noqa: E402

COST = "If 3 kg cost 12 dollars and 5 kg cost 20 dollars, what do 9 kg cost?"
SUM = "Compute 12 + 35 * 4 - 7 / 2"
TITLE = "The Old Man And The Grey Sea Of Winter"
LIST = "Add 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 and stop"


def found(spark, docs, items):
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]): (r["share"], r["run_tokens"], r["verbatim"]) for r in got.collect()}


def test_items_full_of_slots_are_found(spark):
    items = [(1, COST), (2, SUM), (3, TITLE), (4, LIST), (5, "77 66 55")]
    docs = [(i, f"Some plain words before. {t} Some after.") for i, t in items]
    assert {k: v[2] for k, v in found(spark, docs, items).items()} == {(i, i): True for i in range(1, 6)}
    other = [(1, COST.replace("12", "18").replace("20", "30")), (2, SUM.replace("35", "36")), (4, LIST.replace(" 9 ", " 99 "))]
    assert {k: v[0] for k, v in found(spark, other, items).items()} == {(i, i): 1.0 for i in (1, 2, 4)}
    clean = [(1, "The New Art Museum Of Modern Rome And Paris"), (2, "Rows: 5 6 7 8 9 10 11 12 14 15 16 18 19"), (3, "If 3 kg cost more, 77 66 54 is wrong"), (4, COST.replace("3 kg", "4 kg", 1).replace("5 kg cost 20", "3 kg cost 20").replace("12 dollars", "3 dollars"))]
    assert set(found(spark, clean, items)) <= {(4, 1)}


def test_verbatim_items_without_a_literal_rule(spark):
    """Every verbatim copy, by plain search of token lists."""
    rnd = random.Random(11)
    word = lambda: rnd.choice(["Anna", "Bob", "Eva", "3", "12", "2.5", "kg", "km", "dollars", "Rome", "then", "rain", "fell"])
    items = [(i, "so " + " ".join(word() for _ in range(rnd.choice([3, 5, 7, 8, 9, 20])))) for i in range(30)]
    docs = [(i, "and " * 3 + ". " + " ".join(word() for _ in range(20)) + ". " + rnd.choice(items)[1] + ". " + " ".join(word() for _ in range(10))) for i in range(60)]
    plain = lambda t: [v for _, v, _ in brute.template(t)]
    want = set()
    for d, text in docs:
        for i, item in items:
            a, b = plain(text), plain(item)
            if any(a[p : p + len(b)] == b for p in range(len(a) - len(b) + 1)):
                want.add((d, i))
    got = found(spark, docs, items)
    assert len(want) >= 60 and want <= set(got)
    assert all(got[k][0] == 1.0 for k in want)


def test_items_within_a_sentence(spark):
    items = [(1, "What is the largest planet around the sun"), (2, "Who was first"), (3, "Name three long rivers"), (4, "Why did the old dog run from home"), (5, "Anna ate seven old apples and two pears"), (6, "The Old Man And The Grey Sea Of Winter")]
    docs = [(i, f"quiz, {t} again") for i, t in items] + [(10, "Kim ate seven old apples and two pears"), (11, "so Kim ate seven old apples and two pears"), (12, "quiz, Bob was first"), (13, "quiz, The New Art Museum Of Modern Rome And Paris")]
    got = found(spark, docs, items)
    assert {k for k in got if k[0] < 10} == {(i, i) for i in range(1, 7)} and all(got[i, i] == (1.0, len(t.split()), True) for i, t in items)
    assert {k for k in got if k[0] >= 10} == {(10, 5), (11, 5)} and got[11, 5] == (1.0, 8, False)


def test_stages_keep_clean_rows_with_null_ids(spark):
    item = "What is the largest planet around the sun"
    same = " ".join(f"w{i}" for i in range(60))
    twice = "Did Anna give 5 apples to Bob before Anna took 5 pears and Bob sold 9 plums to Eve"
    torn = twice.replace("Anna took", "Max took")
    rows = [(None, "a clean text that stands once"), (None, f"so {item} then"), (None, same), (None, same + " more"), (3, same + " and x"), (None, "other " + same.replace("w", "v")), (None, "another " + same.replace("w", "v")), (None, torn), (None, twice), (4, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, twice)], "item_id long, text string")
    left = {tuple(r) for r in decontam.drop_leaking(docs, bench).collect()}
    assert left == {r for r in rows if item not in r[1] and r[1] != twice}
    kept = sorted(tuple(r) for r in near_dups.keep_one(docs).where("text like '%w1 %' or text like '%v1 %' or doc_id = 4 or text like 'a clean%'").select(F.coalesce("doc_id", F.lit(-1)), F.substring("text", 1, 1)).collect())
    assert len(kept) == 4 and {k for k in kept if k[0] > 0} == {(3, "w"), (4, "x")} and sum(k == (-1, "o") or k == (-1, "a") for k in kept) == 2


def test_stage_links_from_a_similarity_of_0_8(spark):
    # One word of 60 changed in the middle: 51 of 61 shingles in common, 0.836.
    words = [f"w{i}" for i in range(60)]
    near = [*words[:30], "other", *words[31:]]
    # Changes of 0.75 stay apart: 48 of 64.
    far = [f"v{i}" for i in range(60)]
    apart = [*far[:20], "other", "x", "y", "z", *far[24:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(apart))], "doc_id long, text string")
    assert {r["doc_id"] for r in near_dups.keep_one(docs).collect()} == {1, 3, 4}
    assert {r["doc_id"] for r in near_dups.digest(docs).where("kept").collect()} == {1, 2, 3, 4}


def test_signatures_up_to_the_distance_share_an_index_row(spark):
    rnd = np.random.default_rng(4)
    assert [near_dups.chunks_for(p) for p in (85, 80)] == [8, 12]
    for chunks in (8, 12):
        rows = []
        for _ in range(100):
            a = rnd.integers(0, 1 << 16, 4 * chunks).astype(np.uint16)
            b = a.copy()
            b[rnd.choice(4 * chunks, near_dups.distance(chunks), replace=False)] ^= np.uint16(1)
            rows += [a.view(np.int64).tolist() + b.view(np.int64).tolist()]
        names = near_dups._names(chunks)
        df = spark.createDataFrame(rows, ", ".join(f"{g}_{s} long" for s in "ab" for g in names))
        keys = [df.select(*(F.col(f"{g}_{s}").alias(g) for g in names)).select(near_dups.index_keys(chunks).alias("k")).collect() for s in "ab"]
        assert all(set(x["k"]) & set(y["k"]) for x, y in zip(*keys, strict=True))
        apart = df.select(sum(near_dups._differ(F.col(f"{g}_a"), F.col(f"{g}_b")) for g in names).alias("d")).collect()
        assert {r["d"] for r in apart} == {near_dups.distance(chunks)}
