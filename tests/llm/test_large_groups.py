"""Large groups of texts alike: rows that the last round of near-dedup makes, and links between sets of different sizes."""

import random

from pyspark.sql import functions as F

from flowjobs.llm import near_dups


def test_buckets_with_the_same_members_are_compared_once(spark, monkeypatch):
    def counted(chunks, percent):
        def run(key, table):
            import pyarrow as pa

            return pa.table({"a": pa.array([table.num_rows]), "b": pa.array([0])})

        return run

    monkeypatch.setattr(near_dups, "_cells", counted)
    nodes = spark.range(600).select(F.col("id").alias("node"))
    members = nodes.select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("slot"), F.lit(7).cast("long").alias("key"), "node", F.col("node").alias("component"))
    classes = nodes.select("node", F.lit(100).cast("long").alias("n"), F.col("node").alias("g0"), F.col("node").alias("g1"))
    sets = nodes.select("node", F.array("node").alias("set"))
    made = near_dups._large_links(members, classes, sets, 2, 85, 256).agg(F.sum("a")).first()[0]
    # Three blocks and one for the main component, a single text. As ten buckets it would be ten times as many.
    assert made == 599 * 4 + 3


def test_buckets_that_hang_together_by_single_texts_stay_buckets(spark):
    # Twenty buckets of 70 in a chain; two buckets of the same 70.
    rows = [(3, k, 69 * k + i, 69 * k + i) for k in range(20) for i in range(70)]
    rows += [(s, 9, 10_000 + i, 10_000 + i) for s in (4, 5) for i in range(70)]
    members = spark.createDataFrame(rows, "slot int, key long, node long, component long")
    got = near_dups._families(members)
    assert {tuple(r) for r in got.where("slot >= 0").collect()} == set(rows[:1400])
    family = [tuple(r) for r in got.where("slot < 0").collect()]
    assert len(family) == 70 and {r[1] for r in family} == {10_000} and {r[2] for r in family} == set(range(10_000, 10_070))


def test_links_between_bands_of_sizes(make):
    """Texts that go on for longer and longer, and some with words of their own: links lie within a band and between two."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(260)]
    rows = []
    for i in range(300):
        w = base[: rnd.randrange(90, 260)]
        for _ in range(rnd.choice((0, 0, 1, 2, 5))):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(300))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(300):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {i: find(i) for i in range(300)}
    for small, block in ((3, 256), (3, 16)):
        got = near_dups.near_duplicates(make(rows), small=small, block=block).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
