"""Filter audit against all orders applied one by one."""

import collections
import itertools
import random

import duckdb
import pytest

from flowjobs.llm import filter_audit
from flowjobs.llm.tables import read

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(rows):
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = t.encode().split()
        out.append({
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and t in smallest and i > smallest[t],
        })
    return out


def brute(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    parts = collections.defaultdict(list)
    for (i, _, lang), f in zip(rows, fails(rows), strict=True):
        parts[lang or ""].append((i, f))
    out = {}
    for part, docs in parts.items():
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[x]]
                failing = sum(f[x] for _, f in docs)
                left = [(i, f) for i, f in left if not f[x]]
                total[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in docs), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["a", "word", "Upper", "CAPS", "é", "x1", "#tag", "fine", "one", "two"]) + (str(rnd.randrange(400)) if i % 3 else "") for _ in range(rnd.choice([3, 150, 220, 300]))) for i in range(60)]
    rows = [(i, rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for i in range(150)]
    rows += [(3, rows[3][1], "en"), (3, rows[3][1], "de"), (None, texts[0], "en"), (None, None, None), (200, None, "fr"), (201, "", "fr"), (202, "x " * 50_000, "fr"), (203, "Ä" * 90_000, "fr"), (204, " \t\n", "xx")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 210, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("part", "key", "bits", "n", "first", "A", "good", "edge"):
        docs = docs.selectExpr("*", f"'clash' as `{c}`") if c.lower() not in [x.lower() for x in docs.columns] else docs
    return rows, labels, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'clash' as part", "'clash' as good")


def test_matches_brute_force(corpus):
    rows, labels, docs, table = corpus
    assert rows_of(filter_audit.digest(docs, table)) == brute(rows, labels)


def test_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(filter_audit.ORACLE_SQL)
    got = filter_audit.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    assert got.columns == want.columns
    assert rows_of(got) == sorted(want.fetchall())


def test_empty_tables(corpus):
    _, _, docs, labels = corpus
    assert filter_audit.digest(docs.limit(0), labels).count() == 0
    assert {r["good_lost"] + r["toxic_lost"] for r in filter_audit.digest(docs, labels.limit(0)).collect()} == {0}


def test_paths_of_the_lattice():
    free = filter_audit.Lattice(4)
    assert free.backward[0] == free.forward[15] == 24 == len(free.orders())
    bound = filter_audit.Lattice(4, [(0, 1), (2, 1)])
    orders = [o for o in itertools.permutations(range(4)) if o.index(0) < o.index(1) and o.index(2) < o.index(1)]
    assert sorted(map(tuple, bound.orders())) == sorted(orders) and bound.backward[0] == len(orders)
    taken = collections.Counter((sum(1 << f for f in o[:k]), o[k]) for o in orders for k in range(4))
    assert {(s, f): n for s, f, n in bound.edges()} == taken


def test_filters_that_keep_their_order(spark):
    rows = spark.createDataFrame([("p", True, True, None), ("p", False, True, True), ("p", False, False, False)], "part string, x boolean, y boolean, z boolean")
    got = filter_audit.audit(rows, ["x", "y", "z"], before=[("x", "y")]).collect()
    assert {r["filter_order"] for r in got} == {"xyz", "xzy", "zxy"}
    assert {r["filter_order"][r["step"] - 1]: r["shapley"] for r in got} == {"x": 3, "y": 1, "z": 2}
    with pytest.raises(ValueError):
        filter_audit.audit(rows, ["x", "y"], before=[("x", "y"), ("y", "x")])
