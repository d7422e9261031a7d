"""Operators on texts against brute force, and their edge cases."""

import base64
import collections
import hashlib
import random
import re

import pytest

from flowjobs.llm import decontam, licenses, lines, mixing, near_dups, substrings, token_counts
from flowjobs.llm.tables import cut, read

VOCAB = "the of and to in is it was for on are with as at by an be this that from or had not but what all were when we there can".split()
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def corpus(seed=1, n=60):
    """Small invented texts with copies, near copies, shared passages, repeats, and odd rows."""
    rnd = random.Random(seed)
    text = lambda k: " ".join(rnd.choice(VOCAB) + rnd.choice(["", "", "x", "é", "Q", "ing"]) + str(rnd.randrange(50)) for _ in range(k))
    passage = text(60)
    out = []
    for i in range(n):
        t = text(rnd.randrange(1, 120))
        if i % 7 == 1:
            t = f"{t} {passage}\n{text(5)}"
        if i % 9 == 2 and out:
            t = out[-1][1] or ""
        if i % 9 == 4 and out and out[-1][1]:
            w = out[-1][1].split()
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        if i % 11 == 3:
            t = "again and " * 50
        out.append((i, t))
    out += [(900, None), (901, ""), (902, " \t\n "), (903, "one"), (904, "mit  License"), (None, text(40)), (None, None), (5, out[5][1]), (905, "long " + text(4000)), (906, "ÄÖ 𝔘nicode space " * 20)]
    return out


@pytest.fixture(scope="module")
def docs(make):
    return make(corpus())


def by_row(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def spaced(text):
    return (text or "").encode().split()


def test_substrings_match_brute_force(docs):
    rows = corpus()
    for window, gram in ((35, 8), (6, 3), (1, 1)):
        seen = collections.Counter(tuple(w[j : j + window]) for _, t in rows for w in [spaced(t)] for j in range(len(w) - window + 1))
        want = collections.Counter()
        for i, t in rows:
            w = spaced(t)
            gone = [False] * len(w)
            for j in range(len(w) - window + 1):
                if seen[tuple(w[j : j + window])] > 1:
                    gone[j : j + window] = [True] * window
            kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
            want[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
        got = by_row(substrings.remove_duplicate_windows(docs, window, gram), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == want


def test_near_duplicates_match_brute_force(docs):
    rows = corpus()
    sets = []
    for _, t in rows:
        w = [x.lower() for x in spaced(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    want = collections.Counter()
    for i, (doc, _) in enumerate(rows):
        comp = low.get(find(i)) if sets[i] else doc
        want[doc, len(sets[i]), comp, (doc is not None and doc == comp) if sets[i] else True] += 1
    for small, block in ((64, 2048), (2, 3)):
        got = by_row(near_dups.near_duplicates(docs, small=small, block=block), "doc_id", "n_shingles", "component_id", "kept")
        assert got == want


def test_large_group_of_near_copies(make):
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(150)] = f"x{rnd.randrange(1000)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for _, t in rows]
    root = list(range(150))
    for _ in range(150):
        before = list(root)
        for i in range(150):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if before == root:
            break
    got = {r["doc_id"]: r["component_id"] for r in near_dups.digest(make(rows)).collect()}
    assert [got[i] for i in range(150)] == root


def test_thousands_of_near_copies_in_one_bucket(make):
    """5,000 different near copies and a family of texts that look alike but are no copies."""
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(5000):
        w = list(base)
        w[rnd.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(w)))
    # Three quarters of the words in common: within the distance, under the similarity.
    family = [f"v{i}" for i in range(300)]
    rows += [(10_000 + i, " ".join([*family, *(f"y{i}_{j}" for j in range(80))])) for i in range(200)]
    got = {r["doc_id"]: r["component_id"] for r in near_dups.digest(make(rows)).collect()}
    assert got == {i: 0 if i < 5000 else i for i, _ in rows}


def test_long_words_with_one_polynomial_hash_stay_apart(make):
    # A word over a and b in which all powers cancel out, and its mirror image.
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    mirror = word.translate(str.maketrans("ab", "ba"))
    got = {r["doc_id"]: r["component_id"] for r in near_dups.digest(make([(1, word), (2, mirror), (3, word)])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_kept_rows_carry_their_columns(docs):
    kept = near_dups.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids))


def test_lines(make):
    rows = [(2, "keep me\nA shared line here\nshort"), (1, "  a SHARED line here\t\nshort"), (3, "a shared line here\na shared line here"), (3, "a shared line here\na shared line here"), (None, "a shared line here\nnull id"), (9, None), (8, ""), (7, "only once, twice within\nonly once, twice within"), (6, "Ärger Ärger Ä\nx"), (5, "ärger ärger ä")]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in lines.dedup_lines(make(rows)).collect()), key=str)
    want = [(2, 3, 1, "keep me\nshort"), (1, 2, 0, "  a SHARED line here\t\nshort"), (3, 2, 2, ""), (3, 2, 2, ""), (None, 2, 1, "null id"), (9, 1, 0, ""), (8, 1, 0, ""), (7, 2, 0, rows[7][1]), (6, 2, 0, rows[8][1]), (5, 1, 0, rows[9][1])]
    assert got == sorted(want, key=str)


def test_bitmaps_of_long_documents(make):
    many = [f"line number {i} of many" for i in range(300)]
    rows = [(1, "\n".join(many[::2])), (2, "\n".join(many))]
    out = {r["doc_id"]: r for r in lines.dedup_lines(make(rows)).collect()}
    assert out[2]["n_dropped"] == 150 and out[2]["kept_text"].split("\n") == many[1::2] and out[1]["n_dropped"] == 0
    new = lines.without_repeated_lines(make(rows))
    assert new.columns == make(rows).columns


def test_mixing(make):
    rows = [(i, "w " * (i % 13), f"s{i % 3}") for i in range(120)] + [(200, "a b c", None), (201, None, "s1"), (202, "", "empty"), (5, "w " * 5, "s2")]
    mixed = mixing.mix_sources(make(rows))
    got = mixed.select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    assert len(got) == len(rows)
    again = mixing.mix_sources(make(rows)).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    total = sum(r["size"] for r in got)
    targets = {r["source"]: (r["source_size"], r["target"]) for r in got}
    assert abs(sum(t for _, t in targets.values()) - total) < 1e-6 and all(t <= 3 * s for s, t in targets.values())
    for source, (_, target) in targets.items():
        taken = sum(r["size"] * r["copies"] for r in got if r["source"] == source)
        assert abs(taken - target) <= 2 * 13 and all(r["copies"] <= 3 for r in got)
    emitted = mixing.emit_copies(make(rows))
    assert emitted.columns == make(rows).columns and emitted.count() == sum(r["copies"] for r in got)


def test_licenses(docs, make):
    rows = corpus()
    phrases = [tuple(p.encode().split()) for p, _ in licenses.PHRASES]
    want = collections.Counter()
    for i, t in rows:
        w = WORD.findall((t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
        at = [j for p in phrases for j in range(len(w)) if tuple(w[j : j + len(p)]) == p]
        want[i, len(w), len(at), min(at, default=None), max(at, default=None)] += 1
    assert by_row(licenses.digest(docs), "doc_id", "n_words", "n_base", "first_word", "last_word") == want
    notice = licenses.NOTICES[0][0].split()
    broken = " ".join([*notice[:7], "extra", "words", *notice[7:]])
    got = {r["doc_id"]: r for r in licenses.digest(make([(1, "Intro. " + broken), (2, "MIT License, mit license; CC-BY"), (3, "nothing of it")])).collect()}
    assert got[1]["labels"] == "mit-text" and got[1]["n_base"] == 0 and 0.5 <= got[1]["score"] < 1
    assert (got[2]["n_base"], got[2]["base_labels"], got[2]["first_word"], got[2]["last_word"], got[2]["score"]) == (3, "cc-by,mit", 0, 4, 1.0)
    assert (got[3]["labels"], got[3]["score"]) == ("", 0.0)


ITEM = "A train leaves Paris with 120 people and stops after 35 km where Anna gets on with 4 bags and Bob gets off"


def test_decontamination(make, spark):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "what is seven plus eight")], "item_id long, text string")
    other = ITEM.replace("120", "1,500").replace("35 km", "7.5 miles").replace("Anna", "Zoe").replace("Paris", "Rome")
    clash = ITEM.replace("Bob gets off", "Anna gets off")
    rows = [(1, f"x. {ITEM} y."), (2, f"some text then {other}"), (3, "a train leaves"), (4, None), (5, ""), (None, ITEM), (7, "so what is seven plus eight then"), (10, "He said: tell me, What is seven plus eight?"), (8, ITEM), (8, ITEM), (9, " ".join(VOCAB * 30))]
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontam.find_leaks(make(rows), bench).collect()}
    assert got == {(1, 1): True, (2, 1): False, (None, 1): True, (7, 4): True, (10, 4): True, (8, 1): True}
    twice = spark.createDataFrame([(1, "Did Anna give 5 apples to Bob before Anna took 5 pears and Bob sold 9 plums to Eve")], "item_id long, text string")
    same = "Did Kim give 6 apples to Lou before Kim took 6 pears and Lou sold 9 plums to Eve"
    torn = "Did Kim give 6 apples to Lou before Max took 6 pears and Lou sold 9 plums to Eve"
    assert {r["doc_id"] for r in decontam.find_leaks(make([(1, same), (2, torn)]), twice).collect()} == {1}
    left = decontam.drop_leaking(make(rows), bench)
    assert left.columns == make(rows).columns and {r["doc_id"] for r in left.collect()} == {3, 4, 5, 9}
    assert clash and decontam.find_leaks(make(rows), bench.limit(0)).count() == 0


def test_decontamination_without_filter_is_the_same(make, spark, monkeypatch):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    want = by_row(decontam.find_leaks(make([(1, ITEM), (2, "no")]), bench), "doc_id", "share")
    monkeypatch.setattr(decontam, "FILTER_WINDOWS", 0)
    assert by_row(decontam.find_leaks(make([(1, ITEM), (2, "no")]), bench), "doc_id", "share") == want


def test_token_counts(make, spark):
    import tiktoken

    with open(token_counts.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "A line.\nAnother line\n\nlast"), (2, None), (3, ""), (4, "ÄÖ 🙂🙂 é"), (5, "x" * 30_000), (1, "twice the id"), (6, "\n")]
    got = token_counts.count_tokens(make(rows)).collect()
    totals = collections.Counter()
    for r in got:
        totals[r["doc_id"]] += r["n_tokens"]
    want = collections.Counter()
    for i, t in rows:
        want[i] += len(enc.encode_ordinary(t or ""))
    assert totals == want
    spans = [(r["start_char"], r["end_char"]) for r in sorted((r for r in got if r["doc_id"] == 4), key=lambda r: r["section"])]
    assert spans == [(0, len(rows[3][1]))]
    # " tokenization" is cut by sections; brute force over characters gives the owners.
    text = "tokenization is tokenization and internationalization"
    cuts = [(0, 4), (4, 20), (22, 40), (40, len(text))]
    for rule in token_counts.RULES:
        df = spark.createDataFrame([(1, text, cuts)], "doc_id long, text string, sections array<struct<start:int,end:int>>")
        got = {r["section"]: r["n_tokens"] for r in token_counts.count_tokens(df, rule=rule).collect()}
        want, at = collections.Counter(), 0
        for token in enc.encode_ordinary(text):
            end = at + len(enc.decode([token]))
            over = [max(0, min(e, end) - max(s, at)) for s, e in cuts]
            if not any(over):
                want[-1] += 1
            elif rule == "most":
                want[over.index(max(over))] += 1
            elif rule == "start":
                want[next(k for k, o in enumerate(over) if o)] += 1
            else:
                for k, o in enumerate(over):
                    want[k] += o / (end - at)
                want[-1] += 1 - sum(over) / (end - at)
            at = end
        assert {k: round(v, 6) for k, v in got.items() if v} == {k: round(v, 6) for k, v in want.items() if round(v, 6)}
    with pytest.raises(ValueError):
        token_counts.count_tokens(make(rows), rule="any")


@pytest.mark.parametrize("op", [substrings.digest, near_dups.digest, lines.digest, mixing.digest, licenses.digest, token_counts.digest])
def test_empty_tables(make, op):
    assert op(make([(1, "x")]).limit(0)).count() == 0


def test_cut_needs_no_recompute(spark, sf_dir):
    df = cut(read(spark, sf_dir, "benchmark"))
    other = cut(df)
    assert other.count() == df.count()
    assert "parquet" in df._jdf.queryExecution().toString().lower() and df.count() == read(spark, sf_dir, "benchmark").count()
