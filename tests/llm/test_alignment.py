"""Cross-tokenizer alignment against plain Python with the two tokenizers' own files."""

import collections
import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from flowjobs.llm import alignment
from flowjobs.llm.tables import read


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(alignment.VOCABULARY_A)
    a.encode_special_tokens = True
    with open(alignment.VOCABULARY_A, "rb") as f:
        ranks = {i: t for t, i in alignment.byte_ranks(f.read()).items()}
    return a, ranks, sentencepiece.SentencePieceProcessor(model_file=alignment.VOCABULARY_B)


def plain(tools, text):
    """[([a ids], [b ids])] of a text, by sets of ends."""
    a, ranks, b = tools
    if not text:
        return []
    want = b" " + text.encode()
    ids_a = a.encode(f" {text}", add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [ranks[i] for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return []
    ends = [np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b)]
    shared = sorted(set(ends[0]) & set(ends[1]))
    out, i, j = [], 0, 0
    for cut in shared:
        p, q = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
        out.append((ids_a[i:p], ids_b[j:q]))
        i, j = p, q
    return out


def brute(tools, rows):
    groups = [plain(tools, t) for _, t in rows]
    linked = [collections.Counter((x, y) for p, q in g for x in p for y in q) for g in groups]
    count = collections.Counter(k for c in linked for k in c)
    best = collections.Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = collections.Counter()
    for (i, _), g, c in zip(rows, groups, linked, strict=True):
        line = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in g)
        out[
            i, sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), sum(c.values()),
            sum(n for (x, y), n in c.items() if count[x, y] == best[x]), sum(n * count[k] for k, n in c.items()), hashlib.sha256(line.encode()).hexdigest() if g else "",
        ] += 1
    return out


ODD = [
    (1, None), (1, None), (2, ""), (None, "text of nobody"), (None, None), (3, "▁ is no space"), (4, "ÄÖ 🙂 漢字かな עברית 👍🏽‍"), (5, "a <|endoftext|> b </s> <s> <unk> <0x41>"), (6, " leading  and   many    spaces \t\n\r\n end "),
    (7, "-" * 333 + "=" * 77), (8, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa b"), (9, "\x00\x01\x7f﻿ "), (9, "same id, other text"), (9, "same id, other text"), (10, "x" * 5000), (11, "1234567890 12 345"), (12, "'s it's I'll WE'RE"),
]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df):
    return collections.Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("block", [alignment.BLOCK_BYTES, 3000])
def test_matches_brute_force(spark, make, tools, block):
    docs = [(r["doc_id"], r["text"]) for r in read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()] + ODD
    got = rows_of(alignment.digest(make(docs), block_bytes=block))
    assert got == brute(tools, docs)


def test_long_texts_in_parts(spark, make, tools):
    rnd = random.Random(0)
    words = "the of water it's über 12 straße, (and) … so-called x  y".split(" ")
    text = " ".join(rnd.choice(words) for _ in range(60_000))
    spans = alignment.parts(text)
    assert len(spans) > 3 and spans[0][0] == 0 and spans[-1][1] == len(text) and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    docs = [(1, text), (2, "y" * 200_000), (3, "漢" * 50_000)]
    assert rows_of(alignment.digest(make(docs))) == brute(tools, docs)


def test_empty_table(spark, make):
    empty = make([(1, "x")]).limit(0)
    assert alignment.digest(empty).count() == 0 and alignment.align(empty).count() == 0 and alignment.token_map(empty).count() == 0


def test_groups_spell_the_text(spark, tools):
    docs = [(i, t) for i, (_, t) in enumerate(ODD)]
    got = {r["doc_id"]: r for r in alignment.align(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        r, want = got[i], plain(tools, text)
        pairs = list(zip([0, *r["a_stops"]], r["a_stops"], [0, *r["b_stops"]], r["b_stops"], strict=False))
        assert [(r["a_ids"][p:q], r["b_ids"][s:e]) for p, q, s, e in pairs] == want


def test_division_of_random_ends():
    rnd = np.random.default_rng(0)
    for density in (0.05, 0.3, 0.9):
        a, b, first_a, first_b, base = [], [], [0], [0], 0
        for _ in range(50):
            n = int(rnd.integers(0, 60))
            last = [n] if n else []
            for ends, first in ((a, first_a), (b, first_b)):
                ends += [base + x for x in sorted({*(np.flatnonzero(rnd.random(n) < density) + 1).tolist(), *last})]
                first.append(len(ends))
            base += n
        a, b, first_a, first_b = map(np.array, (a, b, first_a, first_b))
        ends_a, ends_b = alignment.divide(a, b, first_a, first_b)
        assert a[ends_a].tolist() == b[ends_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_large_groups_pair_each_id_once():
    a, b = np.array([1, 2, 1, 3]), np.array([7, 7, 8])
    x = alignment.Aligned(a, b, np.array([0, 4]), np.array([0, 3]), np.array([4]), np.array([3]), np.array([0, 1]))
    want = collections.Counter((i << 32) | j for i in a.tolist() for j in b.tolist())
    for chunk in (1, 5, 1000):
        row, key, times = alignment.linked_pairs(x, chunk)
        assert dict(zip(key.tolist(), times.tolist(), strict=True)) == want and (row == 0).all()


def test_a_task_holds_few_blocks_at_once(make):
    """Blocks are long rows: files have small row groups, links take few bytes, and no task collects the counts of many blocks."""
    docs = make([(i, f"text number {i} of some, aaaaaaaaaaaaaaaaa {'é' * (i % 40)}") for i in range(400)]).coalesce(1)
    aligned = alignment.blocks(docs, block_bytes=500)
    groups = []
    for f in aligned.inputFiles():
        data = pq.ParquetFile(f.removeprefix("file://")).metadata
        groups += [data.row_group(k).num_rows for k in range(data.num_row_groups)]
    assert sum(groups) == aligned.count() > 40 and max(groups) <= 16
    for r in aligned.collect():
        assert len(r["at"]) <= 2 * r["first"][-1] and len(r["times"]) <= 2 * r["first"][-1]
    assert "collect_list" not in alignment.digest(docs, block_bytes=500)._jdf.queryExecution().optimizedPlan().toString()


def test_packed_links_come_back():
    for top in (0, 255, 256, (1 << 16) - 1, 1 << 16, (1 << 32) - 1, 1 << 32, (1 << 62) + 1):
        values = np.array([0, 1, top], np.int64)
        got = alignment._unpack(alignment._pack(values)[0].as_py(), 3)
        assert got.dtype == np.int64 and got.tolist() == values.tolist()
    assert alignment._unpack(alignment._pack(np.zeros(0, np.int64))[0].as_py(), 0).tolist() == []


def test_a_pair_many_times_in_a_text(make, tools):
    docs = [(1, "the same " * 400), (2, "the same text"), (3, None)]
    block = alignment.blocks(make(docs).coalesce(1)).collect()
    assert len(block) == 1 and len(block[0]["times"]) == 2 * block[0]["first"][-1] and len(block[0]["at"]) == block[0]["first"][-1]
    assert rows_of(alignment.digest(make(docs).coalesce(1))) == brute(tools, docs)
