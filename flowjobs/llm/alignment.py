"""Cross-tokenizer alignment by divide and conquer at shared cuts (operator 13).

A text is encoded by two tokenizers whose tokens' bytes spell the same string. Byte
offsets where tokens of both end cut the tokens into groups. An interval of tokens
is divided at a shared end near its middle, which bisection of the other side's ends
finds; both halves go on in the same way, and an interval without a shared end
inside is a group. All intervals of a block of texts take each step together, as
numpy arrays. How often two tokens stand in one group is then counted over the
corpus by Spark: blocks send each pair once, whatever number of texts hold it.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as W
from .tables import cut
from .token_counts import PATTERN

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"
#: bytes of texts that are aligned at once; a longer text is a block of its own
BLOCK_BYTES = 1 << 20
#: a longer text is encoded in parts of about so many characters
PART_CHARS = 1 << 16
#: Neither tokenizer joins what stands before such a space with what follows it.
_SEAM = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
#: pairs of tokens of one block that are spelled out at once
PAIRS = 1 << 20
#: blocks of one row group, some 8 MB; a task has a group of each file it reads in memory
GROUP_ROWS = 16

_LISTS = {"doc_id": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "first": "long"}
#: the links of a block's texts, text after text: place of the pair in the block's list of pairs, and how often the text has it
_PACKED = ("at", "times")
_BLOCKS = "block long, pairs array<long>, n_docs array<long>, " + ", ".join(f"{k} array<{v}>" for k, v in _LISTS.items()) + "".join(f", {k} binary" for k in _PACKED)


def byte_ranks(vocabulary: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level vocabulary, whose characters stand for one byte each."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    model = json.loads(vocabulary)
    special = {x["content"] for x in model["added_tokens"]}
    return {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


@functools.lru_cache(maxsize=1)
def _encoders(a: bytes, b: bytes):
    """Two functions from text to ids, and the bytes of each one's tokens. Kept for the tasks of a worker."""
    import sentencepiece
    import tiktoken

    ranks = byte_ranks(a)
    first = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    bytes_a = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        bytes_a[i] = token
    second = sentencepiece.SentencePieceProcessor(model_proto=b)
    bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in range(second.get_piece_size()))]
    return first.encode_ordinary, lambda text: second.encode(text, num_threads=1), bytes_a, bytes_b


def parts(text: str, size: int = PART_CHARS) -> list[tuple[int, int]]:
    """Spans of a text that can be encoded apart; each but the first starts at a space between two letters."""
    cuts = [0]
    while len(text) - cuts[-1] > size and (seam := _SEAM.search(text, cuts[-1] + size)):
        cuts.append(seam.start())
    return list(zip(cuts, [*cuts[1:], len(text)], strict=True))


def encode(text: str, encoders) -> tuple[list[int], list[int]]:
    """Ids of both tokenizers, or none where the tokens of one don't spell a space and the text."""
    of_a, of_b, bytes_a, bytes_b = encoders
    a, b = [], []
    for start, end in parts(text) if text else []:
        a += of_a(text[start:end] if start else f" {text[:end]}")
        b += of_b(text[start + (start > 0) : end])
    want = b" " + text.encode()
    spelled = all(b"".join(map(table.__getitem__, ids)) == want for ids, table in ((a, bytes_a), (b, bytes_b)))
    return (a, b) if text and spelled else ([], [])


def divide(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens end a group. ``a`` and ``b`` hold rising ends of tokens, text after text; text t has those from first[t] on.

    Texts without tokens are left out; the last tokens of a text end together.
    """
    ends_a, ends_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    some = first_a[1:] > first_a[:-1]
    lo, hi, low, high = first_a[:-1][some], first_a[1:][some], first_b[:-1][some], first_b[1:][some]
    ends_a[hi - 1] = ends_b[high - 1] = True
    while len(lo):
        wide = (hi - lo > 1) & (high - low > 1)
        lo, hi, low, high = lo[wide], hi[wide], low[wide], high[wide]
        middle = (lo + hi) // 2 - 1
        reach = np.maximum(middle - lo, hi - 2 - middle)
        cut_a, cut_b = np.full(len(lo), -1), np.full(len(lo), -1)
        open_, away = np.arange(len(lo)), 0
        while len(open_):
            # The middle first, then its neighbours one place further right and left at a time.
            for at in (middle[open_] + away, middle[open_] - away)[: 1 + (away > 0)]:
                inside = (lo[open_] <= at) & (at <= hi[open_] - 2) & (cut_a[open_] < 0)
                mine, at = open_[inside], at[inside]
                there = np.searchsorted(b, a[at])
                shared = b[there] == a[at]
                cut_a[mine[shared]], cut_b[mine[shared]] = at[shared], there[shared]
            away += 1
            open_ = open_[(cut_a[open_] < 0) & (reach[open_] >= away)]
        found = cut_a >= 0
        lo, hi, low, high, cut_a, cut_b = (x[found] for x in (lo, hi, low, high, cut_a, cut_b))
        ends_a[cut_a] = ends_b[cut_b] = True
        lo, hi = np.concatenate([lo, cut_a + 1]), np.concatenate([cut_a + 1, hi])
        low, high = np.concatenate([low, cut_b + 1]), np.concatenate([cut_b + 1, high])
    return ends_a, ends_b


@dataclass
class Aligned:
    """Tokens of a block's texts, text after text; stop_a and stop_b: tokens up to the end of each group, group: groups before each text."""

    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    stop_a: np.ndarray
    stop_b: np.ndarray
    group: np.ndarray


def align_block(texts: list[bytes], encoders) -> Aligned:
    ids_a, ids_b, base = [], [], [0]
    for text in texts:
        a, b = encode(text.decode(), encoders)
        ids_a.append(np.array(a, np.int64))
        ids_b.append(np.array(b, np.int64))
        base.append(base[-1] + len(text) + 1)
    first_a, first_b = (np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int64) for ids in (ids_a, ids_b))
    a, b = (np.concatenate(ids) if ids else np.zeros(0, np.int64) for ids in (ids_a, ids_b))
    offsets = np.array(base[:-1], np.int64)

    def ends(ids, first, table):
        size = np.array([len(x) for x in table], np.int64)[ids]
        run, row = np.append(0, np.cumsum(size)), np.repeat(np.arange(len(texts)), np.diff(first))
        return run[1:] - run[first[row]] + offsets[row]

    ends_a, ends_b = divide(ends(a, first_a, encoders[2]), ends(b, first_b, encoders[3]), first_a, first_b)
    stop_a, stop_b = np.flatnonzero(ends_a) + 1, np.flatnonzero(ends_b) + 1
    return Aligned(a, b, first_a, first_b, stop_a, stop_b, np.searchsorted(stop_a, first_a, "right"))


#: Decimal digits of ids, right-aligned, zero bytes before them.
_DIGITS = np.frombuffer(b"".join(str(i).encode().rjust(6, b"\0") for i in range(1 << 16)), np.uint8).reshape(-1, 6)


def _group_hashes(x: Aligned) -> list[str]:
    """sha256 of each text's groups, written as a1,a2|b1;a3|b2,b3."""
    sizes_a, sizes_b = np.diff(x.stop_a, prepend=0), np.diff(x.stop_b, prepend=0)
    place_a = np.arange(len(x.a)) + np.repeat(x.stop_b - sizes_b, sizes_a)
    place_b = np.arange(len(x.b)) + np.repeat(x.stop_a, sizes_b)
    ids, after = np.zeros(len(x.a) + len(x.b), np.int64), np.full(len(x.a) + len(x.b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = x.a, x.b
    after[place_a[x.stop_a - 1]], after[place_b[x.stop_b - 1]] = ord("|"), ord(";")
    signs = np.column_stack([_DIGITS[ids], after])
    used = np.append(0, np.cumsum((signs != 0).sum(axis=1)))
    line, first = signs[signs != 0], used[x.first_a + x.first_b]
    return [hashlib.sha256(line[s : e - 1].tobytes()).hexdigest() if e > s else "" for s, e in zip(first[:-1], first[1:], strict=True)]


def _summed(row: np.ndarray, key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key), sorted, with the sums of ``times``."""
    order = np.lexsort((key, row))
    row, key, times = row[order], key[order], times[order]
    lead = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]))[: len(key)])
    return row[lead], key[lead], np.add.reduceat(times, lead) if len(lead) else times


def linked_pairs(x: Aligned, chunk: int = PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, a id << 32 | b id, times) of each pair of tokens that share a group in a text, sorted."""
    sizes_a, sizes_b = np.diff(x.stop_a, prepend=0), np.diff(x.stop_b, prepend=0)
    row = np.searchsorted(x.group, np.arange(len(x.stop_a)), "right") - 1
    # Only a group without any shared end inside is large: its tokens are paired once for each id.
    links = np.append(0, np.cumsum(sizes_a * sizes_b))
    found, start = [], 0
    while start < len(x.stop_a):
        end = max(start + 1, int(np.searchsorted(links, links[start] + chunk, "right")) - 1)
        n_a, n_b = sizes_a[start:end], sizes_b[start:end]
        if end == start + 1 and n_a[0] * n_b[0] > chunk:
            (ids_a, t_a), (ids_b, t_b) = (np.unique(ids[stop - n : stop], return_counts=True) for ids, stop, n in ((x.a, x.stop_a[start], n_a[0]), (x.b, x.stop_b[start], n_b[0])))
            key, n = ((ids_a << 32)[:, None] | ids_b).ravel(), (t_a[:, None] * t_b).ravel()
            at = np.full(len(key), row[start])
        else:
            each = np.repeat(np.arange(len(n_a)), n_a * n_b)
            place = np.arange(len(each)) - np.repeat(np.cumsum(n_a * n_b) - n_a * n_b, n_a * n_b)
            key = (x.a[(x.stop_a[start:end] - n_a)[each] + place // n_b[each]] << 32) | x.b[(x.stop_b[start:end] - n_b)[each] + place % n_b[each]]
            at, n = row[start:end][each], np.ones(len(each), np.int64)
        found.append(_summed(at, key, n))
        start = end
    return found[0] if len(found) == 1 else _summed(*(np.concatenate(z) for z in zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 3


def _vocabularies(docs: DataFrame, a: str, b: str):
    """The bytes of both files, which are about 2 MB whatever the corpus, for the tasks."""
    sent = []
    for path in (a, b):
        with open(path, "rb") as f:
            sent.append(docs.sparkSession.sparkContext.broadcast(f.read()))
    return sent


def _list(values, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _pack(values: np.ndarray) -> pa.Array:
    """Numbers from 0 on, in the fewest bytes that hold each of them."""
    return pa.array([values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()], pa.binary())


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _block_rows(vocabularies, block_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        encoders = _encoders(*(v.value for v in vocabularies))
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("doc_id")
            for b in W.blocks(batch.column("text"), block_bytes):
                x = align_block([b.text(r) for r in range(b.n)], encoders)
                row, key, times = linked_pairs(x)
                pairs, at, n_docs = np.unique(key, return_inverse=True, return_counts=True)
                first = np.searchsorted(row, np.arange(b.n + 1))
                run_links = np.append(0, np.cumsum(times))
                columns = [
                    _list(ids.slice(b.first_row, b.n), pa.int64()), _list(np.diff(x.first_a), pa.int64()), _list(np.diff(x.first_b), pa.int64()), _list(np.diff(x.group), pa.int64()),
                    _list(np.diff(run_links[first]), pa.int64()), _list(_group_hashes(x), pa.string()), _list(first, pa.int64()), _pack(at), _pack(times),
                ]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), _list(pairs, pa.int64()), _list(n_docs, pa.int64()), *columns], ["block", "pairs", "n_docs", *_LISTS, *_PACKED])
                block += 1

    return run


def blocks(docs: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Written rows of aligned texts, one for each block: figures of its texts, and its pairs of linked ids once each."""
    return cut(docs.select("doc_id", "text").mapInArrow(_block_rows(_vocabularies(docs, a, b), block_bytes), _BLOCKS), GROUP_ROWS)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(a_id, b_id, n_docs, best): how many texts of :func:`blocks` hold the pair linked; best: no other partner of a_id has more."""
    counts = aligned.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.n_docs").alias("n_docs"))
    # One id's partners are at most the other tokenizer's ids.
    most = F.max("n_docs").over(Window.partitionBy("a_id"))
    ids = counts.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND((1 << 32) - 1).cast("int").alias("b_id"), "n_docs")
    return ids.withColumn("best", F.col("n_docs") == most)


def token_map(docs: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> DataFrame:
    """(a_id, b_id, n_docs, best) of all pairs of ids that some text of ``docs`` (text; doc_id) has in one group."""
    return link_counts(blocks(docs, a, b))


def align(docs: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_stops, b_stops) of each row: the ids, and how many of each stand up to the end of each group.

    Null and empty texts, and texts that one tokenizer doesn't spell in full (such as
    those with U+2581), have empty arrays. Repeated rows are rows of their own.
    """
    vocabularies = _vocabularies(docs, a, b)

    def run(batches):
        encoders = _encoders(*(v.value for v in vocabularies))
        for batch in batches:
            for block in W.blocks(batch.column("text"), BLOCK_BYTES):
                x = align_block([block.text(r) for r in range(block.n)], encoders)
                lists = [
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, pa.int32()))
                    for first, values in (
                        (x.first_a, x.a),
                        (x.first_b, x.b),
                        (x.group, x.stop_a - np.repeat(x.first_a[:-1], np.diff(x.group))),
                        (x.group, x.stop_b - np.repeat(x.first_b[:-1], np.diff(x.group))),
                    )
                ]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first_row, block.n), *lists], ["doc_id", "a_ids", "b_ids", "a_stops", "b_stops"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_stops array<int>, b_stops array<int>")


def _sums(lists: pa.Table, found: pa.Table) -> pa.Table:
    """Rows of a block's texts again, with the sums of the counts that the block's pairs have."""
    part = {name: lists.column(name)[0].values for name in _LISTS}
    first = part["first"].to_numpy()
    at, times = (_unpack(lists.column(name)[0].as_py(), int(first[-1])) for name in _PACKED)
    place, sums = found.column("pos").to_numpy(), []
    for name in ("best", "n_docs"):
        of_pair = np.zeros(len(place), np.int64)
        of_pair[place] = found.column(name).to_numpy()
        run = np.append(0, np.cumsum(times * of_pair[at]))
        sums.append(pa.array(np.diff(run[first]), pa.int64()))
    return pa.Table.from_arrays(
        [*(part[name] for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *sums, part["groups_sha256"]],
        ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    )


def digest(docs: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of ``docs`` (doc_id, text).

    A link is a pair of tokens, one of each tokenizer, in one group; n_best counts
    links whose pair is in as many texts as any pair of its first id, count_sum adds
    up how many texts hold each link's pair. Texts that are null, empty or not spelled
    in full by both tokenizers have zeros and an empty hash. Repeated rows, and rows
    with null ids, are texts of their own; an empty table gives no rows.
    """
    aligned = blocks(docs, a, b, block_bytes)
    counts = cut(link_counts(aligned).select((F.shiftleft(F.col("a_id").cast("long"), 32) + F.col("b_id")).alias("pair"), "n_docs", "best"))
    asked = aligned.select(F.col("block").alias("asker"), F.posexplode("pairs").alias("pos", "pair"))
    found = asked.join(counts, "pair").select("asker", "pos", "n_docs", "best")
    return (
        aligned.select("block", *_LISTS, *_PACKED).groupBy("block").cogroup(found.groupBy("asker"))
        .applyInArrow(_sums, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    )
