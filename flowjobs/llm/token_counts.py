"""Token counts by offset-mapped attribution (operator 1).

A document is encoded once, as a whole. Byte-level BPE loses nothing, so the
lengths of a text's tokens add up to its bytes and one running sum gives every
token's character span. Spans are joined to the sections they overlap, and a
token that crosses a border goes to sections by an explicit rule.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import words as W

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern of the byte-level BPE vocabularies, a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: most: the section that holds most of the token's characters, the earlier on a tie;
#: start: the section of the token's first character in a section; split: to all by characters.
RULES = ("most", "start", "split")


def _ranks(text: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in text.splitlines() if line)}


def _line_sections(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the lines, each with the newline that ends it."""
    data = np.frombuffer(text, np.uint8)
    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    ends = chars[np.flatnonzero(data == 10) + 1]
    edges = np.unique(np.concatenate([[0], ends, chars[-1:]]))
    return (edges[:-1], edges[1:]) if len(edges) > 1 else (np.zeros(1, np.int64), np.zeros(1, np.int64))


def allocate(t0: np.ndarray, t1: np.ndarray, s0: np.ndarray, s1: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Interval join of token spans and sorted disjoint section spans.

    Returns each section's tokens, the tokens that cross its borders, and the tokens
    outside all sections. Each token counts once in all.
    """
    lo = np.searchsorted(s1, t0, "right")
    hi = np.searchsorted(s0, t1, "left") - 1
    # A token within one character (a part of its bytes) stands where that character is.
    hi = np.maximum(hi, np.searchsorted(s0, t0, "right") - 1) if len(s0) else hi
    inside = lo <= hi
    inner = inside & (lo == hi) & (s0[np.minimum(lo, len(s0) - 1)] <= t0) & (t1 <= s1[np.minimum(lo, len(s0) - 1)])
    count = np.bincount(lo[inner], minlength=len(s0)).astype(float)
    crossing = np.zeros(len(s0), np.int64)
    outside = float((~inside).sum())
    for i in np.flatnonzero(inside & ~inner):
        own = np.arange(lo[i], hi[i] + 1)
        shared = np.minimum(s1[own], t1[i]) - np.maximum(s0[own], t0[i])
        crossing[own] += 1
        if rule == "most":
            count[own[np.argmax(shared)]] += 1
        elif rule == "start":
            count[own[0]] += 1
        else:
            count[own] += shared / (t1[i] - t0[i])
            outside += 1 - shared.sum() / (t1[i] - t0[i])
    return count, crossing, outside


def _counts_of(vocabulary, pattern: str, rule: str):
    def run(batches):
        import tiktoken

        ranks = _ranks(vocabulary.value)
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        kind = pa.float64() if rule == "split" else pa.int64()
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            listed = batch.column("sections") if "sections" in batch.schema.names else None
            out = [[] for _ in range(6)]
            at = []
            for b in W.blocks(texts):
                for row in range(b.n):
                    text = b.text(row)
                    ends = np.cumsum(size[np.array(encoding.encode_ordinary(text.decode()), np.int64)])
                    data = np.frombuffer(text, np.uint8)
                    lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                    # Characters that a token's bytes touch: from the one its first byte is in to the one its last byte is in.
                    starts = np.append(0, ends[:-1])[: len(ends)]
                    t0, t1 = lead[np.minimum(starts + 1, len(data))] - 1, lead[ends]
                    if listed is None or not listed[b.first_row + row].is_valid:
                        s0, s1 = _line_sections(text)
                    else:
                        spans = sorted((x["start"], x["end"]) for x in listed[b.first_row + row].as_py() if x and x["start"] is not None and x["end"] is not None and x["end"] > x["start"])
                        s0, s1 = (np.array(x, np.int64) for x in zip(*spans, strict=True)) if spans else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                        if (s1[:-1] > s0[1:]).any():
                            raise ValueError("sections of a document must not overlap")
                    if len(s0):
                        count, crossing, outside = allocate(t0, t1, s0, s1, rule)
                    else:
                        count, crossing, outside = np.zeros(0), np.zeros(0, np.int64), float(len(t0))
                    no = np.arange(len(s0))
                    if outside > 1e-9:
                        no, s0, s1, count, crossing = np.append(no, -1), np.append(s0, 0), np.append(s1, lead[-1]), np.append(count, outside), np.append(crossing, 0)
                    at.append(np.full(len(no), b.first_row + row))
                    for x, y in zip(out, (no, s0, s1, count, crossing), strict=False):
                        x.append(y)
            if at:
                no, s0, s1, count, crossing = (np.concatenate(x) for x in out[:5])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.concatenate(at))), pa.array(no.astype(np.int32)), pa.array(s0.astype(np.int32)), pa.array(s1.astype(np.int32)), pa.array(count).cast(kind), pa.array(crossing.astype(np.int32))],
                    ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"],
                )

    return run


def _has_sections(docs: DataFrame) -> bool:
    """Whether ``docs`` has a column sections of (start, end) spans; any other column of that name is not read."""
    kind = docs.schema["sections"].dataType if "sections" in docs.columns else None
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and {"start", "end"} <= set(kind.elementType.names)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, rule: str = "most") -> DataFrame:
    """(doc_id, section, start_char, end_char, n_tokens, n_crossing), one row for each section of each row.

    ``docs`` has doc_id and text, and may have sections, an array of (start, end)
    character spans (a column of that name and another type is not read); without
    them, or where they are null, the sections are the lines, each with its newline. Tokens outside all sections are on a row with
    section -1 that spans the text. n_crossing counts the tokens across a border of
    the section; ``rule`` says which sections they count for. Null and empty texts
    are one empty line without tokens. Sections may not overlap. Repeated rows are
    rows of their own. ``vocabulary`` is a file of ranks on the driver; its bytes
    (under 1 MB) go to the tasks.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark: SparkSession = docs.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    columns = ["doc_id", "text", *(["sections"] if _has_sections(docs) else [])]
    kind = "double" if rule == "split" else "long"
    return docs.select(*columns).mapInArrow(
        _counts_of(ranks, pattern, rule), f"doc_id long, section int, start_char int, end_char int, n_tokens {kind}, n_crossing int"
    )


def digest(docs: DataFrame) -> DataFrame:
    return count_tokens(docs.select("doc_id", "text"))
