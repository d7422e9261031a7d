"""Substring dedup by relative Lempel-Ziv factors (operator 9).

The reference is the text of all documents, each for the others and for itself. Its
index is distributed: a text is cut into blocks around content-chosen anchors (the
smallest hash of ``GRAM`` consecutive words within a window), so equal passages are
cut alike wherever they stand. A block holds the run of windows that chose its
anchor and is looked up by anchor and content, 128 bits together.

A text is then parsed greedily. At each place that the index knows, the two
outermost places with the same words are tried as references, and the one that can
be copied furthest, block by block at a constant offset, becomes a factor. Blocks
whose anchor stands elsewhere with other words around it lie at the borders of
factors: there, and only there, windows are looked up one by one, so a factor
reaches to the last word that its reference shares. Factors of ``window`` words and
more are the duplicate spans; shorter ones hold no window and are none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import cut, numbered

WINDOW = 35
#: words of an anchor; a window holds WINDOW - GRAM + 1 of them
GRAM = 8

_LOW = np.uint64((1 << 32) - 1)
_BLOCKS = "anchor long, content long, uid long, start int, n int"


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values, by doubling."""
    span = 1
    while span * 2 <= size:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (size - span)], x[size - span :]) if size > span else x


def reference_blocks(data: np.ndarray, offsets: np.ndarray, size: int, gram: int):
    """(row, first window, windows, anchor hash, content hash) of each block of the texts."""
    words = W.split(data, offsets, W.SPACED)
    hashes = W.word_hashes(data, words)
    at = W.window_starts(words, size)
    if not len(at):
        return words, None
    seq = W.Sequences(hashes)
    g = np.arange(len(hashes) - gram + 1)
    grams = seq.ranges(g, g + gram)
    packed = (grams & ~_LOW) | (g.astype(np.uint64) & _LOW)
    low = _sliding_min(packed, size - gram + 1)[at]
    anchor = (low & _LOW).astype(np.int64)
    row = words.row[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    lead = np.flatnonzero(new)
    n = np.diff(np.append(lead, len(at)))
    start = at[lead]
    content = W.mix(seq.ranges(start, start + n + size - 1) + (anchor[lead] - start).astype(np.uint64))
    return words, (row[lead], start, n, grams[anchor[lead]], content)


def _blocks_of(size: int, gram: int):
    def run(batches):
        for batch in batches:
            keys = batch.column("uid").to_numpy(zero_copy_only=False)
            for b in W.blocks(batch.column("text")):
                words, found = reference_blocks(b.data, b.offsets, size, gram)
                if found is None:
                    continue
                row, start, n, anchor, content = found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.signed(anchor)), pa.array(W.signed(content)), pa.array(keys[b.first_row : b.last_row][row]), pa.array((start - words.first[row]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["anchor", "content", "uid", "start", "n"],
                )

    return run


def _windows_of(size: int):
    """One row for each window of the blocks listed for a text, each with the places of its block."""

    def run(batches):
        for batch in batches:
            keys = batch.column("uid").to_numpy(zero_copy_only=False)
            listed = batch.column("blocks")
            ends = listed.offsets.to_numpy()
            anchor, start, n, places = (listed.values.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "start", "n", "places"))
            for b in W.blocks(batch.column("text")):
                words = W.split(b.data, b.offsets, W.SPACED)
                seq = W.Sequences(W.word_hashes(b.data, words))
                mine = np.arange(ends[b.first_row], ends[b.last_row])
                row = np.repeat(np.arange(b.n), np.diff(ends[b.first_row : b.last_row + 1]))
                k = n[mine]
                each = np.repeat(np.arange(len(mine)), k)
                at = start[mine][each] + np.arange(len(each)) - (np.cumsum(k) - k)[each]
                absolute = at + words.first[row[each]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[mine][each]), pa.array(W.signed(seq.ranges(absolute, absolute + size))), pa.array(keys[b.first_row : b.last_row][row[each]]), pa.array(at.astype(np.int32)), pa.array(places[mine][each])],
                    ["anchor", "content", "uid", "start", "places"],
                )

    return run


def parse(hits: list[dict], size: int) -> list[tuple[int, int, int, int]]:
    """(first word, words, uid, first word there) of each factor of a text, greedily.

    ``hits`` are runs of windows (start, n) that stand at ``lo`` and at ``hi``
    (uid, start) too; one of the two may be the run itself. A factor copies on as long
    as the next run of windows begins where it ends and can be copied from the same
    document at the same offset.
    """
    hits = sorted(hits, key=lambda x: x["start"])
    sources = [{(p["uid"], p["start"] - x["start"]) for p in (x["lo"], x["hi"])} for x in hits]
    out, i = [], 0
    while i < len(hits):
        far, source = i, min(sources[i])
        for s in sorted(sources[i]):
            j = i + 1
            while j < len(hits) and hits[j]["start"] == hits[j - 1]["start"] + hits[j - 1]["n"] and s in sources[j]:
                j += 1
            if j > far:
                far, source = j, s
        start = hits[i]["start"]
        out.append((start, hits[far - 1]["start"] + hits[far - 1]["n"] - start + size - 1, source[0], start + source[1]))
        i = far
    return out


def _without_itself(uid: int, hits: list[dict]) -> list[dict]:
    """The hits, with a place that is the hit itself replaced by the other one."""
    for x in hits:
        for own, other in (("lo", "hi"), ("hi", "lo")):
            if x[own]["uid"] == uid and x[own]["start"] == x["start"]:
                x[own] = x[other]
    return hits


def _parsed(uid: int, listed, size: int) -> list[tuple[int, int, int, int]]:
    hits = listed.as_py()
    return parse(_without_itself(uid, hits), size) if hits else []


def _factors_of(size: int):
    def run(batches):
        for batch in batches:
            rows = [(doc, *f) for doc, uid, listed in zip(batch.column("doc_id").to_pylist(), batch.column("uid").to_pylist(), batch.column("hits"), strict=True) for f in _parsed(uid, listed, size)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "words", "source", "source_start"])

    return run


def _removed(size: int, with_text: bool):
    def run(batches):
        for batch in batches:
            uids, hits = batch.column("uid").to_pylist(), batch.column("hits")
            n_words, n_removed, digests, kept = [], [], [], []
            for b in W.blocks(batch.column("text")):
                for row in range(b.n):
                    words = b.text(row).split()
                    found = _parsed(uids[b.first_row + row], hits[b.first_row + row], size)
                    n_words.append(len(words))
                    gone = np.zeros(len(words), bool)
                    for start, length, _, _ in found:
                        gone[start : start + length] = True
                    n_removed.append(int(gone.sum()))
                    text = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if found else words)
                    digests.append(hashlib.sha256(text).hexdigest())
                    kept.append(text.decode() if with_text else None)
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.string())] if with_text else [])], ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])])

    return run


def _copied(own: DataFrame, window: int, gram: int) -> DataFrame:
    """Runs of windows of the written table ``own`` (text, uid) that stand at two or more places: uid, start, n, lo, hi.

    lo and hi are the first and the last of the places (uid, start).
    """
    blocks = cut(own.select("uid", "text").mapInArrow(_blocks_of(window, gram), _BLOCKS))
    # Keys that occur more than once are counted alone and written before they are joined: counts are made map-side, and a
    # key with very many places is then split by Spark like any other skewed join.
    repeated = lambda df, *keys: cut(df.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1").select(*keys))
    hits = cut(blocks.join(repeated(blocks, "anchor"), "anchor", "left_semi"))
    place = F.struct("uid", "start")
    ends = [F.min(place).alias("lo"), F.max(place).alias("hi")]
    # The places of each block. One place stands for all where an anchor has different blocks.
    same = ["anchor", "content"]
    kinds = cut(hits.groupBy(*same).agg(F.count("*").alias("places"), F.first("n").alias("n"), *ends))
    whole = hits.join(kinds.where("places > 1").select(*same, "lo", "hi"), same).select("uid", "start", "n", "lo", "hi")
    mixed = kinds.join(repeated(kinds, "anchor"), "anchor", "left_semi")
    listed = mixed.groupBy(F.col("lo.uid").alias("uid")).agg(F.collect_list(F.struct("anchor", F.col("lo.start").alias("start"), "n", "places")).alias("blocks"))
    at_borders = cut(own.select("uid", "text").join(listed, "uid").mapInArrow(_windows_of(window), "anchor long, content long, uid long, start int, places long"))
    twice = cut(at_borders.join(repeated(at_borders, *same), same, "left_semi"))
    # A block that stands at several places is copied as a whole anyway.
    borders = twice.where("places = 1").join(cut(twice.groupBy(*same).agg(*ends)), same).select("uid", "start", F.lit(1).alias("n"), "lo", "hi")
    return whole.unionAll(borders)


def _with_hits(docs: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with numbers, and (uid, hits), the runs of windows of each that stand elsewhere too."""
    if not 1 <= gram <= window:
        raise ValueError("an anchor must fit into a window")
    own = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return own, _copied(own, window, gram).groupBy("uid").agg(F.collect_list(F.struct("start", "n", "lo", "hi")).alias("hits"))


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, start, words, source_doc_id, source_start): the factors of each row of ``docs`` (doc_id, text).

    ``words`` words from word ``start`` on (counted from 0) stand from word
    ``source_start`` of a row with id source_doc_id on, which may be the row itself at
    another place. A factor has ``window`` words at least; factors may overlap.
    """
    own, hits = _with_hits(docs, window, gram)
    found = own.select("doc_id", "uid").join(hits, "uid").select("doc_id", "uid", "hits").mapInArrow(_factors_of(window), "doc_id long, start long, words long, source long, source_start long")
    return found.join(own.select(F.col("uid").alias("source"), F.col("doc_id").alias("source_doc_id")), "source").select("doc_id", "start", "words", "source_doc_id", "source_start")


def remove_duplicate_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, ``with_text``, kept_text of each row of ``docs`` (doc_id, text).

    Words are runs of anything but ASCII white space. Each word goes that lies in a
    factor: in a run of ``window`` words or more which also starts at another place, in
    the same row or another one. Null text: no words. Rows that stand twice are
    copies of each other. Texts under ``window`` words stay whole. An empty table gives
    an empty table. Other columns are not read.
    """
    own, hits = _with_hits(docs, window, gram)
    return own.join(hits, "uid", "left").select("doc_id", "uid", "text", "hits").mapInArrow(_removed(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else ""))


def digest(docs: DataFrame) -> DataFrame:
    return remove_duplicate_windows(docs, with_text=False)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents
), w AS (
  SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS i FROM d
), s AS (
  SELECT doc_id, i, array_to_string(list_slice(a, i, i + 34), ' ') AS seq FROM (SELECT doc_id, a, unnest(range(1, len(a) - 33)) AS i FROM d)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY seq) AS n FROM s) WHERE n > 1
), c AS (
  SELECT w.doc_id, w.i, w.word, count(r.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.i = w.i
), k AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id
)
SELECT d.doc_id, len(d.a)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
