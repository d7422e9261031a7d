"""MinHash near-dedup by a multi-index Hamming join (operator 4).

A text's distinct shingles give a signature of b = 16 bit symbols (minima of as
many hash orders), four symbols a chunk. Two sets of similarity s differ in each
symbol with chance 1 - s. By pigeonhole two signatures at distance
2 * chunks - 1 or less agree in some chunk but for at most one symbol, so each
chunk is indexed four times, once without each of its symbols. The number of
chunks follows from the similarity: a pair that just reaches it lies beyond that
distance with a chance of at most MISSED. At 0.85 that is 8 chunks and distance
15, at 0.8 it is 12 chunks and distance 23. Every link is confirmed on the full
sets.

Texts with equal sets are one class from the start (128 bits of the whole set).
The buckets of the index are worked through in three rounds, each of which leaves
out pairs that are connected already:

1. each class and the smallest of the representatives of its buckets,
2. each class and all other representatives of its buckets,
3. all pairs of the members of a bucket that still lie in different components.

A pair is a link if its signatures are within the distance and its sets reach the
similarity, whatever the size of its buckets; in the last round each pair is looked
at in the first bucket that it shares. Components do not depend on the order. Large
buckets of the last round that share members are put together, so that their pairs
are looked at once, and are dealt over cells of two blocks of sets of like size;
members of the largest component meet the others only, never each other.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import connected_components
from .tables import cut, free_name, numbered

SHINGLE = 5
#: chance to miss a pair that just reaches the similarity
MISSED = 4e-6
#: links have 100 * intersection >= PERCENT * union
PERCENT = 85
#: the same where one document of each group is kept
KEEP_PERCENT = 80
#: members of a bucket whose pairs leave the task; larger buckets are compared in cells of blocks of BLOCK
SMALL, BLOCK = 64, 256
#: so many numbers of texts, 8 bytes each, go to the tasks; beyond that they are joined to the texts by a shuffle
TRAVEL = 1_000_000
#: slot of the families of large buckets
FAMILY = -1
_ORDERS = W.mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))


def chunks_for(percent: int) -> int:
    """The least number of chunks with which a pair of this similarity is missed with a chance of at most MISSED."""
    differ = 1 - percent / 100
    for chunks in range(2, 128):
        n = 4 * chunks
        if sum(comb(n, d) * differ**d * (1 - differ) ** (n - d) for d in range(2 * chunks, n + 1)) <= MISSED:
            return chunks
    raise ValueError("no signature of up to 508 symbols finds pairs of so low a similarity")


def distance(chunks: int) -> int:
    """Signatures up to this distance share an index row."""
    return 2 * chunks - 1


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each row, sorted, rows one after another, and their numbers."""
    words = W.split(data, offsets, W.SPACED)
    seq = W.Sequences(W.word_hashes(data, words))
    n = words.counts
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    lead = np.cumsum(count) - count
    start = np.repeat(words.first[:-1] - lead, count) + np.arange(count.sum())
    h = seq.ranges(start, start + np.repeat(np.minimum(n, size), count))
    sets = [np.unique(x) for x in np.split(h, lead[1:])]
    return np.concatenate(sets) if sets else h, np.array([len(x) for x in sets], np.int64)


def signatures(h: np.ndarray, count: np.ndarray, chunks: int) -> np.ndarray:
    """4 * ``chunks`` symbols of 16 bits for each non-empty set."""
    lead = (np.cumsum(count) - count)[count > 0]
    out = np.zeros((len(lead), 4 * chunks), np.uint16)
    for i in range(4 * chunks if len(lead) else 0):
        low = np.minimum.reduceat((h ^ _ORDERS[2 * i]) * (_ORDERS[2 * i + 1] | np.uint64(1)), lead)
        out[:, i] = (W.mix(low) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _names(chunks: int) -> list[str]:
    return [f"g{i}" for i in range(chunks)]


def _sets_of(size: int, chunks: int):
    """Number of shingles, 128 bits of the set, and signature of each row."""

    def run(batches):
        for batch in batches:
            for b in W.blocks(batch.column("text")):
                h, count = shingles(W.LOWER[b.data], b.offsets, size)
                full = count > 0
                ends = np.append(0, np.cumsum(count))
                whole = np.zeros((b.n, 2), np.int64)
                for row in np.flatnonzero(full):
                    whole[row] = np.frombuffer(hashlib.blake2b(h[ends[row] : ends[row + 1]], digest_size=16).digest(), np.int64)
                sig = np.zeros((b.n, chunks), np.int64)
                sig[full] = signatures(h, count, chunks).view(np.int64)
                part = batch.slice(b.first_row, b.n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("uid"), pa.array(count), *(pa.array(np.ascontiguousarray(whole[:, i]), mask=~full) for i in (0, 1)), *(pa.array(np.ascontiguousarray(sig[:, i])) for i in range(chunks))],
                    ["doc_id", "uid", "n", "d1", "d2", *_names(chunks)],
                )

    return run


def index_keys(chunks: int) -> Column:
    """The index rows of a class: each chunk without each of its four symbols."""
    without = [~(0xFFFF << 16 * i) for i in range(3)] + [(1 << 48) - 1]
    return F.array(*(F.xxhash64(F.lit(4 * c + i), F.col(g).bitwiseAND(F.lit(m).cast("long"))) for c, g in enumerate(_names(chunks)) for i, m in enumerate(without)))


def _first_shared(differ: np.ndarray) -> np.ndarray:
    """The first index row that two signatures share, from where they differ (pairs x symbols); -1 for none."""
    chunks = differ.reshape(len(differ), differ.shape[1] // 4, 4)
    shared = chunks.sum(axis=2) <= 1
    first = shared.argmax(axis=1)
    return np.where(shared.any(axis=1), 4 * first + chunks[np.arange(len(differ)), first].argmax(axis=1), -1)


def _differ(a: Column, b: Column) -> Column:
    """Symbols in which two chunks differ."""
    symbols = [0xFFFF << 16 * i for i in range(3)] + [-(1 << 48)]
    return reduce(Column.__add__, [(a.bitwiseXOR(b).bitwiseAND(F.lit(m).cast("long")) != 0).cast("int") for m in symbols])


def _near(pairs: DataFrame, classes: DataFrame, chunks: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose signatures are within the distance and whose set sizes allow the similarity."""
    side = lambda s: classes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), *(F.col(g).alias(f"{g}_{s}") for g in _names(chunks)))
    apart = reduce(Column.__add__, [_differ(F.col(f"{g}_a"), F.col(f"{g}_b")) for g in _names(chunks)])
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return pairs.join(side("a"), "a").join(side("b"), "b").where(sizes & (apart <= distance(chunks))).select("a", "b")


def _full_sets(size: int):
    def run(batches):
        for batch in batches:
            for b in W.blocks(batch.column("text")):
                h, count = shingles(W.LOWER[b.data], b.offsets, size)
                ends = np.append(0, np.cumsum(count)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(b.first_row, b.n), pa.ListArray.from_arrays(pa.array(ends), pa.array(W.signed(h)))], ["node", "set"])

    return run


def _reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("set_a"), batch.column("set_b")
            keep = [_reaches(a[i].values.to_numpy(), b[i].values.to_numpy(), percent) for i in range(batch.num_rows)]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    return run


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node")))


def _sets(nodes: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(node, set): the full set of each class. A class is named by one of its rows."""
    # Written first, so that their number is known: texts are moved only where the numbers are too many to travel.
    nodes = cut(nodes.select("node").distinct())
    texts = rows.select(F.col("uid").alias("node"), "text").join(F.broadcast(nodes) if nodes.count() <= TRAVEL else nodes, "node")
    return cut(texts.select("node", "text").mapInArrow(_full_sets(size), "node long, set array<long>"))


def _but(rows: DataFrame, gone: DataFrame, uid: str) -> DataFrame:
    """``rows`` whose number is not in the written table ``gone``. Texts are moved only where the numbers are too many to travel."""
    return rows.join(F.broadcast(gone) if gone.count() <= TRAVEL else gone, uid, "left_anti")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) of a written table that reach the similarity on their full sets."""
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return cut(joined.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long"))


def _bucket_pairs(chunks: int, percent: int):
    """Pairs (a, b) of the members of each bucket that are near, lie in different components and share no index row before this one.

    Input: slot, key, node, component, n and signature, sorted by slot and key.
    """

    def pairs(slot, key, node, component, n, sig):
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (slot[1:] != slot[:-1])
        bucket = np.cumsum(new)
        a, b = [node[:0]], [node[:0]]
        for o in range(1, len(key)):
            i = np.flatnonzero(bucket[:-o] == bucket[o:])
            if not len(i):
                break
            i = i[component[i] != component[i + o]]
            differ = sig[i] != sig[i + o]
            near = (differ.sum(axis=1) <= distance(chunks)) & (100 * np.minimum(n[i], n[i + o]) >= percent * np.maximum(n[i], n[i + o]))
            i = i[near & (_first_shared(differ) == slot[i])]
            a.append(np.minimum(node[i], node[i + o]))
            b.append(np.maximum(node[i], node[i + o]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "key", "node", "component", "n")]
            rows.append(_symbols(batch, chunks))
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            last = len(rows[1])
            while last and rows[1][last - 1] == rows[1][-1] and rows[0][last - 1] == rows[0][-1]:
                last -= 1
            if last:
                yield pairs(*(x[:last] for x in rows))
            held = [x[last:] for x in rows]
        if held is not None:
            yield pairs(*held)

    return run


def _symbols(batch, chunks: int) -> np.ndarray:
    longs = np.stack([batch.column(g).to_numpy() for g in _names(chunks)], axis=1)
    return np.ascontiguousarray(longs).view(np.uint16).reshape(len(longs), 4 * chunks)


def _cells(chunks: int, percent: int):
    """Links within each cell (slot, key, band, i, step, j) of two blocks, by signatures and then on the full sets.

    Block i lies in the cell's band of sizes, block j in the same or the next one. Of
    the links between two components that the cell has already connected one is
    enough, so a cell gives fewer links than it has members. Pairs of a bucket that
    share an index row before this one are left to that one; a family holds each pair once.
    """

    def run(key, table):
        slot, _, i_band, i_block, step, j_block = (k.as_py() for k in key)
        node, band, block, component, n = (table.column(c).to_numpy() for c in ("node", "band", "block", "component", "n"))
        in_j = (band == i_band + step) & (block == j_block)
        sig = _symbols(table, chunks)
        sets = table.column("set").combine_chunks()
        offsets = sets.offsets.to_numpy() - sets.offsets[0].as_py()
        shingle = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1]
        marked = np.zeros(len(shingle) + 1, np.int8)
        group = component.copy()
        links = []
        for i in np.flatnonzero((band == i_band) & (block == i_block)):
            at = np.flatnonzero(in_j & (group != group[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
            differ = sig[at] != sig[i]
            near = differ.sum(axis=1) <= distance(chunks)
            at = at[near if slot == FAMILY else near & (_first_shared(differ) == slot)]
            if not len(at):
                continue
            mine = shingle[offsets[i] : offsets[i + 1]]
            marked[mine] = 1
            if len(at) > 16:
                both = np.add.reduceat(marked[shingle], offsets[:-1], dtype=np.int64)[at]
            else:
                both = np.array([marked[shingle[offsets[j] : offsets[j + 1]]].sum(dtype=np.int64) for j in at])
            marked[mine] = 0
            for j in at[100 * both >= percent * (n[at] + n[i] - both)]:
                if group[j] != group[i]:
                    links.append((node[i], node[j]))
                    group[group == group[j]] = group[i]
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _families(members: DataFrame) -> DataFrame:
    """``members`` (slot, key, node, component) of buckets, with families of buckets in the place of their buckets.

    Buckets that share members are one family: texts alike meet in many buckets, and
    are to be compared once. A family that holds more pairs than all its buckets
    together, as one does whose buckets hang together by single texts, is left as
    buckets. A family's slot is FAMILY, its key one of its nodes.
    """
    buckets = cut(members.groupBy("slot", "key").agg(F.min("node").alias("root"), F.count("*").alias("c")))
    hung = members.join(buckets, ["slot", "key"]).where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    of = cut(connected_components(hung))
    rooted = buckets.join(of.select(F.col("node").alias("root"), F.col("component").alias("family")), "root")
    apart = rooted.groupBy("family").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("apart"))
    whole = of.groupBy(F.col("component").alias("family")).agg(F.count("*").cast("double").alias("m")).join(apart, "family").where("m * m <= apart")
    named = cut(rooted.join(whole.select("family", F.lit(True).alias("whole")), "family", "left").select("slot", "key", "family", "whole"))
    put = members.join(named, ["slot", "key"])
    return put.where("whole").select(F.lit(FAMILY).alias("slot"), F.col("family").alias("key"), "node", "component").distinct().unionAll(put.where("whole is null").select("slot", "key", "node", "component"))


def _upto(n: Column) -> Column:
    """0 to n - 1, nothing for 0."""
    return F.filter(F.sequence(F.lit(0), n), lambda x: x < n)


def _large_links(members: DataFrame, classes: DataFrame, sets: DataFrame, chunks: int, percent: int, block: int) -> DataFrame:
    """Links that connect the members (slot, key, node, component) of large buckets as all their links do.

    Members are dealt over blocks by the size of their sets: sets of a link lie in one
    band of sizes or in neighbouring ones.
    """
    width = max(log(100 / percent) * 1.001, 1e-6)
    sizes = classes.select("node", F.floor(F.log("n") / F.lit(width)).cast("int").alias("band"))
    members = cut(_families(members).join(sizes, "node"))
    parts = members.groupBy("slot", "key", "component", "band").agg(F.count("*").alias("c"))
    main = parts.groupBy("slot", "key", "component").agg(F.sum("c").alias("c")).groupBy("slot", "key").agg(F.max(F.struct("c", "component"))["component"].alias("main"))
    up = lambda own: F.ceil(F.sum(F.when(own, F.col("c")).otherwise(0)) / F.lit(block)).cast("int")
    is_main = F.col("component") == F.col("main")
    parts = cut(parts.join(main, ["slot", "key"]).groupBy("slot", "key", "main", "band").agg(up(~is_main).alias("others"), up(is_main).alias("mains")))
    beside = lambda by: parts.select("slot", "key", (F.col("band") - by).alias("band"), F.struct("others", "mains").alias("next" if by > 0 else "last"))
    parts = parts.join(beside(1), ["slot", "key", "band"], "left").join(beside(-1), ["slot", "key", "band"], "left")
    spread = F.xxhash64("node")
    placed = members.join(parts, ["slot", "key", "band"])
    placed = placed.withColumn("block", F.when(is_main, F.col("others") + F.pmod(spread, F.col("mains"))).otherwise(F.pmod(spread, F.col("others"))).cast("int"))
    # Members of the main component meet the others only.
    met = lambda others, mains: _upto(F.coalesce(others, F.lit(0)) + F.when(is_main, F.lit(0)).otherwise(F.coalesce(mains, F.lit(0))))
    cell = lambda band, i, step, j: F.struct(band.alias("i_band"), i.alias("i"), F.lit(step).alias("step"), j.alias("j"))
    band, own = F.col("band"), F.col("block")
    cells = F.concat(
        F.transform(met(F.col("others"), F.col("mains")), lambda x: cell(band, F.least(own, x), 0, F.greatest(own, x))),
        F.transform(met(F.col("next.others"), F.col("next.mains")), lambda x: cell(band, own, 1, x)),
        F.transform(met(F.col("last.others"), F.col("last.mains")), lambda x: cell(band - 1, x, 1, own)),
    )
    placed = placed.select("slot", "key", "node", "component", "band", "block", F.explode(cells).alias("cell")).select("slot", "key", "node", "component", "band", "block", "cell.*")
    sets = sets.join(classes.select("node", "n", *_names(chunks)), "node")
    return cut(placed.join(sets, "node").groupBy("slot", "key", "i_band", "i", "step", "j").applyInArrow(_cells(chunks, percent), "a long, b long"))


def _connect(classes: DataFrame, rows: DataFrame, size: int, chunks: int, percent: int, small: int, block: int) -> DataFrame:
    """(node, component) of each class that has a link."""
    index = classes.select("node", F.posexplode(index_keys(chunks)).alias("slot", "key"))
    buckets = cut(index.groupBy("slot", "key").agg(F.min("node").alias("rep"), F.count("*").alias("c")).where("c > 1"))
    members = cut(index.join(buckets, ["slot", "key"]).where("node <> rep").select("slot", "key", "node", "rep", "c"))
    stars = cut(_near(members.select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct(), classes, chunks, percent))
    sets = _sets(_ends(stars), rows, size)
    # Round 1: the smallest representative of each class.
    lowest = cut(stars.groupBy("a").agg(F.min("b").alias("b")))
    links = _links(lowest, sets, percent)
    # Round 2: the other representatives, where two steps along the links so far do not lead to the same class.
    up = links.select(F.col("a").alias("node"), F.col("b").alias("top"))
    up = up.join(up.select(F.col("node").alias("top"), F.col("top").alias("higher")), "top", "left").select("node", F.coalesce("higher", "top").alias("top"))
    top = lambda s: up.select(F.col("node").alias(s), F.col("top").alias(f"top_{s}"))
    more = stars.join(lowest, ["a", "b"], "left_anti").join(top("a"), "a", "left").join(top("b"), "b", "left")
    links = links.unionAll(_links(more.where(F.coalesce("top_a", "a") != F.coalesce("top_b", "b")).select("a", "b"), sets, percent))
    reached = cut(connected_components(links))
    # Round 3: what is not connected in a bucket. Its representative has met all members.
    left = members.where("c > 2").join(reached, "node", "left").select("slot", "key", "node", "c", F.coalesce("component", "node").alias("component"))
    left = cut(left)
    torn = left.groupBy("slot", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    left = cut(left.join(cut(torn.select("slot", "key")), ["slot", "key"], "left_semi"))
    sketches = classes.select("node", "n", *_names(chunks))
    few = left.where(F.col("c") <= small + 1).select("slot", "key", "node", "component").join(sketches, "node")
    few = few.repartition("slot", "key").sortWithinPartitions("slot", "key").select("slot", "key", "node", "component", "n", *_names(chunks))
    pairs = cut(few.mapInArrow(_bucket_pairs(chunks, percent), "a long, b long"))
    large = left.where(F.col("c") > small + 1).select("slot", "key", "node", "component")
    sets = _sets(_ends(pairs).unionAll(large.select("node")), rows, size)
    rest = _links(pairs, sets, percent)
    if not large.isEmpty():
        rest = rest.unionAll(_large_links(large, classes, sets, chunks, percent, block))
    return reached if rest.isEmpty() else cut(connected_components(links.unionAll(rest)))


def _components(own: DataFrame, shingle: int, percent: int, small: int, block: int) -> DataFrame:
    """doc_id, uid, n, component (null without words), component_id of each row of a written table (doc_id, text, uid)."""
    chunks = chunks_for(percent)
    longs = ", ".join(f"{g} long" for g in _names(chunks))
    rows = cut(own.mapInArrow(_sets_of(shingle, chunks), f"doc_id long, uid long, n long, d1 long, d2 long, {longs}"))
    classes = cut(rows.where("d1 is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.min("uid").alias("node"), F.max("n").alias("n"), *(F.min(g).alias(g) for g in _names(chunks))))
    reached = _connect(classes, own, shingle, chunks, percent, small, block)
    named = classes.select("d1", "d2", "node", "doc_id").join(reached, "node", "left").select("d1", "d2", "doc_id", F.coalesce("component", "node").alias("component"))
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = cut(named.join(lowest, "component").select("d1", "d2", "component", "component_id"))
    component_id = F.when(F.col("d1").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return rows.select("doc_id", "uid", "n", "d1", "d2").join(named, ["d1", "d2"], "left").select("doc_id", "uid", "n", "component", component_id)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text).

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text's set
    is its distinct runs of ``shingle`` words (a shorter text is one run as a
    whole). Two texts are linked with 100 * intersection >= percent * union;
    component_id is the smallest doc_id reached over links, kept marks its row.
    Texts without words and null texts are linked with nothing: they keep their own
    id. Equal texts are always linked. A null doc_id counts only if a component has
    no other; such rows are not marked as kept unless they have no words
    (:func:`keep_one` keeps one of them). Rows that stand twice are rows of their
    own. Other columns are not read. ``small`` and ``block`` set how buckets are
    worked through, not what is found.
    """
    own = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return _components(own, shingle, percent, small, block).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.when(F.col("component").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).alias("kept"),
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = KEEP_PERCENT, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """One row of each component of :func:`near_duplicates`, with all its columns.

    It is one with the smallest doc_id, null last. Rows without words (null and empty
    texts among them) all stay. Of rows that stand twice one stays. An empty table
    gives an empty table.
    """
    uid = free_name(docs, "uid")
    full = numbered(docs, uid)
    rows = _components(full.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(uid).alias("uid")), shingle, percent, small, block)
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid")).alias("lowest")
    rows = cut(rows.select("uid", "doc_id", "component"))
    kept = rows.where("component is not null").groupBy("component").agg(lowest).select(F.col("lowest.uid").alias(uid))
    gone = rows.where("component is not null").select(F.col("uid").alias(uid)).join(kept, uid, "left_anti")
    return _but(full, cut(gone), uid).drop(uid)


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(a, i, i + 4), ' ') AS sh FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 3, 2))) AS i FROM d WHERE len(a) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT p.a, p.b FROM p JOIN n u ON u.doc_id = p.a JOIN n v ON v.doc_id = p.b WHERE 100 * both_have >= 85 * (u.n + v.n - both_have)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS seen FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen
), c AS (
  SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
