"""Exact top-k inner products by norm-bucketed retrieval (operator 8).

Vectors are grouped by length into buckets (range partitions of the length,
longest first). Buckets are searched in rounds, GROWTH times as many in each as in
the one before; after a round every query's bound, its k-th best product so far, is
known to the next. A bucket can hold a better vector only at a cosine of at least

    bound / (query length * greatest length in the bucket)

the local threshold. Above 1 the bucket is skipped, and a block of queries that
skips a bucket as a whole is not sent there. Else the bucket, sorted by length, is
cut where even a cosine of 1 would not reach the bound (length pruning), or, where
the threshold is high and a few of its vectors say that it pays, also by
coordinates: a vector at that cosine has a feasible range on the query's largest
coordinates. What is left is verified by full integer products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

K = 5
SCALE = 256
EVERY = 50
#: vectors in a block of candidates, and of queries
BLOCK, QUERIES = 4096, 1024
#: each round searches so many times the buckets of the one before
GROWTH = 8
#: from this local cosine threshold on, pruning by coordinates is tried
COORDINATES_FROM = 0.5
#: coordinates to look at, and the cost of one of them in terms of a product's
FOCUS, LOOK = 4, 8
#: no bound yet
NONE = np.iinfo(np.int64).min
#: products that don't fit
TOO_LOW, TOO_HIGH = NONE + 1, np.iinfo(np.int64).max
_ROUNDING = 1e-9

_BLOCK_COLUMNS = "part int, seq int, uids array<long>, ids array<long>, vecs binary, width int, dim int, longest double"


def _integer_vectors(scale: int):
    """floor(scale * x) of each vector without null and non-finite components, and its length."""

    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            offsets, flat = column.offsets.to_numpy(), column.values
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.append(0, np.cumsum(~np.isfinite(x) | np.asarray(flat.is_null())))
            keep = np.asarray(column.is_valid()) & (bad[offsets[1:]] == bad[offsets[:-1]])
            size = np.diff(offsets)[keep]
            row = np.repeat(np.arange(len(size)), size)
            lead = np.cumsum(size) - size
            v = np.floor(x[np.arange(len(row)) - lead[row] + offsets[:-1][keep][row]] * scale)
            if len(v) and np.abs(v).max() >= 2.0**63:
                raise OverflowError("a scaled component does not fit into 64 bits")
            norm = np.sqrt(np.bincount(row, weights=v * v, minlength=len(size)))
            vecs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(v.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(keep)), vecs, pa.array(norm)], ["vec_id", "vec", "norm"])

    return run


def _pack(size: int):
    """Blocks of up to ``size`` vectors in the order they come in, in the narrowest integers that hold them."""

    def block(part, seq, rows):
        uids, ids, vecs, norms = rows
        dim = max(len(v) for v in vecs)
        m = np.zeros((len(vecs), dim), np.int64)
        for i, v in enumerate(vecs):
            m[i, : len(v)] = v
        width = next(w for w in (2, 4, 8) if not m.size or (m.min() >= np.iinfo(f"i{w}").min and m.max() <= np.iinfo(f"i{w}").max))
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([uids]), pa.array([ids], pa.list_(pa.int64())), pa.array([m.astype(f"<i{width}").tobytes()], pa.binary()), pa.array([width], pa.int32()), pa.array([dim], pa.int32()), pa.array([norms[0]])],
            ["part", "seq", "uids", "ids", "vecs", "width", "dim", "longest"],
        )

    def run(batches):
        rows, part, seq = ([], [], [], []), 0, 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            for r, name in zip(rows, ("uid", "vec_id", "vec", "norm"), strict=True):
                r.extend(batch.column(name).to_pylist())
            while len(rows[0]) >= size:
                yield block(part, seq, tuple(r[:size] for r in rows))
                rows, seq = tuple(r[size:] for r in rows), seq + 1
        if rows[0]:
            yield block(part, seq, rows)

    return run


def _matrix(data: bytes, width: int, dim: int, n: int, wide: int) -> np.ndarray:
    m = np.zeros((n, wide), np.int64)
    m[:, :dim] = np.frombuffer(data, f"<i{width}").reshape(n, dim)
    return m


def _ids(listed) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and which of them are missing."""
    return np.array([0 if i is None else i for i in listed], np.int64), np.array([i is None for i in listed], bool)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows; TOO_HIGH or TOO_LOW where one does not fit into 64 bits.

    In doubles while every sum fits into 53 bits, else in 64-bit integers, whose sums
    are right but for multiples of 2^64. Where sums could be that large, doubles tell
    which ones are, and those too near the limit to tell are added up in full.
    """
    most = (float(np.abs(q.astype(float)).max()) if q.size else 0.0) * (float(np.abs(x.astype(float)).max()) if x.size else 0.0) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    out = q @ x.T
    if most < 2.0**63:
        return out
    a, b = q.astype(np.float64), x.astype(np.float64).T
    near, off = a @ b, (np.abs(a) @ np.abs(b)) * (q.shape[1] + 4) * 2.0**-52
    fits = np.abs(near) + off < 2.0**63
    out[~fits] = np.where(near[~fits] > 0, TOO_HIGH, TOO_LOW)
    for i, j in zip(*np.nonzero(~fits & (np.abs(near) - off < 2.0**63)), strict=True):
        out[i, j] = min(max(sum(int(u) * int(v) for u, v in zip(q[i], x[j], strict=True)), TOO_LOW), TOO_HIGH)
    return out


def best(score: np.ndarray, ids: np.ndarray, last: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; ids marked in ``last`` come after all others."""
    if len(score) > 4 * k:
        bar = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= bar)
        return near[np.lexsort((ids[near], last[near], -score[near]))[:k]]
    return np.lexsort((ids, last, -score))[:k]


def by_length(bound: float, q_norm: float, norms: np.ndarray) -> int:
    """How many of the vectors, longest first, are long enough to reach a positive ``bound`` at a cosine of 1."""
    return int(np.searchsorted(-norms, -bound / q_norm * (1 - _ROUNDING), "right"))


def by_coordinates(bound: float, q: np.ndarray, q_norm: float, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Rows of ``x`` that may reach ``bound`` by what the query's largest coordinates show.

    After some coordinates of both unit vectors, the rest adds at most the product
    of what lengths are left.
    """
    keep = np.arange(len(x))
    direction = q / q_norm
    threshold = np.minimum(1.0, bound / (q_norm * norms)) - _ROUNDING
    partial, left_q, left_x = np.zeros(len(x)), 1.0, np.ones(len(x))
    for f in np.argsort(-np.abs(direction))[:FOCUS]:
        along = x[keep, f] / norms[keep]
        partial, left_q, left_x = partial + direction[f] * along, max(0.0, left_q - direction[f] ** 2), np.maximum(0.0, left_x - along * along)
        ok = partial + np.sqrt(left_q * left_x) >= threshold
        keep, partial, left_x, threshold = keep[ok], partial[ok], left_x[ok], threshold[ok]
    return keep


def search_block(q: np.ndarray, q_norms: np.ndarray, bounds: np.ndarray, x: np.ndarray, norms: np.ndarray):
    """Rows of ``x`` (longest first) that may reach each query's bound, and their products.

    Yields (query, rows, products, pruning), pruning being "length" or "coordinates";
    a query that skips the block yields nothing.
    """
    has = (bounds > 0) & (q_norms > 0)
    longest = max(float(norms[0]), 1e-300)
    with np.errstate(divide="ignore"):
        cosine = np.where(has, bounds / (q_norms * longest), -np.inf)
    dim = q.shape[1]
    dense = []
    for j in range(len(q)):
        n = by_length(bounds[j], q_norms[j], norms) if has[j] else len(x)
        if not n:
            continue
        if cosine[j] >= COORDINATES_FROM:
            # A few vectors of the bucket say how many the coordinates leave.
            some = slice(0, n, max(1, n // 64))
            left = len(by_coordinates(bounds[j], q[j], q_norms[j], x[some], norms[some])) / len(norms[some])
            if FOCUS * LOOK + left * dim < dim:
                rows = by_coordinates(bounds[j], q[j], q_norms[j], x[:n], norms[:n])
                if len(rows):
                    yield j, rows, products(q[j : j + 1], x[rows])[0], "coordinates"
                continue
        dense.append((n, j))
    # Queries that reach about as far into the bucket share one product.
    dense.sort(reverse=True)
    for at in range(0, len(dense), 64):
        group = dense[at : at + 64]
        scores = products(q[[j for _, j in group]], x[: group[0][0]])
        for (n, j), s in zip(group, scores, strict=True):
            yield j, np.arange(n), s[:n], "length"


def _search(k: int):
    """The k best of each query in each (block of queries, block of candidates). A task's own finds raise its bounds."""

    def run(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            out = ([], [], [], [], [])
            for r in batch.to_pylist():
                wide = max(r["q_dim"], r["dim"])
                q = _matrix(r["q_vecs"], r["q_width"], r["q_dim"], len(r["q_uids"]), wide)
                x = _matrix(r["vecs"], r["width"], r["dim"], len(r["uids"]), wide)
                ids, last = _ids(r["ids"])
                uids = np.array(r["uids"])
                norms, q_norms = (np.sqrt((m.astype(float) ** 2).sum(axis=1)) for m in (x, q))
                bounds = np.array([max(NONE if b is None else b, seen.get(u, NONE)) for b, u in zip(r["bounds"], r["q_uids"], strict=True)], np.int64)
                for j, rows, s, _ in search_block(q, q_norms, bounds, x, norms):
                    ok = (uids[rows] != r["q_uids"][j]) & (s >= bounds[j])
                    rows, s = rows[ok], s[ok]
                    top = best(s, ids[rows], last[rows], k)
                    if len(top) == k:
                        seen[r["q_uids"][j]] = max(int(bounds[j]), int(s[top[-1]]))
                    for o, values in zip(out, (np.full(len(top), r["q_uids"][j]), np.full(len(top), r["q_ids"][j]), ids[rows[top]], last[rows[top]], s[top]), strict=True):
                        o.append(values)
            if out[0]:
                uid, query, vec, missing, score = (np.concatenate(o) for o in out)
                yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(query, pa.int64()), pa.array(vec, pa.int64(), mask=missing.astype(bool)), pa.array(score, pa.int64())], ["query", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, block: int = BLOCK, queries: int = QUERIES, growth: int = GROWTH) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` rows with the highest inner product.

    ``vectors`` has vec_id and embedding. Components count as floor(scale * x).
    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows
    but the query's own one (another row with the same vec_id is a candidate). Ties
    go to the smaller vec_id, null last. Vectors that are null or have null or
    non-finite components take no part; a null vec_id is no query. A shorter vector
    has zeros for what it lacks. Fewer than ``k`` candidates give fewer rows, an empty
    table none. Scores are 64-bit integers, and none is rounded: a scaled component, or
    a score of the result, that does not fit raises OverflowError. Products that
    don't fit and are not returned, as a long query's with itself, do no harm.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    base = cut(base.mapInArrow(_integer_vectors(scale), "vec_id long, vec array<long>, norm double").withColumn("uid", F.monotonically_increasing_id()))
    is_query = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    total = base.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max("norm").alias("longest")).first()
    order = [F.desc("norm"), F.asc("uid")]

    def packed(rows: DataFrame, n: int, size: int) -> DataFrame:
        parts = max(1, -(-n // size))
        out = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("uid", "vec_id", "vec", "norm", F.spark_partition_id().alias("part"))
        return cut(out.mapInArrow(_pack(size), _BLOCK_COLUMNS))

    cands = packed(base, total["n"], block)
    asked = packed(base.where(is_query), total["q"], queries)
    asked = asked.select("part", "seq", F.col("uids").alias("q_uids"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), F.col("width").alias("q_width"), F.col("dim").alias("q_dim"))
    block_of = ["part", "seq"]
    mine = asked.select(*block_of, F.posexplode("q_uids").alias("pos", "query")).join(base.where(is_query).select(F.col("uid").alias("query"), "norm"), "query")
    mine = cut(mine)
    last = cands.agg(F.max("part")).first()[0]
    top = None
    began, step = 0, 1
    while last is not None and began <= last:
        kth = F.lit(None).cast("long") if top is None else F.col("bound")
        bounded = mine if top is None else mine.join(top.where(F.col("rank") == k).select("query", F.col("score").alias("bound")), "query", "left")
        need = F.coalesce(F.greatest(kth, F.lit(0)) / F.when(F.col("norm") > 0, F.col("norm")), F.lit(0.0))
        bounds = bounded.groupBy(*block_of).agg(F.min(need).alias("need"), F.sort_array(F.collect_list(F.struct("pos", kth.alias("bound")))).alias("b"))
        questions = asked.join(bounds, block_of).select(F.col("part").alias("q_part"), F.col("seq").alias("q_seq"), "need", F.col("b.bound").alias("bounds"), *(c for c in asked.columns if c not in block_of))
        bucket = cands.where(F.col("part").between(began, began + step - 1))
        # One row for each block of thousands of vectors: the blocks of queries that can reach it.
        cells = questions.select("q_part", "q_seq", "need").withColumn("part", F.explode(F.sequence(F.lit(began), F.lit(min(last, began + step - 1)))))
        cells = cells.join(bucket.select("part", "seq", "longest"), "part").where(F.col("longest") * (1 + _ROUNDING) >= F.col("need"))
        work = cells.select("q_part", "q_seq", "part", "seq").join(questions.drop("need"), ["q_part", "q_seq"]).join(bucket, block_of)
        found = work.select("q_uids", "q_ids", "q_vecs", "q_width", "q_dim", "bounds", "uids", "ids", "vecs", "width", "dim").mapInArrow(_search(k), "query long, query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
        found = found if top is None else found.unionAll(top.drop("rank"))
        top = cut(found.withColumn("rank", rank).where(F.col("rank") <= k))
        began, step = began + step, step * growth
    if top is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # No product exceeds the lengths' own.
    if total["longest"] ** 2 * (1 + _ROUNDING) >= 2.0**63 and top.where(F.col("score").isin(int(TOO_LOW), int(TOO_HIGH))).limit(1).count():
        raise OverflowError("a score does not fit into 64 bits")
    return top.select("query_id", "rank", "vec_id", "score")


def digest(vectors: DataFrame) -> DataFrame:
    return top_k(vectors)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(list_transform(q.e, lambda x: x::DOUBLE), list_transform(c.e, lambda x: x::DOUBLE))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
