"""Quality classifier by positive-unlabelled learning (operator 6).

Trusted positives and unlabelled web text train an additive model over binned
statistics of a text's bytes and words, by the non-negative unbiased risk

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

The class prior is estimated from positives and unlabelled text alone: where the
score is above a threshold, unlabelled text is at least as dense as prior times the
positives, so the least ratio of the two shares bounds the prior, and reaches it
where some scores are had by good text only.

A first fit takes bounded samples. Bin edges, the prior and then PASSES Newton steps
take all unlabelled text of the training folds: with the logistic loss the risk is
convex, and each step sums its slope over all rows, one pass over 27 bytes a row.

Negative labels are no part of that fit. They are used in one place: a two-parameter
logistic fit on labelled rows of the training folds turns the margin into a
probability.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import cut

#: at most so many labelled rows fit the model, and so many unlabelled ones start it
SAMPLE = 20_000
BINS = 16
#: steps over all unlabelled text after the first fit
PASSES = 3
#: steps of the fit that the prior is searched with, and of the one after it; a slope under FLAT ends both
FIRST_STEPS, STEPS, FLAT = 150, 200, 1e-4
RIDGE = 1e-3
THRESHOLD = 0.7

_CLASSES = ("lower", "upper", "digit", "space", "newline", "other_byte", "stop", "comma", "pipe", "bang", "star", "dollar", "amp", "percent", "hash", "quote", "bracket", "mark", "control")
_CLASS = np.full(256, _CLASSES.index("control"), np.int64)
for _name, _bytes in {
    "lower": bytes(range(0x61, 0x7B)), "upper": bytes(range(0x41, 0x5B)), "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "newline": b"\n",
    "other_byte": bytes(range(0x80, 0x100)), "stop": b".", "comma": b",;:", "pipe": b"|", "bang": b"!?", "star": b"*", "dollar": b"$", "amp": b"&", "percent": b"%", "hash": b"#",
    "quote": b"'\"`", "bracket": b"()[]{}<>", "mark": b"-_=+/\\@^~",
}.items():
    _CLASS[list(_bytes)] = _CLASSES.index(_name)
FEATURES = (*_CLASSES, "log_bytes", "log_words", "word_bytes", "upper_start", "repeated", "distinct", "words_a_line", "marked_end")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def text_features(b: W.Block) -> np.ndarray:
    """FEATURES of each text of a block; an empty text has zeros."""
    size = np.diff(b.offsets)
    byte_row = np.repeat(np.arange(b.n), size)
    k = len(_CLASSES)
    counts = np.bincount(byte_row * k + _CLASS[b.data], minlength=b.n * k).reshape(b.n, k).astype(float)
    words = W.split(b.data, b.offsets, W.SPACED)
    n, row = words.counts, words.row
    per_word = np.maximum(n, 1)
    h = W.word_hashes(b.data, words)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    keyed = _distinct_rows(row, h)
    mean = lambda x: np.bincount(row, weights=x, minlength=b.n) / per_word
    first, last = (_CLASS[b.data[words.start]], _CLASS[b.data[words.end - 1]]) if len(h) else (np.zeros(0, int), np.zeros(0, int))
    lines = counts[:, _CLASSES.index("newline")] + 1
    out = np.column_stack([
        counts / np.maximum(size, 1)[:, None], np.log1p(size), np.log1p(n), mean(words.end - words.start), mean(first == _CLASSES.index("upper")), mean(same),
        np.bincount(keyed, minlength=b.n) / per_word, np.log1p(n / lines), mean(last > _CLASSES.index("comma")),
    ])
    out[size == 0] = 0
    return out.astype(np.float32)


def _distinct_rows(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The row of each distinct (row, hash)."""
    salted = np.sort((W.mix(h) & np.uint64((1 << 40) - 1)) | (row.astype(np.uint64) << np.uint64(40)))
    new = np.ones(len(salted), bool)
    new[1:] = salted[1:] != salted[:-1]
    return (salted[new] >> np.uint64(40)).astype(np.int64)


def _features_of(batches):
    for batch in batches:
        for b in W.blocks(batch.column("text")):
            x = text_features(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(b.first_row, b.n), pa.ListArray.from_arrays(pa.array(np.arange(b.n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))],
                ["doc_id", "features"],
            )


@dataclass
class Model:
    edges: np.ndarray
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The bin of each feature of each row."""
        return np.stack([np.searchsorted(self.edges[f], x[:, f], "right") for f in range(x.shape[1])], axis=1)

    def margin_of(self, cells: np.ndarray) -> np.ndarray:
        return self.bias + self.weights[np.arange(cells.shape[1]), cells].sum(axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.margin_of(self.cells(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * self.margin(x) + self.shift)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _slope(cells: np.ndarray, err: np.ndarray) -> np.ndarray:
    """Sums of ``err`` over the rows in each bin of each feature, and over all rows."""
    k = cells.shape[1]
    return np.append(np.bincount((cells + np.arange(k) * BINS).ravel(), weights=np.repeat(err, k), minlength=k * BINS), err.sum())


def _slope_and_loss(model: Model, cells: np.ndarray) -> np.ndarray:
    """The sums of :func:`_slope` of the loss with label 0, and of that loss itself."""
    z = model.margin_of(cells)
    return np.append(_slope(cells, _sigmoid(z)), np.logaddexp(0, z).sum())


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, edges: np.ndarray | None = None, rounds: int = 400, rate: float = 0.05, ridge: float = RIDGE, start: Model | None = None) -> Model:
    """Minimise the non-negative risk with the logistic loss, by full-batch Adam from ``start`` on, until the slope is flat or ``rounds`` are over."""
    if edges is None:
        edges = np.quantile(np.concatenate([positive, unlabelled]), np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy()
    k = positive.shape[1]
    model = Model(edges, np.zeros((k, BINS)), 0.0)
    p, u = model.cells(positive), model.cells(unlabelled)
    flat_p, flat_u = (c + np.arange(k) * BINS for c in (p, u))
    w, m, v = (np.zeros(k * BINS + 1) for _ in range(3))
    if start is not None:
        w = np.append(start.weights.ravel(), start.bias)
    for step in range(1, rounds + 1):
        zp, zu = w[flat_p].sum(axis=1) + w[-1], w[flat_u].sum(axis=1) + w[-1]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_negative = _slope(u, _sigmoid(zu) / len(zu)) - prior * _slope(p, _sigmoid(zp) / len(zp))
        # A negative part under zero is overfitting: step back on it alone.
        g = -of_negative if negative < 0 else prior * _slope(p, (_sigmoid(zp) - 1) / len(zp)) + of_negative
        g += ridge * w
        if np.abs(g).max() < FLAT:
            break
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(edges, w[:-1].reshape(k, BINS), float(w[-1]))


def curvature(model: Model, cells: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Second derivatives of the risk on a sample of unlabelled rows; positives have none with the logistic loss."""
    p = _sigmoid(model.margin_of(cells))
    size = cells.shape[1] * BINS + 1
    h = ridge * np.eye(size)
    for at in range(0, len(cells), 4096):
        c = cells[at : at + 4096]
        x = np.zeros((len(c), size))
        x[np.arange(len(c))[:, None], c + np.arange(c.shape[1]) * BINS] = 1
        x[:, -1] = 1
        h += (x * (p[at : at + 4096] * (1 - p[at : at + 4096]) / len(cells))[:, None]).T @ x
    return h


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, rounds: int = 60) -> Model:
    """Logistic fit of labels on margins, by Newton steps."""
    z = np.column_stack([model.margin(x), np.ones(len(x))])
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = _sigmoid(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        w -= np.linalg.solve(h, z.T @ (p - y) + 1e-3 * (w - [1.0, 0.0]))
    return replace(model, scale=float(w[0]), shift=float(w[1]))


def estimated_prior(above_positive: np.ndarray, above_unlabelled: np.ndarray, n_positive: int, n_unlabelled: int) -> float:
    """The least ratio of shares above a threshold, from the numbers above each. Each share gives way by one standard error."""
    p, u = above_positive / n_positive, above_unlabelled / n_unlabelled
    low = p - np.sqrt(p * (1 - p) / n_positive)
    high = u + np.sqrt(u * (1 - u) / n_unlabelled)
    ok = low > 0.1
    return float(np.clip((high[ok] / low[ok]).min(), 0.01, 0.99)) if ok.any() else 0.5


def _by_hash(ids: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` ids, those with the lowest hash. A threshold on the hash keeps all but about so many from being sorted."""
    n = ids.count()
    share = F.shiftrightunsigned(F.xxhash64("doc_id"), 33).cast("double") / F.lit(2.0**31)
    few = ids if n <= sample else ids.where(share < 1.2 * sample / n)
    return few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def _known(labels: DataFrame, column: str, held: tuple[int, int], sample: int, pick) -> DataFrame:
    """(doc_id, y) of at most ``sample`` labelled ids of the training folds."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).where(~held_out(F.col("doc_id"), *held))
    return cut(_by_hash(ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(pick(column).cast("double").alias("y")), sample))


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("features").combine_chunks().flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float32).reshape(-1, len(FEATURES))


def _cells_of(model: Model):
    def run(batches):
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            c = model.cells(x).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in c], pa.binary())], ["cells"])

    return run


def _rows_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, len(FEATURES)).astype(np.int64)


def _sums_of(make):
    """One row of sums for each partition, as (place, value)."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                one = make(_rows_of(batch.column("cells")))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "value"])

    return run


def _sum(cells: DataFrame, make, size: int) -> np.ndarray:
    """Sums over all rows. ``make`` gives those of a block of rows; ``size`` numbers come to the driver."""
    out = np.zeros(size)
    for r in cells.mapInArrow(_sums_of(make), "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r["place"]] = r["value"]
    return out


def _learn(rows: DataFrame, labels: DataFrame, held: tuple[int, int], sample: int) -> Model | None:
    """The model from a written table of features; None without a labelled good row."""
    training = rows.where(~held_out(F.col("doc_id"), *held))
    known = _known(labels, "quality", held, sample, F.min)
    # Rows of one id count once, as their mean: at most ``sample`` rows come to the driver, whatever repeats.
    each = training.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.array(*(F.avg(F.get("features", F.lit(i))) for i in range(len(FEATURES)))).alias("features"))
    each = each.select("y", "features").toArrow()
    y, x = each.column("y").to_numpy(), _matrix(each)
    if not (y == 1).any():
        return None
    edges = training.select(*(F.percentile_approx(F.get("features", F.lit(i)), [(j + 1) / BINS for j in range(BINS - 1)], 2000).alias(f"e{i}") for i in range(len(FEATURES))), F.count("*").alias("n")).first()
    n, edges = edges["n"], np.array([list(e) for e in edges[:-1]], float)
    start = training if n <= sample else training.where(F.pmod(F.xxhash64("doc_id", "features"), F.lit(1 << 31)) < int((1 << 31) * 0.9 * sample / n)).limit(sample)
    started = _matrix(start.select("features").toArrow())
    positive = x[y == 1]
    # A prior of a half only starts the search for the prior.
    first = fit(positive, started, 0.5, edges, FIRST_STEPS)
    cells = cut(training.mapInArrow(_cells_of(first), "cells binary"))
    at = np.unique(np.quantile(first.margin(positive), np.linspace(0, 0.9, 46)))
    above = _sum(cells, lambda c: (first.margin_of(c)[:, None] >= at).sum(axis=0).astype(float), len(at))
    prior = estimated_prior((first.margin(positive)[:, None] >= at).sum(axis=0), above, len(positive), n)
    model = fit(positive, started, prior, edges, STEPS, start=first)
    p = model.cells(positive)
    mine = _slope(p, np.ones(len(p)) / len(p))
    # Steps on the risk over all rows, with the curvature of the sample.
    inverse = np.linalg.inv(curvature(model, model.cells(started)))
    for _ in range(PASSES):
        sums = _sum(cells, lambda c, m=model: _slope_and_loss(m, c), len(FEATURES) * BINS + 2) / n
        if sums[-1] < prior * np.logaddexp(0, model.margin_of(p)).mean():
            break  # the negative part is under zero: a step would overfit
        w = np.append(model.weights.ravel(), model.bias)
        w = w - inverse @ (sums[:-1] - prior * mine + RIDGE * w)
        model = replace(model, weights=w[:-1].reshape(-1, BINS), bias=float(w[-1]))
    return calibrate(model, x, y) if (y == 0).any() else model


def score_quality(docs: DataFrame, labels: DataFrame, held: tuple[int, int] = (4, 2), sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and quality, 1 for good text; the lowest counts where an id
    has several. Ids with crc32 % held[0] == held[1] are never learned from. The fit
    takes at most ``sample`` labelled ids, of rows that share an id their mean, and all
    unlabelled rows (``sample`` of them to start from). score is the chance that the
    label is 1; predicted is 1 from ``threshold`` on. Null and empty texts are scored
    on features of zero. Repeated rows are scored each. Without a labelled good row
    nothing can be rejected: all scores are 1. An empty table gives no rows. Only the
    text is an input of a score.
    """
    rows = cut(docs.select("doc_id", "text").mapInArrow(_features_of, "doc_id long, features array<float>"))
    model = _learn(rows, labels, held, sample)

    def score(batches):
        for batch in batches:
            if model is None:
                s = np.ones(batch.num_rows)
            else:
                s = model.score(batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), *held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, held: tuple[int, int] = (4, 2), sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that :func:`score_quality` predicts 1, with all their columns.

    The model goes to the texts, not the scores to the texts: no text is shuffled. Rows
    with null or empty texts, null ids and repeated rows are judged by their text like
    all others; without a labelled good row all rows stay.
    """
    rows = cut(docs.select("doc_id", "text").mapInArrow(_features_of, "doc_id long, features array<float>"))
    model = _learn(rows, labels, held, sample)
    if model is None:
        return docs

    def keep(batches):
        for batch in batches:
            good = [model.score(text_features(b)) >= threshold for b in W.blocks(batch.column("text"))]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(keep, docs.schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_quality(docs, labels)
