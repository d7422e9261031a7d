"""Counterfactual-regularised toxicity classifier (operator 10).

A logistic model over words and repeated word beginnings. For each labelled
sentence that names an identity group, counterfactuals swap its terms for others of
the same language, word class and number; the training objective adds a penalty on
the change of the score, so a neutral mention of a group moves no score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .quality import _known, _sigmoid, held_out
from .tables import cut

#: at most so many labelled rows fit the model
SAMPLE = 20_000
#: a feature counts if its log odds are so many standard deviations from none
TELLING = 2.5
THRESHOLD = 0.5
PENALTY = 1.0
#: beginnings of words, in bytes, that are counted up to LEVELS times
PREFIXES, LEVELS = (4, 5, 7), 3

#: Identity terms, fixed values: those of one line may stand for one another (one language, word class and number).
IDENTITY = tuple(
    line.split()
    for line in (
        "women men girls boys",
        "woman man girl boy",
        "muslims christians jews hindus buddhists atheists",
        "muslim christian jewish hindu buddhist",
        "asians africans europeans americans mexicans arabs immigrants refugees foreigners",
        "asian african european american mexican arab latino",
        "gay lesbian bisexual transgender queer heterosexual",
        "frauen männer mädchen jungen",
        "juden muslime christen hindus buddhisten",
        "femmes hommes filles garçons",
        "juifs musulmans chrétiens hindous bouddhistes",
        "mujeres hombres chicas chicos",
        "judíos musulmanes cristianos hindúes budistas",
    )
)
#: counterfactuals of a sentence: each term moves on by so many places in its line
SWAPS = (1, 2)
_OTHERS = [f"swapped{by}" for by in SWAPS]


def _hash_of(words) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return W.word_hashes(data, W.split(data, np.array([0, len(data)]), W.ALNUM))


def _kind(h: np.ndarray, kind: int) -> np.ndarray:
    return W.mix(h ^ np.uint64((kind + 1) * 0xA0761D6478BD642F % (1 << 64)))


def _unique(row: np.ndarray, h: np.ndarray):
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    lead = np.flatnonzero(new)
    return row[lead], h[lead], np.diff(np.append(lead, len(h)))


def word_features(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None, swap: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each feature that a row has, once. ``keep``: sorted features, all others are left out.

    ``swap`` maps the hash of a term to another term, which then stands in its place.
    """
    low = W.LOWER[data]
    words = W.split(low, offsets, W.ALNUM)
    hasher, row = W.Hasher(low), words.row
    rows, found = [], []
    kinds = [(words.end, None), *((np.minimum(words.start + p, words.end), p) for p in PREFIXES)]
    whole = hasher.ranges(words.start, words.end)
    swapped = np.isin(whole, np.array(list(swap), np.uint64)) if swap else None
    for kind, (end, prefix) in enumerate(kinds):
        h = hasher.ranges(words.start, end)
        if swap:
            for i in np.flatnonzero(swapped):
                term = np.frombuffer(swap[int(whole[i])].encode(), np.uint8)
                h[i] = W.Hasher(term).ranges(np.array([0]), np.array([min(prefix or len(term), len(term))]))[0]
        h = _kind(h, kind)
        if keep is not None:
            marks = keep[0]
            at = np.searchsorted(marks, h)
            ok = marks[np.minimum(at, len(marks) - 1)] == h if len(marks) else np.zeros(len(h), bool)
            r, g, n = _unique(row[ok], h[ok])
        else:
            r, g, n = _unique(row, h)
        for level in range(1, (1 if prefix is None else LEVELS) + 1):
            rows.append(r[n >= level])
            found.append(W.mix(g[n >= level] + np.uint64(level)))
    rows, found = np.concatenate(rows), np.concatenate(found)
    if keep is not None:
        at = np.searchsorted(keep[1], found)
        ok = keep[1][np.minimum(at, len(keep[1]) - 1)] == found if len(keep[1]) else np.zeros(len(found), bool)
        rows, found = rows[ok], found[ok]
    return rows, found


def _swaps(by: int) -> dict:
    """Each term's hash and the term ``by`` places on in its line; the first line of a term counts."""
    out: dict[int, str] = {}
    for line in IDENTITY:
        for i, h in enumerate(_hash_of(line)):
            out.setdefault(int(h), line[(i + by) % len(line)])
    return out


def _lists(n: int, rows: np.ndarray, values: np.ndarray) -> pa.Array:
    order = np.argsort(rows, kind="stable")
    ends = np.append(0, np.cumsum(np.bincount(rows, minlength=n)))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(W.signed(values[order])))


def _train_rows(batches):
    """Features of each labelled row, and of its counterfactuals where it names a group."""
    swaps = [_swaps(by) for by in SWAPS]
    terms = np.array(list(swaps[0]), np.uint64)
    for batch in batches:
        for b in W.blocks(batch.column("text")):
            r, f = word_features(b.data, b.offsets)
            low = W.LOWER[b.data]
            words = W.split(low, b.offsets, W.ALNUM)
            named = np.zeros(b.n, bool)
            named[words.row[np.isin(W.word_hashes(low, words), terms)]] = True
            other = []
            for swap in swaps:
                r2, f2 = word_features(b.data, b.offsets, swap=swap) if named.any() else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                mine = named[r2]
                other.append(_lists(b.n, r2[mine], f2[mine]))
            yield pa.RecordBatch.from_arrays([batch.column("y").slice(b.first_row, b.n), _lists(b.n, r, f), pa.array(named), *other], ["y", "features", "named", *_OTHERS])


def _marks(features: np.ndarray) -> np.ndarray:
    """Hashes that lead to one of the features at some level."""
    return np.unique(np.concatenate([W.unmix(features) - np.uint64(level) for level in range(1, LEVELS + 1)]))


@dataclass
class Model:
    #: hashes of the words and word beginnings, before their levels, that some feature needs
    marks: np.ndarray
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, b: W.Block) -> np.ndarray:
        z = np.full(b.n, self.bias)
        if len(self.features):
            r, f = word_features(b.data, b.offsets, (self.marks, self.features))
            np.add.at(z, r, self.weights[np.searchsorted(self.features, f)])
        return _sigmoid(z)


def fit(x: list[np.ndarray], y: np.ndarray, swapped: list[tuple[int, np.ndarray]], size: int, penalty: float = PENALTY, rounds: int = 300, rate: float = 0.05, ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias over feature numbers: logistic loss, ridge, and penalty * mean squared change of the margin on counterfactuals, (row, its features) each."""
    at = np.concatenate([np.asarray(i, np.int64) for i in x]) if x else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(x)), [len(i) for i in x])
    pairs = swapped
    cf_at = np.concatenate([np.concatenate([x[i], s]) for i, s in pairs]).astype(np.int64) if pairs else np.zeros(0, np.int64)
    cf_row = np.repeat(np.arange(len(pairs)), [len(x[i]) + len(s) for i, s in pairs])
    cf_sign = np.concatenate([np.concatenate([np.ones(len(x[i])), -np.ones(len(s))]) for i, s in pairs]) if pairs else np.zeros(0)
    w, m, v = (np.zeros(size + 1) for _ in range(3))
    for step in range(1, rounds + 1):
        z = np.bincount(row, weights=w[at], minlength=len(x)) + w[-1]
        err = (_sigmoid(z) - y) / len(y)
        g = np.append(np.bincount(at, weights=err[row], minlength=size), err.sum())
        g[:-1] += ridge * w[:-1]
        if pairs:
            change = np.bincount(cf_row, weights=w[cf_at] * cf_sign, minlength=len(pairs))
            g[:-1] += 2 * penalty / len(pairs) * np.bincount(cf_at, weights=change[cf_row] * cf_sign, minlength=size)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, held: tuple[int, int], sample: int, telling: float, penalty: float) -> Model:
    known = _known(labels, "toxic", held, sample, F.max)
    # At most ``sample`` ids. Of rows with one id one text is learned from, that with the lowest hash: so many rows at most, whatever repeats.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))
    lists = ", ".join(f"{c} array<long>" for c in _OTHERS)
    rows = cut(rows.select("y", "text").mapInArrow(_train_rows, f"y double, features array<long>, named boolean, {lists}"))
    totals = rows.agg(F.count("*").alias("n"), F.sum("y").alias("pos")).first()
    n, pos = totals["n"], totals["pos"] or 0.0
    if not n or not 0 < pos < n:
        return Model(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0), 0.0 if not n else (9.0 if pos else -9.0))
    by = rows.select("y", F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    p, q = (F.col("pos") + 0.5), (F.col("n") - F.col("pos") + 0.5)
    lift = F.log(p / F.lit(pos) / (q / F.lit(n - pos)))
    chosen = by.where(F.abs(lift) / F.sqrt(1 / p + 1 / q) >= telling).select("f")
    # Features of the sampled rows alone.
    chosen = np.sort(chosen.toArrow().column("f").to_numpy().view(np.uint64))
    if not len(chosen):
        return Model(chosen, chosen, np.zeros(0), float(np.log(pos / (n - pos))))

    def numbers(batches):
        for batch in batches:
            cols = [batch.column("y")]
            for name in ("features", *_OTHERS):
                out = []
                for x in batch.column(name):
                    h = x.values.to_numpy().view(np.uint64) if len(x) else np.zeros(0, np.uint64)
                    at = np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)
                    out.append(at[chosen[at] == h].tolist())
                cols.append(pa.array(out, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*cols, batch.column("named")], ["y", "x", *_OTHERS, "named"])

    lists = ", ".join(f"{c} array<int>" for c in _OTHERS)
    got = rows.mapInArrow(numbers, f"y double, x array<int>, {lists}, named boolean").toArrow().to_pydict()
    x = [np.array(i, np.int64) for i in got["x"]]
    swapped = [(i, np.array(got[c][i], np.int64)) for c in _OTHERS for i, named in enumerate(got["named"]) if named]
    weights, bias = fit(x, np.array(got["y"]), swapped, len(chosen), penalty)
    return Model(_marks(chosen), chosen, weights, bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, held: tuple[int, int] = (5, 0), sample: int = SAMPLE, telling: float = TELLING, penalty: float = PENALTY, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and toxic, 1 for toxic text; the highest counts where an id
    has several. Ids with crc32 % held[0] == held[1] are never learned from. The fit
    takes at most ``sample`` labelled ids, one text each, and all features whose log
    odds in these texts differ from none by ``telling`` standard deviations. Repeated rows are
    scored each; an empty table gives no rows.
    score is the chance that the label is 1; predicted is 1 from ``threshold`` on.
    Null and empty texts score the bias alone; so do all texts where no row is
    labelled or all are labelled alike. Only the text is an input of a score.
    """
    model = train(docs, labels, held, sample, telling, penalty)

    def score(batches):
        for batch in batches:
            for b in W.blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(b.first_row, b.n), pa.array(model.score(b))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), *held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs, labels)
