"""How filters overlap: what each removes in every order, and its Shapley value (operator 11).

Filters that were applied are a state, a set of them; an order is a path from the
empty set to the full one. Counting paths forward from the start and backward from
the end tells how many orders take each edge (state, next filter). Rows are counted
once by the set of filters that they fail; what an edge removes is a sum of such
counts. Weighted by their orders, the edges give the Shapley values; an order's
steps are read from the same edges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as W
from .tables import cut

#: Conditions of the filters, fixed values: words at least, distinct share of words at least and capitals of characters at most in percent, characters never.
MIN_WORDS, DISTINCT, CAPITALS, SIGNS = 200, 50, 3, "#$%&*|"
FILTERS = "ABCDE"
#: each order is a row of the result; eight filters have 40,320
MOST_FILTERS = 8

_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x41:0x5B] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(SIGNS.encode())] = True


@dataclass
class Lattice:
    """Subsets of ``n`` filters as bit sets. ``before``: pairs (i, j), i comes before j in all orders."""

    n: int
    before: Sequence[tuple[int, int]] = ()
    #: orders that lead to a state, and from it to the full set
    forward: list[int] = field(init=False)
    backward: list[int] = field(init=False)

    def __post_init__(self):
        full = (1 << self.n) - 1
        self.forward, self.backward = [0] * (full + 1), [0] * (full + 1)
        self.forward[0] = self.backward[full] = 1
        for state in range(full + 1):
            for f in self.next(state):
                self.forward[state | 1 << f] += self.forward[state]
        for state in range(full, -1, -1):
            for f in self.next(state):
                self.backward[state] += self.backward[state | 1 << f]

    def next(self, state: int) -> list[int]:
        return [f for f in range(self.n) if not state >> f & 1 and all(state >> i & 1 for i, j in self.before if j == f)]

    def edges(self) -> list[tuple[int, int, int]]:
        """(state, filter, orders that take it), for each edge that an order takes."""
        each = ((s, f, self.forward[s] * self.backward[s | 1 << f]) for s in range(1 << self.n) for f in self.next(s))
        return [e for e in each if e[2]]

    def orders(self, state: int = 0) -> list[list[int]]:
        return [[f, *rest] for f in self.next(state) for rest in self.orders(state | 1 << f)] if state != (1 << self.n) - 1 else [[]]


def _looks(batches):
    """What the filters on one text alone say, as bits, and the text's key."""
    for batch in batches:
        for b in W.blocks(batch.column("text")):
            words = W.split(b.data, b.offsets, W.SPACED)
            row, h = words.row, W.word_hashes(b.data, words)
            order = np.lexsort((h, row))
            new = np.ones(len(h), bool)
            new[1:] = (np.diff(row[order]) != 0) | (h[order][1:] != h[order][:-1])
            distinct, n = np.bincount(row[order][new], minlength=b.n), words.counts
            total = lambda inside: np.diff(np.append(0, np.cumsum(inside))[b.offsets])  # noqa: B023, E731
            chars, capitals = total((b.data & 0xC0) != 0x80), total(_CAPITAL[b.data])
            fails = (n < MIN_WORDS, 100 * distinct < DISTINCT * n, 100 * capitals > CAPITALS * chars, total(_SIGN[b.data]) > 0)
            bits = sum(x.astype(np.int32) << k for k, x in enumerate(fails))
            keys = [hashlib.blake2b(b.text(r), digest_size=16).digest() for r in range(b.n)]
            at = slice(b.first_row, b.first_row + b.n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[at], batch.column("lang")[at], pa.array(keys, pa.binary()), pa.array(bits, pa.int32())], ["doc_id", "lang", "key", "bits"])


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, A, B, C, D, E) of each row of ``docs`` (doc_id, text, lang): which filters it fails.

    A: fewer than 200 words; B: under half of the words distinct; C: over 3 % capital
    letters A-Z; D: one of #$%&*|; E: a row with a smaller doc_id has the same text. A
    null text counts as empty, a null lang is the part ''; a null doc_id is neither
    smaller nor larger than others, so that repeated rows of one id don't fail E for
    each other. Texts are told apart by hashes of 128 bits, words over 8 bytes by 64.
    """
    looks = cut(docs.select("doc_id", "text", "lang").mapInArrow(_looks, "doc_id long, lang string, key binary, bits int"))
    firsts = cut(looks.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("key", "first"))
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    each = [(F.col("bits").bitwiseAND(1 << k) != 0).alias(name) for k, name in enumerate(FILTERS[:-1])]
    return looks.join(firsts, "key", "left").select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), *each, later.alias(FILTERS[-1]))


def audit(rows: DataFrame, filters: Sequence[str], part: str = "part", lost: Sequence[str] = (), before: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """One row for each ``part`` of ``rows``, each order of ``filters`` and each step of it, zeros included.

    ``rows`` has a boolean column for each filter, true where the row fails it (null:
    it passes), and for each name of ``lost``. Result: part, filter_order (the names
    joined), step from 1; kept (rows left after the step), removed (at it), redundant
    (they fail its filter and are gone before), unique_fails (they fail its filter
    alone), {name}_lost (those removed here that are marked), shapley (what the filter
    removes, summed over all orders). ``before`` has pairs of filters that keep their
    order in all orders. No rows, no parts.
    """
    if not 0 < len(filters) <= MOST_FILTERS or len(set(filters)) < len(filters):
        raise ValueError(f"one to {MOST_FILTERS} filters with different names")
    number = {name: k for k, name in enumerate(filters)}
    lattice = Lattice(len(filters), [(number[i], number[j]) for i, j in before])
    edges = lattice.edges()
    if not edges:
        raise ValueError("no order keeps all pairs of before")
    bits = sum((F.when(F.col(name), 1 << k).otherwise(0) for name, k in number.items()), F.lit(0))
    marked = [F.sum(F.when(F.col(name), 1).otherwise(0)).alias(f"{name}_lost") for name in lost]
    counts = rows.groupBy(F.col(part).alias("part"), bits.alias("fails")).agg(F.count("*").alias("n"), *marked)

    # Sums over at most 2 ** filters counts of a part for each edge.
    listed = F.array(*[F.struct(F.lit(k).alias("edge"), F.lit(s).alias("state"), F.lit(1 << f).alias("own"), F.lit(w).cast("long").alias("orders")) for k, (s, f, w) in enumerate(edges)])
    at = counts.withColumn("e", F.explode(listed)).select("*", "e.*")
    fails = F.col("fails").bitwiseAND(F.col("own")) != 0
    here = fails & (F.col("fails").bitwiseAND(F.col("state")) == 0)
    of = lambda condition, value: F.sum(F.when(condition, F.col(value)).otherwise(0))
    by_edge = at.groupBy("part", "edge", "own", "orders").agg(
        of(F.col("fails").bitwiseAND(F.col("state").bitwiseOR(F.col("own"))) == 0, "n").alias("kept"), of(here, "n").alias("removed"), of(fails & ~here, "n").alias("redundant"), of(F.col("fails") == F.col("own"), "n").alias("unique_fails"),
        *[of(here, f"{name}_lost").alias(f"{name}_lost") for name in lost],
    )
    by_edge = by_edge.withColumn("shapley", F.sum(F.col("orders") * F.col("removed")).over(Window.partitionBy("part", "own")))

    place = {(s, f): k for k, (s, f, _) in enumerate(edges)}
    steps = [(place[sum(1 << f for f in order[:k]), f], "".join(filters[g] for g in order), k + 1) for order in lattice.orders() for k, f in enumerate(order)]
    table = rows.sparkSession.createDataFrame(steps, "edge int, filter_order string, step int")
    return by_edge.join(table, "edge").select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{name}_lost" for name in lost], "shapley")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`audit` of the five filters, by language, with good and toxic rows lost.

    ``labels`` has doc_id, quality and toxic; of several rows of an id the highest
    counts, ids without labels are neither good nor toxic.
    """
    marks = labels.groupBy("doc_id").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    return audit(failures(docs).join(marks, "doc_id", "left"), FILTERS, lost=("good", "toxic"))


ORACLE_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM texts),
looks AS (
  SELECT doc_id, part, (len(words) < 200)::INT AS a, (100 * len(list_distinct(words)) < 50 * len(words))::INT AS b, (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT AS c,
         regexp_matches(t, '[#$%&*|]')::INT AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS e
  FROM split
), marks AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
counts AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM looks LEFT JOIN marks USING (doc_id) GROUP BY ALL
), f AS (SELECT unnest(range(5)) AS k),
orders AS (
  SELECT [p.k, q.k, r.k, s.k, t.k] AS o FROM f p, f q, f r, f s, f t WHERE len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5
), steps AS (
  SELECT list_aggregate(list_transform(o, lambda k: chr((65 + k)::INT)), 'string_agg', '') AS filter_order, step::INT AS step, (1 << o[step])::INT AS own, list_sum(list_transform(o[:step - 1], lambda k: 1 << k)) AS state
  FROM orders, unnest(range(1, 6)) AS u(step)
), seen AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (fails & (coalesce(state, 0)::INT | own) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails & own <> 0 AND fails & coalesce(state, 0)::INT = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails & own <> 0 AND fails & coalesce(state, 0)::INT <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails & own <> 0 AND fails & coalesce(state, 0)::INT = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (fails & own <> 0 AND fails & coalesce(state, 0)::INT = 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM seen"""
