"""License scans by diagonal voting (operator 5).

Rolling hashes of word k-grams are joined to their positions in templates. Each
hit votes for a diagonal, text position minus template position; votes on
neighbouring diagonals are merged (words may be missing or added), and a merged
span counts once the words it really shares with the template cover enough of it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .tables import cut

GRAM = 5
#: diagonals up to so far apart are one span
SLACK = 4
#: share of a template's k-grams that a span must hold
COVER = 0.5
#: up to so many template k-grams travel to the tasks as a filter (8 bytes each)
FILTER_GRAMS = 2_000_000

#: Phrases and labels, fixed values.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Opening passages of public license notices and their labels, fixed values.
NOTICES = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd-text"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache-text"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl-text"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-text"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl-text"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc-text"),
    ("This is free and unencumbered software released into the public domain", "unlicense-text"),
    ("All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form", "reserved-text"),
)


def _template_grams(templates: Sequence[tuple[str, str]], gram: int) -> list[tuple]:
    """(gram size, hash, template, its words, position, gram's words)."""
    out = []
    for i, (text, _) in enumerate(templates):
        low = W.LOWER[np.frombuffer(text.encode(), np.uint8)]
        words = W.split(low, np.array([0, len(low)]), W.ALNUM)
        n = len(words.start)
        if not n:
            continue
        size = min(gram, n)
        at, h = W.windows(W.word_hashes(low, words), words, size)
        listed = [low[s:e].tobytes().decode() for s, e in zip(words.start, words.end, strict=True)]
        out += [(size, int(x), i, n, int(p), " ".join(listed[p : p + size])) for p, x in zip(at, W.signed(h), strict=True)]
    return out


def _hits_of(keep: dict[int, np.ndarray] | None, sizes: list[int]):
    def run(batches):
        for batch in batches:
            n_words, hits = [], []
            for b in W.blocks(batch.column("text")):
                low = W.LOWER[b.data]
                words = W.split(low, b.offsets, W.ALNUM)
                h = W.word_hashes(low, words)
                n_words += words.counts.tolist()
                rows = [[] for _ in range(b.n)]
                for size in sizes:
                    at, g = W.windows(h, words, size)
                    if keep is not None and len(g):
                        i = np.searchsorted(keep[size], g)
                        ok = keep[size][np.minimum(i, len(keep[size]) - 1)] == g
                        at, g = at[ok], g[ok]
                    row = np.searchsorted(words.first, at, "right") - 1
                    for r, a, x in zip(row.tolist(), at.tolist(), W.signed(g).tolist(), strict=True):
                        listed = b" ".join(low[s:e].tobytes() for s, e in zip(words.start[a : a + size], words.end[a : a + size], strict=True))
                        rows[r].append((size, x, a - int(words.first[r]), listed.decode()))
                hits += rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array([[dict(zip(("size", "hash", "pos", "gram"), x, strict=True)) for x in r] for r in hits], pa.list_(pa.struct([("size", pa.int32()), ("hash", pa.int64()), ("pos", pa.int32()), ("gram", pa.string())])))],
                ["doc_id", "n_words", "hits"],
            )

    return run


def find_spans(docs: DataFrame, templates: Sequence[tuple[str, str]], gram: int = GRAM, slack: int = SLACK, cover: float = COVER) -> tuple[DataFrame, DataFrame]:
    """(rows, spans) of ``docs`` (doc_id, text) against ``templates`` (text, label).

    rows: row, doc_id, n_words of each row. spans: row, template, label, first_word,
    last_word, share. A template shorter than ``gram`` words is found as a whole.
    """
    spark = docs.sparkSession
    grams = _template_grams(templates, gram)
    sizes = sorted({g[0] for g in grams})
    keep = {s: np.sort(np.unique(np.array([g[1] for g in grams if g[0] == s], np.int64)).view(np.uint64)) for s in sizes} if len(grams) <= FILTER_GRAMS else None
    scanned = docs.select("doc_id", "text").mapInArrow(_hits_of(keep, sizes), "doc_id long, n_words long, hits array<struct<size int, hash long, pos int, gram string>>")
    scanned = cut(scanned.withColumn("row", F.monotonically_increasing_id()))
    table = spark.createDataFrame(grams, "size int, hash long, template int, words int, at int, gram string")
    labels = spark.createDataFrame([(i, x[1]) for i, x in enumerate(templates)], "template int, label string")
    # The join takes hash and words: a hash alone proves nothing.
    hits = scanned.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*").join(table, ["size", "hash", "gram"])
    diagonals = hits.withColumn("diagonal", F.col("pos") - F.col("at"))
    by = Window.partitionBy("row", "template").orderBy("diagonal", "pos")
    new = F.col("diagonal") - F.coalesce(F.lag("diagonal").over(by), F.col("diagonal") - F.lit(slack + 1)) > slack
    # Whole-phrase hits lie on diagonals of their own: each place is a span.
    new = new | (F.col("size") == F.col("words")) & (F.col("diagonal") != F.coalesce(F.lag("diagonal").over(by), F.col("diagonal") - 1))
    merged = diagonals.withColumn("new", new.cast("int")).withColumn("span", F.sum("new").over(by))
    spans = merged.groupBy("row", "template", "span").agg(
        F.min("pos").alias("first_word"), F.max(F.col("pos") + F.col("size") - 1).alias("last_word"), (F.count_distinct("at") / F.max(F.col("words") - F.col("size") + 1)).alias("share")
    )
    return scanned.select("row", "doc_id", "n_words"), spans.where(F.col("share") >= cover).join(labels, "template").drop("span")


def scan_licenses(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of ``docs`` (doc_id, text).

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII
    characters. Base places are those of ``phrases``, word for word; ``notices`` add
    labels of their own where at least COVER of a notice stands in the text. score is
    the largest share of a template found, 1 for a phrase, 0 for none. Null and
    empty texts have no words. Repeated rows are rows of their own. Other columns are
    not read.
    """
    templates = [*phrases, *notices]
    rows, spans = find_spans(docs, templates)
    base = F.col("template") < len(phrases)
    found = spans.groupBy("row").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.least(F.max("share"), F.lit(1.0)).alias("score"),
    )
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    out = rows.join(found, "row", "left").drop("row")
    return out.withColumns({c: F.coalesce(c, x) for c, x in none.items()}).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 6).alias("score"))


def digest(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs)


def oracle_sql() -> str:
    """The scan in SQL: k-grams as text, diagonals, gaps of over SLACK between them."""
    grams = _template_grams([*PHRASES, *NOTICES], GRAM)
    labels = [x[1] for x in (*PHRASES, *NOTICES)]
    rows = ", ".join(f"({size}, {i}, '{labels[i]}', {words}, {at}, '{gram}')" for size, _, i, words, at, gram in grams)
    sizes = ", ".join(str(s) for s in sorted({g[0] for g in grams}))
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM documents
), t(size, template, label, words, at_word, gram) AS (VALUES {rows}
), g AS (
  SELECT doc_id, size, i - 1 AS pos, array_to_string(list_slice(a, i, i + size - 1), ' ') AS gram
  FROM (SELECT doc_id, a, size, unnest(range(1, len(a) - size + 2)) AS i FROM d, (SELECT unnest([{sizes}]) AS size))
), h AS (
  SELECT g.doc_id, g.pos, t.*, g.pos - t.at_word AS diagonal FROM g JOIN t ON t.size = g.size AND t.gram = g.gram
), m AS (
  SELECT *, CASE WHEN before IS NULL OR diagonal - before > {SLACK} OR (size = words AND diagonal <> before) THEN 1 ELSE 0 END AS new
  FROM (SELECT *, lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal, pos) AS before FROM h)
), p AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal, pos) AS span FROM m
), s AS (
  SELECT doc_id, template, label, min(pos) AS first_word, count(DISTINCT at_word)::DOUBLE / max(words - size + 1) AS share FROM p GROUP BY doc_id, template, label, span HAVING share >= {COVER}
), r AS (
  SELECT doc_id, count(*) FILTER (WHERE template < {len(PHRASES)}) AS n_base, min(first_word) FILTER (WHERE template < {len(PHRASES)}) AS first_word, max(first_word) FILTER (WHERE template < {len(PHRASES)}) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE template < {len(PHRASES)}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, least(max(share), 1.0) AS score
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, len(a)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6)::DOUBLE AS score
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""
