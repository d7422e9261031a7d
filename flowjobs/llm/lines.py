"""Line dedup (operator 7), in DataFrame operations only.

Line hashes are range-partitioned with a secondary sort by document and position.
A hash is uniform, so equal ranges of hashes hold about equally many lines; only a
line that fills more than a range by itself is dealt over many ranges, by its
documents. Each range is streamed in the stage that reads the shuffle: the first
document of a hash is known when its rows come by. For the lines that are dealt
over ranges a small table carries the first document of all ranges. What comes back
is a compressed keep bitmap for each document that loses lines, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, free_name, numbered, shuffle_parts

MIN_CHARS = 10
#: ranges of hashes in a shuffle partition; lines that fill SPLIT of a partition are dealt over SPREAD ranges
RANGES, SPLIT, SPREAD = 4, 0.5, 1024
#: one line of so many is looked at to find the lines to deal
SAMPLED = 16
_SPACE = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A missing doc_id is a document of its own that comes after all others.
_LAST_DOC = 9223372036854775807


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z. Text of ASCII alone takes the quicker ``lower``."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(_SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _frequent(lines: DataFrame, parts: int) -> DataFrame:
    """(h1, h2) of the lines that would fill about SPLIT of a shuffle partition or more.

    A sample of hashes tells, since it decides only where rows go, not what is
    found. The table has at most parts / SPLIT rows, whatever the input.
    """
    seen = lines.where(F.pmod(F.xxhash64("uid", "pos"), F.lit(SAMPLED)) == 0)
    counts = seen.groupBy("h1", "h2").agg(F.count("*").alias("c"))
    total = seen.agg(F.count("*").alias("total"))
    return cut(counts.join(total, F.col("c") > F.greatest(F.lit(8), F.col("total") * F.lit(SPLIT / parts))).select("h1", "h2", F.lit(True).alias("dealt")))


def first_seen(lines: DataFrame) -> DataFrame:
    """``lines`` (h1, h2, doc, uid, pos) of a written table, with first, the first document of the line in its range, and dealt."""
    parts = shuffle_parts(lines.sparkSession)
    ranges = parts * RANGES
    # parts / SPLIT rows at most.
    marked = lines.join(F.broadcast(_frequent(lines, parts)), ["h1", "h2"], "left")
    of_hash = F.floor((F.col("h1").cast("double") / F.lit(2.0**64) + 0.5) * ranges)
    part = F.when(F.col("dealt"), ranges + F.pmod(F.xxhash64("h1", "doc"), F.lit(SPREAD))).otherwise(F.least(of_hash, F.lit(ranges - 1)))
    ranged = marked.withColumn("part", part.cast("int")).repartition(parts, "part").sortWithinPartitions("part", "h1", "h2", "doc", "pos")
    return ranged.withColumn("first", F.first("doc").over(Window.partitionBy("part", "h1", "h2").orderBy("doc", "pos")))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(uid, words): for each row that loses lines, its keep bitmap in 64-bit words.

    Bit ``i % 64`` of word ``i // 64`` is 0 where line ``i`` goes. Words that
    keep all their lines are left out. ``docs`` is a written table of doc_id, text, uid.
    """
    key = F.col("key")
    lines = cut(
        docs.select(F.coalesce("doc_id", F.lit(_LAST_DOC)).alias("doc"), "uid", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .select("doc", "uid", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length(key) >= min_chars)
        .select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"), "doc", "uid", "pos")
    )
    later = cut(first_seen(lines).where((F.col("doc") > F.col("first")) | F.col("dealt")).select("h1", "h2", "doc", "uid", "pos", "first", F.coalesce("dealt", F.lit(False)).alias("dealt")))
    carry = later.where("dealt").groupBy("h1", "h2").agg(F.min("doc").alias("carried"))
    # A row goes if its line was first seen in an earlier document.
    dealt = later.where("dealt").join(F.broadcast(carry), ["h1", "h2"]).where(F.col("doc") > F.col("carried"))
    gone = later.where(~F.col("dealt")).select("uid", "pos").unionAll(dealt.select("uid", "pos"))
    gone = gone.select("uid", F.floor(F.col("pos") / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64).alias("bit"))
    return (
        gone.groupBy("uid", "word").agg(F.bitwise_not(F.bit_or("bit")).alias("bits")).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` (text, uid) with n_lines, n_dropped and kept_text, by the bitmaps of :func:`keep_bitmaps`."""
    words = F.col("words")
    size = F.element_at(words, -1)["word"]
    by_word = F.map_from_entries(words)
    dense = F.transform(F.sequence(F.lit(0), size), lambda w: F.coalesce(F.element_at(by_word, w), F.lit(-1).cast("long")))
    keeps = F.filter(F.col("lines"), lambda _, i: F.coalesce(F.getbit(F.get(F.col("dense"), F.floor(i / 64).cast("int")), i % 64) == 1, F.lit(True)))
    return (
        docs.join(bitmaps, "uid", "left")
        .withColumns({"lines": _lines(F.col("text")), "dense": F.when(words.isNotNull(), dense)})
        .withColumn("kept", F.when(words.isNull(), F.col("lines")).otherwise(keeps))
        .select(*docs.columns, F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))
    )


def _deduped(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text, rest (all other columns of ``docs``), n_lines, n_dropped, kept_text. Each text is written and shuffled once."""
    own = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct("*").dropFields("text").alias("rest")))
    return apply_bitmaps(own, keep_bitmaps(own.select("doc_id", "text", "uid"), min_chars))


def _own(docs: DataFrame):
    """The columns of ``docs`` by name, from the table that :func:`_deduped` makes."""
    text = "text" if "text" in docs.columns else next(c for c in docs.columns if c.lower() == "text")
    return lambda c: F.col("text") if c == text else F.col("rest").getField(c)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Lines held by two or more documents stay only in the document with the smallest doc_id.

    ``docs`` needs doc_id and text; all its columns come back, with n_lines,
    n_dropped and kept_text (columns of its own with one of these names keep their
    values under the name with a leading underscore). A line's key is the line
    without ASCII white space at its ends, A-Z lower-cased; keys under ``min_chars``
    code points always stay. Null or empty text is one empty line. Rows with one
    doc_id are one document, repeated rows too. A null doc_id is a document of its
    own that comes last. An empty table gives an empty table.
    """
    new = ("n_lines", "n_dropped", "kept_text")
    own = _own(docs)
    return _deduped(docs, min_chars).select(*(own(c).alias(free_name(docs, c) if c in new else c) for c in docs.columns), *new)


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the lines that :func:`dedup_lines` keeps as text, and n_chars to match where there is such a column.

    Rows that lose no line come back as they are: a null text stays null, and
    n_chars stays what it was.
    """
    lost = F.col("n_dropped") > 0
    new = {"text": F.when(lost, F.col("kept_text")), "n_chars": F.when(lost, F.length("kept_text").cast("long"))}
    own = _own(docs)
    return _deduped(docs, min_chars).select(*[(F.coalesce(new[c].cast(docs.schema[c].dataType), own(c)) if c in new else own(c)).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    own = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    out = apply_bitmaps(own, keep_bitmaps(own))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key, min(doc_id) AS keep FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), d AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.keep AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
