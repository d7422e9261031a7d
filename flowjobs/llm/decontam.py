"""Benchmark decontamination by template canonicalisation (operator 2).

Texts become templates: numbers, names and units turn into typed placeholders.
Windows of template tokens are hash-joined with the windows of the benchmark
items, so an item is found again with other numbers or names. Each join hit
brings the values in its slots; an item whose slots are filled inconsistently
(one value of the item standing for two in the text) is no copy.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .tables import cut, free_name, numbered

WINDOW = 8
#: a window is rich with so many plain tokens, which are no placeholders (in a shorter one: half)
LITERAL = 5
#: items up to a window long are also found without their first token, from so many tokens on
HEADLESS = 5
#: an item counts as leaked from so many of its tokens in one run on, or this share of them
RUN_TOKENS, SHARE = 13, 0.5
#: up to so many benchmark windows travel to the tasks as a filter (8 bytes each)
FILTER_WINDOWS = 2_000_000

#: Units in four languages, singular and plural, fixed values.
UNITS = (
    "mm cm dm m km millimeter millimeters millimetre millimetres centimeter centimeters centimetre centimetres meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet yard yards mile miles "
    "mg g kg gram grams gramme grammes kilogram kilograms kilogramme kilogrammes kilo kilos pound pounds ounce ounces ton tons tonne tonnes ml cl l milliliter milliliters liter liters litre litres gallon gallons cup cups "
    "ms second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros pound pounds usd eur gbp percent degree degrees mph kmh kph "
    "watt watts kilowatt kilowatts volt volts amp amps joule joules calorie calories hertz hz kw kwh bit bits byte bytes gb mb kb "
    "metern kilometern zentimeter zoll meile meilen gramm kilogramm pfund tonnen litern sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad "
    "mètre mètres kilomètre kilomètres centimètre centimètres litres seconde secondes heure heures jour jours semaine semaines mois an ans année années degré degrés "
    "metro metros kilómetro kilómetros centímetro centímetros milla millas gramo gramos kilogramo kilogramos tonelada toneladas litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años grado grados"
).split()
#: Numbers that are written out, fixed values; words that often mean something else are left out.
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze quinze vingt trente quarante cinquante soixante "
    "dos tres cuatro cinco seis siete ocho nueve diez doce quince veinte treinta cuarenta cincuenta sesenta"
).split()
#: an alignment may fill one name in so many plain tokens differently
NAMES_EVERY = 4
_NUMBER, _NAME, _UNIT = (W.mix(np.array([i], np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))[0] for i in (1, 2, 3))
_BY_VALUE = np.uint64(0x5851F42D4C957F2D)
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[ord(c) for c in ".!?:;\n\r\""]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_JOINT = np.zeros(256, bool)
_JOINT[[ord(c) for c in ".,"]] = True


def _hashes_of(words) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.unique(W.word_hashes(data, W.split(data, np.array([0, len(data)]), W.ALNUM)))


_UNIT_HASHES, _WRITTEN_OUT = _hashes_of(UNITS), _hashes_of(NUMBER_WORDS)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


@dataclass
class Templates:
    words: W.Words
    #: of each token: its hash or its placeholder's
    token: np.ndarray
    #: of each token: hash of what stands in the text
    value: np.ndarray
    slot: np.ndarray
    #: of each token: a capitalised word that only where it stands, at the start of a sentence, keeps from being a name
    leads: np.ndarray


def templates(data: np.ndarray, offsets: np.ndarray) -> Templates:
    """Template tokens of each row. Names are capitalised words within a sentence; a unit follows a number."""
    low = W.LOWER[data]
    words = W.split(low, offsets, W.ALNUM)
    start, end, first = words.start, words.end, words.first
    if not len(start):
        return Templates(words, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool))
    digits = np.append(0, np.cumsum(_DIGIT[low]))
    number = _DIGIT[low[start]] & (digits[end] - digits[start] >= (end - start + 1) // 2)
    row = words.row
    same = np.zeros(len(start), bool)
    same[1:] = row[1:] == row[:-1]
    # 3.14 and 1,000 are one number.
    goes_on = np.zeros(len(start), bool)
    goes_on[1:] = same[1:] & number[1:] & number[:-1] & (start[1:] - end[:-1] == 1)
    goes_on[1:] &= _JOINT[low[np.minimum(end[:-1], len(low) - 1)]]
    lead = np.flatnonzero(~goes_on)
    last = np.append(lead[1:], len(start)) - 1
    start, end, number, row, same = start[lead], end[last], number[lead], row[lead], same[lead]
    words = W.Words(start, end, np.searchsorted(start, offsets))
    value = W.Hasher(low).ranges(start, end)
    number = number | _among(value, _WRITTEN_OUT)
    stops = np.append(0, np.cumsum(_SENTENCE_END[data]))
    inside = same.copy()
    inside[1:] &= stops[start[1:]] == stops[end[:-1]]
    upper = (data[start] >= 0x41) & (data[start] <= 0x5A)
    second = data[np.minimum(start + 1, len(data) - 1)]
    capital = upper & (end - start > 1) & ~((second >= 0x41) & (second <= 0x5A)) & ~number
    name = inside & capital
    unit = np.zeros(len(start), bool)
    unit[1:] = same[1:] & number[:-1]
    unit &= _among(value, _UNIT_HASHES) & ~number
    token = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, value)))
    return Templates(words, token, value, number | unit | name, capital & ~inside)


@dataclass
class Found:
    """Windows of a block. A window without a plain token is hashed by value, since its template says nothing."""

    start: np.ndarray
    length: np.ndarray
    hash: np.ndarray
    by_value: np.ndarray

    def take(self, at: np.ndarray) -> Found:
        return Found(self.start[at], self.length[at], self.hash[at], self.by_value[at])


def _hashes(t: Templates):
    """Functions of (start, end): hashes of template windows and of windows by value, which never meet."""
    by_token, by_value = W.Sequences(t.token), W.Sequences(t.value)
    return by_token.ranges, lambda start, end: W.mix(by_value.ranges(start, end) ^ _BY_VALUE)


def _bridges(t: Templates, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first token, tokens) of each run of ``size`` slots or more, with the plain tokens beside it."""
    row = t.words.row
    edge = np.ones(len(row) + 1, bool)
    edge[1:-1] = (t.slot[1:] != t.slot[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    long = t.slot[start] & (end - start >= size)
    start, end = start[long], end[long]
    r = row[start]
    start, end = np.maximum(start - 1, t.words.first[r]), np.minimum(end + 1, t.words.first[r + 1])
    return start, end - start


def _item_windows(t: Templates, size: int) -> Found:
    """All windows of each item. A row with fewer tokens is one window. A row of up to
    ``size`` tokens is also one without its first token, which may be another name."""
    n = t.words.counts
    at = W.window_starts(t.words, size)
    short, headless = np.flatnonzero((n > 0) & (n < size)), np.flatnonzero((n >= HEADLESS) & (n <= size))
    long, longer = _bridges(t, size)
    start = np.concatenate([at, t.words.first[short], t.words.first[headless] + 1, long])
    length = np.concatenate([np.full(len(at), size), n[short], n[headless] - 1, longer])
    slots = np.append(0, np.cumsum(t.slot))
    by_value = slots[start + length] - slots[start] == length
    template, value = _hashes(t)
    return Found(start, length, np.where(by_value, value(start, start + length), template(start, start + length)), by_value)


def _as_name(t: Templates, size: int) -> tuple[Templates, Found]:
    """The rows with their capitalised first token as a name, and the windows that hold it so."""
    first = t.words.first[:-1][t.words.counts > 0]
    first = first[t.leads[first]]
    token, slot = t.token.copy(), t.slot.copy()
    token[first], slot[first] = _NAME, True
    named = replace(t, token=token, slot=slot)
    f = _item_windows(named, size)
    return named, f.take(np.flatnonzero(np.isin(f.start, first)))


def _text_windows(t: Templates, lengths: list[tuple[int, bool]], keep: np.ndarray | None) -> Found:
    """All windows of these (tokens, by value) with hashes in ``keep``."""
    template, value = _hashes(t)
    found = []
    for n, by_value in lengths:
        at = W.window_starts(t.words, n)
        h = (value if by_value else template)(at, at + n)
        if keep is not None:
            hit = keep[np.minimum(np.searchsorted(keep, h), len(keep) - 1)] == h
            at, h = at[hit], h[hit]
        found.append((at, np.full(len(at), n), h, np.full(len(at), by_value)))
    return Found(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _rows(t: Templates, f: Found, literal: int, batch: pa.RecordBatch, first_row: int, named: bool = False) -> pa.RecordBatch:
    """``named``: the first tokens are taken as names. They count as plain tokens before the window, and rows under HEADLESS tokens must match verbatim."""
    row = np.searchsorted(t.words.first, f.start, "right") - 1
    plain = np.append(0, np.cumsum(~t.slot))
    base, before, until = plain[t.words.first[row]], plain[f.start], plain[f.start + f.length]
    at = pa.array(row + first_row)
    names, values = [], []
    for s, n, whole in zip(f.start.tolist(), f.length.tolist(), f.by_value.tolist(), strict=True):
        here = slice(None) if whole else t.slot[s : s + n]
        names.append((t.token[s : s + n][here] == _NAME).tolist())
        values.append(W.signed(np.ascontiguousarray(t.value[s : s + n][here])).tolist())
    return pa.RecordBatch.from_arrays(
        [
            batch.column("id").take(at),
            batch.column("uid").take(at),
            pa.array((f.start - t.words.first[row]).astype(np.int32)),
            pa.array(f.length.astype(np.int32)),
            pa.array(t.words.counts[row].astype(np.int32)),
            pa.array(W.signed(f.hash)),
            pa.array(f.by_value),
            pa.array((before - base + named).astype(np.int32)),
            pa.array((until - base + named).astype(np.int32)),
            pa.array((until - before >= np.minimum(literal, (f.length + 1) // 2)) & ~(named & (t.words.counts[row] < HEADLESS))),
            pa.array(names, pa.list_(pa.bool_())),
            pa.array(values, pa.list_(pa.int64())),
        ],
        ["id", "uid", "pos", "length", "tokens", "hash", "by_value", "before", "until", "rich", "names", "vals"],
    )


def _windows_of(literal: int, windows, as_name=None):
    """Window rows of the texts: where it stands, hash, plain tokens of the text before it and up to its end, slots' values."""

    def run(batches):
        for batch in batches:
            for b in W.blocks(batch.column("text")):
                t = templates(b.data, b.offsets)
                if len(t.token):
                    yield _rows(t, windows(t), literal, batch, b.first_row)
                    if as_name:
                        yield _rows(*as_name(t), literal, batch, b.first_row, named=True)

    return run


_ROWS = "id long, uid long, pos int, length int, tokens int, hash long, by_value boolean, before int, until int, rich boolean, names array<boolean>, vals array<long>"


def _filter(spark: SparkSession, items: DataFrame) -> tuple[np.ndarray | None, list[tuple[int, bool]]]:
    """The windows' hashes where they are few enough to travel, and the (tokens, by value) that occur."""
    lengths = sorted((r[0], r[1]) for r in items.select("length", "by_value").distinct().collect())
    hashes = items.select("hash").distinct()
    if hashes.count() > FILTER_WINDOWS:
        return None, lengths
    return np.sort(hashes.toArrow().column("hash").to_numpy().view(np.uint64)), lengths


def _alignments(joined: DataFrame, run_tokens: int, share: float) -> DataFrame:
    """The alignments of ``joined`` windows that are long enough and fill their slots consistently.

    One value of the item never stands for two of the text, and two names of the item
    never for one; numbers may coincide. Where a text calls things by other names, the
    plain tokens must be NAMES_EVERY times as many as the names: else, as where nouns
    have capitals, it is another text of the same form.
    """
    where = ["doc_id", "uid", "item_id", "item", "diagonal"]
    slots = joined.where(F.size("item_vals") > 0).select(*where, F.explode(F.arrays_zip("item_vals", "doc_vals", "names")).alias("s"))
    same = F.col("s.doc_vals") == F.col("s.item_vals")
    slots = slots.groupBy(*where, "s.item_vals").agg(F.min("s.doc_vals").alias("lo"), F.max("s.doc_vals").alias("hi"), F.min(same).alias("same"), F.min(same | ~F.col("s.names")).alias("same_names"))
    names = joined.where(F.exists("names", lambda x: x)).select(*where, F.explode(F.arrays_zip("item_vals", "doc_vals", "names")).alias("s")).where("s.names")
    merged = names.groupBy(*where, "s.doc_vals").agg((F.min("s.item_vals") != F.max("s.item_vals")).alias("merged")).groupBy(*where).agg(F.max("merged").alias("merged"))
    slots = slots.groupBy(*where).agg(F.max(F.col("lo") != F.col("hi")).alias("clash"), F.min("same").alias("same"), F.min("same_names").alias("same_names"), F.count_if(~F.col("same_names")).alias("renamed"))
    # Runs along an alignment: windows that overlap or touch.
    along = Window.partitionBy(*where).orderBy("pos")
    seen = joined.groupBy(*where, "pos").agg(F.max(F.col("pos") + F.col("length")).alias("end"), F.max("tokens").alias("tokens"), F.min("before").alias("before"), F.max("until").alias("until"))
    reach = F.coalesce(F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    seen = seen.withColumn("new", (F.col("pos") > reach).cast("int")).withColumn("run", F.sum("new").over(along))
    runs = seen.groupBy(*where, "run").agg(F.min("pos").alias("from"), F.max("end").alias("to"), F.max("tokens").alias("tokens"), (F.max("until") - F.min("before")).alias("plain"))
    length = F.col("to") - F.col("from")
    lines = runs.groupBy(*where).agg(F.max(length).alias("run_tokens"), F.sum(length).alias("covered"), F.min("from").alias("from"), F.max("tokens").alias("tokens"), F.sum("plain").alias("plain"))
    on = [F.col(f"l.{c}") == F.col(f"s.{c}") for c in ("uid", "item", "diagonal")]
    also = [F.col(f"l.{c}") == F.col(f"m.{c}") for c in ("uid", "item", "diagonal")]
    lines = lines.alias("l").join(slots.alias("s"), on, "left").join(merged.alias("m"), also, "left").where(~F.coalesce("s.clash", F.lit(False)) & ~F.coalesce("m.merged", F.lit(False)))
    lines = lines.where(F.coalesce("s.renamed", F.lit(0)) * NAMES_EVERY <= F.col("l.plain"))
    yes = F.lit(True)
    lines = lines.select("l.*", F.coalesce("s.same", yes).alias("verbatim"), F.coalesce("s.same_names", yes).alias("same_names"), (F.col("l.covered") / F.col("l.tokens")).alias("share"))
    return lines.where((F.col("run_tokens") >= run_tokens) | (F.col("share") >= share))


def _leaks(docs: DataFrame, benchmark: DataFrame, window: int, literal: int, run_tokens: int, share: float) -> DataFrame:
    """The alignments of one row of ``docs`` (doc_id, text, uid) and one of ``benchmark`` that make it leak: doc_id, uid, item_id, item, diagonal, from, run_tokens, share, verbatim."""
    spark = docs.sparkSession
    own = benchmark.select(F.col("item_id").cast("long").alias("id"), "text", F.monotonically_increasing_id().alias("uid"))
    items = cut(own.mapInArrow(_windows_of(literal, lambda t: _item_windows(t, window), lambda t: _as_name(t, window)), _ROWS))
    keep, lengths = _filter(spark, items)
    if not lengths:
        lengths = [(window, False)]
    if keep is not None and not len(keep):
        keep = np.zeros(1, np.uint64)
    hits = docs.select(F.col("doc_id").cast("long").alias("id"), "text", "uid").mapInArrow(_windows_of(literal, lambda t: _text_windows(t, lengths, keep)), _ROWS)
    hits = hits.select(F.col("id").alias("doc_id"), "uid", F.col("pos").alias("doc_pos"), "hash", "length", F.col("vals").alias("doc_vals"))
    item = items.select(F.col("id").alias("item_id"), F.col("uid").alias("item"), "pos", "tokens", "hash", "length", "before", "until", "rich", "names", F.col("vals").alias("item_vals"))
    joined = cut(hits.join(item, ["hash", "length"]).withColumn("diagonal", F.col("doc_pos") - F.col("pos")))
    whole, plain = F.col("covered") == F.col("tokens"), F.col("plain")
    sure = F.col("verbatim") | (plain >= window) | (whole & ((plain >= literal) | (F.col("same_names") & (plain > 0) & (F.col("tokens") >= HEADLESS))))
    return _alignments(joined, run_tokens, share).where(sure).unionAll(_alignments(joined.where("rich"), run_tokens, share))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literal: int = LITERAL, run_tokens: int = RUN_TOKENS, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, first_token, run_tokens, share, verbatim), one row for each benchmark item that a document holds.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. An item leaks if,
    along one alignment with consistent slots, a run of ``run_tokens`` of its
    template tokens or ``share`` of them (at least one window) stands in the text.
    An item's capitalised first token matches as a word and as a name, since it is
    one where the item stands within a sentence. A name is a capitalised word: texts
    that write names in small letters are found only with the item's own. All windows count, however many of
    their tokens are placeholders. So that no clean text is taken for a copy, one of
    these must hold too: the alignment's rich windows alone are that long; all slots
    hold the item's own values; ``window`` of its tokens are plain; the whole item
    stands there with ``literal`` plain tokens, or with one, its own names and
    HEADLESS tokens (numbers and units may differ).
    run_tokens and share are those of the best alignment, verbatim tells whether all
    slots hold the item's own values. Null and empty texts hold nothing, an empty table
    gives no rows. Each row is searched by itself, against each row of the benchmark by
    itself; the best alignment of the rows with one doc_id and one item_id counts, so
    repeated rows change nothing; a null id stays null. An empty benchmark gives no
    rows. Up to FILTER_WINDOWS benchmark windows are sent to the tasks, which then
    emit only windows that can join; beyond that all windows take part in the join.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("uid"))
    good = _leaks(own, benchmark, window, literal, run_tokens, share)
    best = F.max(F.struct(F.col("share"), F.col("run_tokens"), F.col("verbatim"), (-(F.col("diagonal") + F.col("from"))).alias("at"))).alias("b")
    return good.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.at")).cast("int").alias("first_token"), F.col("b.run_tokens").cast("int").alias("run_tokens"), F.round("b.share", 6).alias("share"), F.col("b.verbatim").alias("verbatim")
    )


def drop_leaking(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literal: int = LITERAL, run_tokens: int = RUN_TOKENS, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` whose document holds no benchmark item, with all their columns.

    Rows with one doc_id are one document: if one of them leaks, all go. A row with a
    null id is a document by itself. Null and empty texts stay. An empty benchmark
    drops nothing.
    """
    uid = free_name(docs, "uid")
    full = numbered(docs, uid)
    good = _leaks(full.select("doc_id", "text", F.col(uid).alias("uid")), benchmark, window, literal, run_tokens, share)
    by_id = good.where("doc_id is not null").select(F.col("doc_id").alias("leaking")).distinct()
    by_row = good.where("doc_id is null").select(F.col("uid").alias("leaking")).distinct()
    leaking = cut(by_id.withColumn("whole", F.lit(True)).unionAll(by_row.withColumn("whole", F.lit(False))))
    whole, key = full["doc_id"].isNotNull(), F.coalesce(full["doc_id"].cast("long"), full[uid])
    return full.join(leaking, (whole == leaking["whole"]) & (key == leaking["leaking"]), "left_anti").drop(uid)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_leaks(docs, benchmark)
