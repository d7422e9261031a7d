"""URL filter: rules first, then words of hosts and paths (operator 12).

Names such as ``cheappills`` are split into words by Viterbi over unigram counts of
the corpus: the substrings of each distinct name are joined to the counts, so no
task needs the whole vocabulary. A multinomial naive Bayes model over the words of
host and path, trained on all urls, then judges those that no rule fits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, numbered

#: (verdict, host, beginning of the path), fixed values.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Words that mark a url as one to learn blocking from, where no labels are given.
SEEDS = tuple(
    "ads adserver adult bets betting bingo cams casino crack dating escort gambling jackpot keygen lottery malware payday "
    "phishing pills poker porn roulette sex slots spam torrent viagra warez xxx".split()
)
#: letters of a word that can be known; longer runs are split into such words or stay unknown
LONGEST = 24
THRESHOLD = 0.5
SMOOTHING = 1.0
#: An unknown word of k letters has the chance UNKNOWN / (all words * 10 ** k).
UNKNOWN = 10.0


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path): what stands between the first :// and /, ?, # or the end, A-Z lower-cased, and from there up to ?, # or the end."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _fitting(hosts: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, rules): the rules for each host or a domain above it, the longest first; of equal ones those that block."""
    kept = [(v, h.lower(), p) for v, h, p in rules]
    table = hosts.sparkSession.createDataFrame([(h, v, p, h + p) for v, h, p in kept], "domain string, verdict string, beginning string, rule string")
    most = max((h.count(".") + 1 for _, h, _ in kept), default=0)
    labels = F.split("host", r"\.")
    # Domains with more labels than any rule has need no look.
    domains = F.expr(f"transform(sequence(1, least(size(labels), {most})), k -> array_join(slice(labels, -k, k), '.'))") if most else F.array().cast("array<string>")
    at = hosts.select("host", labels.alias("labels")).select("host", F.explode(domains).alias("domain")).join(table, "domain")
    by_length = F.sort_array(F.collect_list(F.struct(F.length("rule").alias("length"), "verdict", "rule", "beginning")), asc=False)
    return at.groupBy("host").agg(by_length.alias("rules"))


def word_counts(pages: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(word, n) of the words a-z, two to ``longest`` letters, that pages' texts and urls' hosts and paths hold, apart from markup."""
    text = F.regexp_replace(F.lower("html"), r"<[^>]*>", " ")
    host, path = parse(F.col("url"))
    words = F.concat(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}]+"), F.split(F.concat_ws(" ", host, F.lower(path)), r"[^a-z]+"))
    each = pages.select(F.explode(words).alias("word"))
    return each.where(F.col("word").rlike(rf"^[a-z]{{2,{longest}}}$")).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(name: str, known: dict[tuple[int, int], int], total: int, longest: int = LONGEST) -> list[str]:
    """The words of ``name`` that are likeliest together; known: counts by (start, end). Of equals, that with the longer last word."""
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        cost, from_ = math.inf, 0
        for start in range(max(0, end - longest), end):
            n = known.get((start, end), 0)
            chance = math.log(n / total) if n else math.log(UNKNOWN / total) - (end - start) * math.log(10)
            if best[start] - chance < cost:
                cost, from_ = best[start] - chance, start
        best.append(cost)
        back.append(from_)
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def segment(names: DataFrame, counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(name, words) of each distinct ``names`` (name, letters a-z), by ``counts`` (word, n)."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    starts = F.expr(f"flatten(transform(sequence(0, length(name) - 2), s -> transform(sequence(2, least({longest}, length(name) - s)), k -> struct(s, s + k AS e, substring(name, s + 1, k) AS word))))")
    spans = names.where(F.length("name") > 1).select("name", F.explode(starts).alias("at")).select("name", "at.*")
    known = spans.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("s", "e", "n")).alias("known"))

    def run(batches):
        for batch in batches:
            words = [viterbi(name, {(x["s"], x["e"]): x["n"] for x in spans or []}, total, longest) for name, spans in zip(batch.column("name").to_pylist(), batch.column("known").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    return names.join(known, "name", "left").select("name", "known").mapInArrow(run, "name string, words array<string>")


def _host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words): runs of letters segmented, runs of digits as 0."""
    runs = cut(hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit(r"[a-z]+|[0-9]+"), 0)).alias("pos", "name")))
    names = cut(runs.where("name >= 'a'").select("name").distinct())
    segments = cut(segment(names, counts))
    each = runs.join(segments, "name", "left").select("host", F.struct("pos", F.coalesce("words", F.array(F.lit("0"))).alias("words")).alias("x"))
    return each.groupBy("host").agg(F.flatten(F.sort_array(F.collect_list("x"))["words"]).alias("words"))


def weigh(rows: DataFrame, smoothing: float = SMOOTHING) -> tuple[DataFrame, float]:
    """((token, weight), prior) of multinomial naive Bayes from ``rows`` (tokens, label 1 or 0): log odds for label 1, Laplace-smoothed.

    A token that the rows don't hold has no weight.
    """
    tokens = rows.select("label", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    tokens = cut(tokens)
    sums = tokens.agg(F.sum("bad"), F.sum("good"), F.count("*")).first()
    bad, good, kinds = (x or 0 for x in sums)
    n, n_bad = rows.agg(F.count("label"), F.sum("label")).first()
    odds = F.log((F.col("bad") + smoothing) / (bad + smoothing * kinds)) - F.log((F.col("good") + smoothing) / (good + smoothing * kinds))
    return cut(tokens.select("token", odds.alias("weight"))), math.log(((n_bad or 0) + smoothing) / (n - (n_bad or 0) + smoothing))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, seeds: Sequence[str] = SEEDS, labels: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, score of each row of ``pages`` (page_id, url, html).

    A rule (verdict, host, beginning of the path) fits its host and all domains below
    it where the path begins so. The longest that fits, host and path together, gives
    rule and verdict; of equals one that blocks. Where none fits, rule is null and the
    verdict is ``block`` from a score of ``threshold`` on. score is the model's chance
    of blocking, for all rows.

    ``labels`` (page_id, label: 1 is to be blocked, 0 is not) are what the model learns
    from; without them all urls are, and those with a word of ``seeds`` in host or path
    count as 1. Rules are no part of the training: they speak of sections of sites, not
    of words. Counts for segmentation come from all rows' texts and urls.

    A null url, or one without ://, has an empty host and path and scores the prior.
    Repeated rows, and rows with null ids, are judged each; an empty table gives no rows.
    Rules are a list on the driver; a host takes all rules of its domains along.
    """
    pages = pages.select("page_id", "url", "html")
    counts = cut(word_counts(pages).union(pages.sparkSession.createDataFrame([(w, 1) for w in seeds], "word string, n long")).groupBy("word").agg(F.sum("n").alias("n")))
    host, path = parse(F.col("url"))
    rows = numbered(pages.select("page_id", host.alias("host"), path.alias("path")))
    hosts = cut(rows.select("host").distinct())
    known = cut(hosts.join(_host_words(hosts, counts), "host", "left").join(_fitting(hosts, rules), "host", "left"))

    of = lambda words, kind: F.transform(words, lambda w: F.concat(F.lit(f"{kind} "), w))
    in_path = F.transform(F.regexp_extract_all(F.lower("path"), F.lit(r"\p{L}+|[0-9]+"), 0), lambda w: F.when(w.rlike("^[0-9]"), "0").otherwise(w))
    none = F.array().cast("array<string>")
    words = rows.join(known, "host", "left").select("uid", "page_id", "host", "path", "rules", F.coalesce("words", none).alias("in_host"), in_path.alias("in_path"))
    rule = F.filter("rules", lambda r: F.startswith("path", r["beginning"]))
    rows = words.select(
        "uid", "page_id", "host", "path", F.get(rule, F.lit(0)).alias("rule"), F.concat(of("in_host", "host"), of("in_path", "path")).alias("tokens"),
        F.arrays_overlap(F.concat("in_host", "in_path"), F.lit(list(seeds)) if seeds else none).cast("int").alias("label"),
    )
    rows = cut(rows)
    if labels is None:
        learned = rows
    else:
        asked = labels.where("label is not null and page_id is not null").groupBy("page_id").agg(F.max("label").cast("int").alias("label"))
        learned = rows.drop("label").join(asked, "page_id")
    weights, prior = weigh(learned)
    scores = rows.select("uid", F.explode("tokens").alias("token")).join(weights, "token").groupBy("uid").agg(F.sum("weight").alias("odds"))
    score = 1 / (1 + F.exp(-(F.coalesce("odds", F.lit(0.0)) + prior)))
    return rows.join(scores, "uid", "left").select(
        "page_id", "host", "path", F.col("rule.rule").alias("rule"), F.coalesce("rule.verdict", F.when(score >= threshold, "block").otherwise("allow")).alias("verdict"), score.alias("score")
    )


def digest(pages: DataFrame) -> DataFrame:
    return judge(pages)
