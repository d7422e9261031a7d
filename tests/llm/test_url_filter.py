"""URL filter against plain Python, rules against a list of cases."""

import collections
import math
import re

import pytest

from flowjobs.llm import url_filter
from flowjobs.llm.tables import read

SF = "/root/testdata/sf0.001"


def parse(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path, rules=url_filter.RULES):
    fit = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def best_split(name, counts, total):
    """All splits of a short name."""
    def cost(w):
        n = counts.get(w, 0) if len(w) > 1 else 0
        return -math.log(n / total) if n else -(math.log(10 / total) - len(w) * math.log(10))

    splits = [[name[i:j] for i, j in zip([0, *c], [*c, len(name)], strict=True)] for c in ([k for k in range(1, len(name)) if m >> k & 1] for m in range(0, 1 << len(name), 2))]
    return min(splits, key=lambda s: sum(map(cost, s)))


def brute(rows):
    """{row number: (host, path, rule, verdict, score)}, with the module's own Viterbi on counts made here."""
    counts = collections.Counter(url_filter.SEEDS)
    for _, url, html in rows:
        host, path = parse(url)
        text = re.sub(r"<[^>]*>", " ", (html or "").lower())
        words = re.split(r"[\W\d_]+", text) + re.split(r"[^a-z]+", f"{host} {path.lower()}")
        counts.update(w for w in words if re.fullmatch(r"[a-z]{2,24}", w))
    total = sum(counts.values())
    tokens, labels = [], []
    for _, url, _ in rows:
        host, path = parse(url)
        in_host = []
        for run in re.findall(r"[a-z]+|[0-9]+", host):
            in_host += ["0"] if run[0].isdigit() else url_filter.viterbi(run, {(i, j): counts[run[i:j]] for i in range(len(run)) for j in range(i + 2, min(len(run), i + 24) + 1) if run[i:j] in counts}, total)
        in_path = ["0" if w[0] in "0123456789" else w for w in re.findall(r"[^\W\d_]+|[0-9]+", path.lower())]
        tokens.append([f"host {w}" for w in in_host] + [f"path {w}" for w in in_path])
        labels.append(int(bool(set(in_host + in_path) & set(url_filter.SEEDS))))
    by = [collections.Counter(w for t, y in zip(tokens, labels, strict=True) if y == k for w in t) for k in (0, 1)]
    kinds = len(set(by[0]) | set(by[1]))
    weight = {w: math.log((by[1][w] + 1) / (sum(by[1].values()) + kinds)) - math.log((by[0][w] + 1) / (sum(by[0].values()) + kinds)) for w in set(by[0]) | set(by[1])}
    out = []
    for (i, url, _), t in zip(rows, tokens, strict=True):
        host, path = parse(url)
        verdict, rule = ruled(host, path)
        odds = sum(weight[w] for w in t) + math.log((sum(labels) + 1) / (len(rows) - sum(labels) + 1))
        out.append((i, host, path, rule, verdict or ("block" if odds >= 0 else "allow"), round(1 / (1 + math.exp(min(-odds, 500))), 6)))
    return collections.Counter(out)


ODD = [
    (1, None, None), (1, None, None), (2, "", "<p>x"), (3, "no scheme", "text"), (None, "http://a.b/c", None), (4, "HTTP://WWW.Example.ORG/es/", "<b>A<i>b"), (5, "http://x.org", ""), (6, "http://x.org/", ""),
    (7, "http://com/de/", ""), (8, "http://notcom/de/", ""), (9, "http://a.com/DE/", ""), (10, "x://example.org/en/12?/es/", ""), (11, "http://example.org/en/2", ""), (12, "http://u:p@h.com:80/fr/#a", ""),
    (13, "a://b://c/d", ""), (14, "http://", ""), (15, "http:///de/", ""), (16, "http://?q", ""), (17, "http://" + "ab" * 2000 + ".net/" + "z" * 3000, ""), (18, "http://" + "a." * 500 + "org/", "word " * 20_000), (19, "http://münchen.net/straße", "é"),
    (20, "http://cheappills.example.net/x", ""), (21, "http://freebets24.example.net/", ""), (21, "http://freebets24.example.net/", ""),
]


def made(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("host", "path", "rule", "rules", "uid", "token", "words", "label", "n", "name", "word"):
        df = df.selectExpr("*", f"'clash' as {c}")
    return df


def test_matches_brute_force(spark):
    rows = [tuple(r) for r in read(spark, SF, "pages").select("page_id", "url", "html").collect()] + ODD
    got = collections.Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], round(r["score"], 6)) for r in url_filter.judge(made(spark, rows)).collect())
    assert got == brute(rows)


def test_bad_hosts_are_blocked_and_others_are_not(spark):
    pages = read(spark, "/root/testdata/sf0.01", "pages")
    got = url_filter.judge(pages).where("rule is null").collect()
    bad = {"adult", "casino", "pills", "bets", "spam", "ads"}
    for r in got:
        assert (r["verdict"] == "block") == bool(bad & set(re.split(r"[^a-z]+", r["host"]))), r


def test_concatenated_names(spark):
    counts = {"cheap": 40, "pills": 30, "free": 50, "bets": 20, "the": 900, "therapist": 9, "rapist": 2, "ills": 3, "news": 70, "a": 5}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    names = ["cheappills", "freebets", "thetherapist", "qqnews", "z", "newsnewsnews"]
    got = {r["name"]: r["words"] for r in url_filter.segment(spark.createDataFrame([(n,) for n in names], "name string"), table).collect()}
    assert got["cheappills"] == ["cheap", "pills"] and got["freebets"] == ["free", "bets"] and got["thetherapist"] == ["the", "therapist"] and got["z"] == ["z"]
    for n in names:
        assert got[n] == best_split(n, counts, sum(counts.values()))


def test_model_learns_words_beside_the_seeds(spark):
    rows = [(i, f"http://megawin{i % 7}-casino.net/", None) for i in range(40)] + [(100 + i, f"http://garden{i % 7}-flowers.net/", None) for i in range(60)] + [(500, "http://megawin.net/", None), (501, "http://flowers.net/", None)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[500] == "block" and got[501] == "allow"


def test_labels_and_own_rules(spark):
    rows = [(i, f"http://{'alpha' if i % 2 else 'beta'}.net/{i}", None) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 0), (None, 1), (25, None)], "page_id long, label int")
    got = url_filter.judge(pages, rules=[("allow", "ALPHA.net", "/29"), ("block", "alpha.net", "/29"), ("allow", "beta.net", "/2"), ("block", "net", "/28")], labels=labels).collect()
    for r in got:
        i = r["page_id"]
        want = {29: "block", 28: "allow"}.get(i, "allow" if i == 2 or 20 <= i < 28 and i % 2 == 0 else "block" if i % 2 else "allow")
        assert r["verdict"] == want, r


@pytest.mark.parametrize("rules", [url_filter.RULES, ()])
def test_empty_tables(spark, rules):
    empty = made(spark, ODD).limit(0)
    assert url_filter.judge(empty, rules=rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(made(spark, ODD[:3]), rules=rules, seeds=()).collect()} == {"allow"}
