"""Plain Python versions of operators, for small inputs."""

import collections
import hashlib
import re

from flowjobs.llm import decontam

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def template(text):
    """[(token, value, is slot)] of a text."""
    raw = (text or "").encode()
    low = raw.translate(LOW)
    spans = [m.span() for m in WORD.finditer(low)]
    number = lambda s, e: chr(low[s]).isdigit() and sum(48 <= b < 58 for b in low[s:e]) * 2 >= e - s
    written = {w.encode() for w in decontam.NUMBER_WORDS}
    joined = []
    for s, e in spans:
        if joined and joined[-1][2] and number(s, e) and s - joined[-1][1] == 1 and low[s - 1 : s] in (b".", b","):
            joined[-1] = (joined[-1][0], e, True)
        else:
            joined.append((s, e, number(s, e)))
    joined = [(s, e, num or low[s:e] in written) for s, e, num in joined]
    out = []
    for i, (s, e, num) in enumerate(joined):
        value = low[s:e]
        inside = i > 0 and not re.search(rb"[.!?:;\n\r\"]", raw[joined[i - 1][1] : s])
        capital = lambda b: 65 <= b <= 90
        if num:
            out.append(("<number>", value, True))
        elif i > 0 and joined[i - 1][2] and value.decode() in decontam.UNITS:
            out.append(("<unit>", value, True))
        elif inside and e - s > 1 and capital(raw[s]) and not capital(raw[s + 1]):
            out.append(("<name>", value, True))
        else:
            out.append((value, value, False))
    return out


def item_windows(t, size=decontam.WINDOW, literal=decontam.LITERAL):
    n = len(t)
    spans = [(i, size) for i in range(n - size + 1)] if n >= size else ([(0, n)] if n else []) + ([(1, n - 1)] if n >= decontam.HEADLESS else [])
    return [(i, k) for i, k in spans if sum(not x[2] for x in t[i : i + k]) >= min(literal, (k + 1) // 2)]


def leaks(docs, items, run_tokens=decontam.RUN_TOKENS, share=decontam.SHARE):
    """{(doc_id, item_id): (run tokens, share)} of [(id, text)]."""
    out = {}
    for doc, text in docs:
        d = template(text)
        tokens = [x[0] for x in d]
        for item, item_text in items:
            t = template(item_text)
            lines = collections.defaultdict(set)
            for i, k in item_windows(t):
                window = [x[0] for x in t[i : i + k]]
                for p in range(len(tokens) - k + 1):
                    if tokens[p : p + k] == window:
                        lines[p - i].add((i, k))
            for diagonal, found in lines.items():
                values, clash, names = {}, False, {}
                for i, k in found:
                    for j in range(i, i + k):
                        if t[j][2] and values.setdefault(t[j][1], d[j + diagonal][1]) != d[j + diagonal][1]:
                            clash = True
                        if t[j][0] == "<name>" and names.setdefault(d[j + diagonal][1], t[j][1]) != t[j][1]:
                            clash = True
                if clash:
                    continue
                runs = []
                for i, k in sorted(found):
                    if runs and i <= runs[-1][1]:
                        runs[-1] = (runs[-1][0], max(runs[-1][1], i + k))
                    else:
                        runs.append((i, i + k))
                run, covered = max(b - a for a, b in runs), sum(b - a for a, b in runs)
                renamed = {x for y, x in names.items() if y != x}
                if decontam.NAMES_EVERY * len(renamed) > sum(not t[j][2] for a, b in runs for j in range(a, b)):
                    continue
                if run >= run_tokens or covered / len(t) >= share:
                    out[doc, item] = max(out.get((doc, item), (0, 0)), (round(covered / len(t), 6), run))
    return out


def dedup_lines(docs):
    key = lambda x: x.strip(" \t\n\x0b\f\r").encode().translate(LOW).decode()
    holders = collections.defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(i)
    gone = lambda i, k: len(k) >= 10 and len(holders[k]) > 1 and min(holders[k]) != i
    return [(i, "\n".join(x for x in (t or "").split("\n") if not gone(i, key(x)))) for i, t in docs]


def keep_one(docs, percent=85):
    sets = {}
    for i, t in docs:
        w = t.encode().translate(LOW).split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    where = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j, both in collections.Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, t) for i, t in docs if find(i) == i]


def mix(docs, weights=(1.0, 2.0, 3.0), seed=17):
    """[(doc_id, text)] with copies, of [(doc_id, text, source)]."""
    size = {i: len(t.encode().split()) for i, t, _ in docs}
    sources = sorted({s for _, _, s in docs})
    words = {s: sum(size[i] for i, _, x in docs if x == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), float(sum(words.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * words[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3.0 * words[s] for s in full}
        left -= sum(3.0 * words[s] for s in full)
        open_ -= full
    out = []
    for s in sources:
        rate = target[s] / words[s] if words[s] else 0
        unit = int(hashlib.md5(f"{seed}:{s}".encode()).hexdigest()[:8], 16) / 2**32
        for k, (_, i, t) in enumerate(sorted((size[i], i, t) for i, t, x in docs if x == s)):
            out += [(i, t)] * (int((k + 1) * rate + unit) - int(k * rate + unit))
    return out
