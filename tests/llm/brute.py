"""Plain Python versions of the contracts, on lists of rows."""

from __future__ import annotations

import collections
import hashlib
import re

WHITE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b: bytes | str) -> str:
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


def line_key(line: str) -> str:
    return line.strip(WHITE).translate(LOWER)


def line_dedup(docs, min_chars=10):
    where = collections.defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(line_key(x)) >= min_chars:
                where[line_key(x)].add(d)
    out = {}
    for d, t in docs:
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(line_key(x)) < min_chars or len(where[line_key(x)]) < 2 or min(where[line_key(x)]) == d]
        out[d] = (len(ls), len(ls) - len(kept), sha("\n".join(kept)))
    return out


def quality_base(t):
    t = t or ""
    w = WORD.findall(t)
    ls = [x for x in t.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in ls:
        dup += x in seen
        seen.add(x)
    grams = collections.defaultdict(list)
    for i in range(len(w) - 7):
        grams[tuple(w[i:i + 8])].append(i)
    cover = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover), n < 20 or 100 * len(cover) > 30 * n)


def secret_spans(t):
    t = t or ""
    kinds = [("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
             ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    out = []
    for k, (name, p, ok) in enumerate(kinds):
        out += [(m.start(), k, name, m.end()) for m in re.finditer(p, t, re.ASCII) if ok(m)]
    out.sort()
    count = collections.Counter(x[2] for x in out)
    return (count["assign"], count["access"], count["hex"], sha(",".join(f"{n}:{s}:{e}" for s, _, n, e in out)))


def shingles(t, k=4):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(n, links):
    """Smallest member of each one's component; members are 0 .. n - 1."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def jaccard(docs, pct=85, k=4):
    docs = sorted(docs)
    sets = [shingles(t, k) for _, t in docs]
    post = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            post[x].append(i)
    links = []
    for i, s in enumerate(sets):
        c = collections.Counter(j for x in s for j in post[x] if j < i)
        links += [(i, j) for j, o in c.items() if 100 * o >= pct * (len(s) + len(sets[j]) - o)]
    root = components(len(docs), links)
    return {d: (len(sets[i]), docs[root[i]][0]) for i, (d, _) in enumerate(docs)}


def repeats(docs, size=400):
    count = collections.Counter()
    data = {d: (t or "").encode() for d, t in docs}
    for b in data.values():
        for i in range(len(b) - size + 1):
            count[b[i:i + size]] += 1
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i:i + size]] > 1:
                gone[i:i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(kept))
    return out


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def alnum(t):
    return ALNUM.findall((t or "").translate(LOWER))


def ranked(docs, items, top=50):
    """(item, rank, doc, score) rows; docs and items are lists of (id, text)."""
    import math

    each = [(d, collections.Counter(alnum(t))) for d, t in docs]
    each = [(d, c) for d, c in each if c]
    n_docs, n_terms = len(each), sum(sum(c.values()) for _, c in each)
    df = collections.Counter(t for _, c in each for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for d, c in each:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(alnum(text)) if t in c)
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(found)[:top])]
    return out


def importance(docs, target, orders=1, buckets=10_000, share=10, least=20, seed=2024):
    """doc -> (features, weight, score, rank)."""
    import math
    import zlib

    def features(t):
        w = alnum(t)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, orders + 1) for i in range(len(w) - n + 1)]

    own = [(d, t, features(t)) for d, t in docs]
    s, t = collections.Counter(b for *_, f in own for b in f), collections.Counter(b for x in target for b in features(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (s_all + buckets)) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for d, text, f in own:
        h = int(sha(f"{seed}:{d}")[:8], 16)
        rows.append((d, len(f), sum(gain[b] for b in f), len(alnum(text))))
        rows[-1] += (rows[-1][2] + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))),)
    drawn = sorted((r for r in rows if r[3] >= least), key=lambda r: (-r[4], r[0]))
    rank = {r[0]: i + 1 for i, r in enumerate(drawn[:share * len(drawn) // 100])}
    return {r[0]: (r[1], r[2], r[4], rank.get(r[0])) for r in rows}


def linked_vectors(rows, limit=0.93):
    """id -> (links, component); rows are (id, list, label)."""
    import numpy as np

    out, groups = {}, collections.defaultdict(list)
    for i, v, label in rows:
        out[i] = (0, i)
        if label is not None and v and not any(x is None or not np.isfinite(x) for x in v) and any(v):
            groups[label, len(v)].append((i, v))
    for g in groups.values():
        x = np.array([v for _, v in g], float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        near = x @ x.T >= limit
        np.fill_diagonal(near, False)
        root = components(len(g), np.argwhere(near).tolist())
        least = {}
        for k, r in enumerate(root):
            least[r] = min(least.get(r, g[k][0]), g[k][0])
        for k, (i, _) in enumerate(g):
            out[i] = (int(near[k].sum()), least[root[k]])
    return out
