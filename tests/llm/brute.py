"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")
BENCH_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


class Union:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def near_duplicates(docs, percent=80):
    """{id: (set size, component)}"""
    sets = {i: shingles(t) for i, t in docs.items()}
    union, ids = Union(sets), sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                union.link(a, b)
    return {i: (len(sets[i]), union.root(i)) for i in ids}


def substrings(docs, window=20):
    """{id: (words, removed, kept)}"""
    seen, out = set(), {}
    for i in sorted(docs):
        w, gone = WORD.findall(docs[i] or ""), set()
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            if key in seen:
                gone |= set(range(j, j + window))
            seen.add(key)
        out[i] = (len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone))
    return out


def decontaminate(docs, items, window=10):
    """{id: (words, hit, items)}"""
    windows = {}
    for i, t in items:
        w = BENCH_WORD.findall((t or "").translate(LOWER))
        size = min(window, len(w))
        for j in range(len(w) - size + 1) if size else ():
            windows.setdefault(tuple(w[j : j + size]), set()).add(str(i))
    out = {}
    for i, t in docs.items():
        w, hit, found = BENCH_WORD.findall((t or "").translate(LOWER)), set(), set()
        for key, names in windows.items():
            for j in range(len(w) - len(key) + 1):
                if tuple(w[j : j + len(key)]) == key:
                    hit |= set(range(j, j + len(key)))
                    found |= names
        out[i] = (len(w), len(hit), sorted(found))
    return out


def spans(text, rules):
    out = []
    for nth, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), nth, m.end(), r.kind))
    return ",".join(f"{k}:{a}:{b}" for a, n, b, k in sorted(out))


def line_duplicates(docs, k=7, percent=80):
    """{id: removed line numbers}"""
    lines = [(i, n, x.strip(" \t\x0b\x0c\r")) for i in sorted(docs) for n, x in enumerate((docs[i] or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    kinds = sorted({x[2] for x in lines})
    sets = {x: {x[j : j + k] for j in range(len(x) - k + 1)} or {x} for x in kinds}
    union = Union(kinds)
    for n, a in enumerate(kinds):
        for b in kinds[:n]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                union.link(a, b)
    seen, out = set(), {i: [] for i in docs}
    for i, n, x in lines:
        root = union.root(x)
        if root in seen:
            out[i].append(n)
        seen.add(root)
    return out


def targets(sizes):
    """Each source's target by repeated resharing. sizes: {source or None: words}"""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left, weights = total - sum(capped.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / weights for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}
