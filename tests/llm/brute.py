"""Plain Python versions of the operators' contracts."""

import hashlib
import re

import xxhash

WS = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def decontamination(docs, items):
    wins = {}
    for i, t in items:
        w = ALNUM.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i if i is None else str(i))
    sizes = {len(k) for k in wins}
    out = {}
    for d, t in docs:
        w, hit, ids = ALNUM.findall(low(t)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := wins.get(tuple(w[i : i + n])):
                    ids |= found
                    hit |= set(range(i, i + n))
        out[d] = (len(w), len(hit), len(ids), sha(",".join(sorted(i for i in ids if i is not None))), bool(hit))
    return out


def simhash(docs):
    fps = {}
    for d, t in docs:
        w = WS.findall(low(t))
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
        fps[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(fps)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (f"{fps[d]:016x}", find(d)) for d in ids}


def quality_base(docs):
    out = {}
    for d, t in docs:
        t = t or ""
        w = WS.findall(t)
        wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen, twice = set(), set()
        for x in wins:
            (twice if x in seen else seen).add(x)
        rep = {i + k for i, x in enumerate(wins) if x in twice for k in range(3)}
        lines = [x for x in t.split("\n") if WS.search(x)]
        out[d] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w))
    return out


def line_dedup(docs):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(d)
    top = {k: max(v) for k, v in held.items() if len(v) >= 5}
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or top.get(key(x), d) == d]
        out[d] = (len(lines), len(lines) - len(stay), sha("\n".join(stay)))
    return out
