"""Operators 11 to 13 against plain rules, on whole small tables and on planted cases."""

import math
import random
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachlake.llm import divergence, ngramjoin, queries, runs
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# --- 13: runs ------------------------------------------------------------------------------------


def plain_runs(w, least=12):
    """Every stretch of equal words at each distance, by the definition; equal stretches keep the smallest period."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_the_definition():
    rng = random.Random(11)
    found = 0
    for _ in range(3000):
        w = [rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            at, q = rng.randint(0, len(w)), rng.randint(1, 20)
            w = w[:at] + w[at : at + q] * rng.randint(2, 5) + w[at + q :]
            if w and rng.random() < 0.4:
                w[rng.randrange(len(w))] = 99
        want = plain_runs(w)
        assert runs.find_runs(w) == want, w
        online = runs.RunCatcher()
        for x in w:
            online.append(x)
        assert sorted(online.finish(), key=lambda r: (r[0], r[2])) == want
        found += len(want)
    assert found > 2000


def test_runs_of_long_texts():
    """Time grows with n log n: periods of every size, one word, nested periods, a Fibonacci word."""
    assert runs.find_runs([i % 7 for i in range(50_000)]) == [(0, 50_000, 7)]
    assert runs.find_runs([0] * 50_000) == [(0, 50_000, 1)]
    assert runs.find_runs(list(range(5000)) * 3) == [(0, 15_000, 5000)]
    block = [1, 2] * 10 + [3]
    assert [r for r in runs.find_runs(block * 20) if r[2] == 21] == [(0, 420, 21)]
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert runs.find_runs(b) == plain_runs(b)


def test_first_closed_runs_are_reported_online():
    c = runs.RunCatcher()
    c.extend(["a", "b"] * 8)
    assert c.runs() == []
    c.append("c")
    assert c.runs() == [(0, 16, 2)]


def test_runs_query_against_brute_force(spark):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    docs = documents(spark)
    assert len(got) == len(docs)
    some = 0
    for i, text in docs:
        w = (text or "").encode().split()
        h = crc32(str(i).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        want = plain_runs(w)
        some += bool(want)
        r = got[i]
        best = min(want, key=lambda x: (-x[1], x[0], x[2])) if want else (None,) * 3
        gone = {k for a, n, q in want for k in range(a + q, a + n)}
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert r.runs_sha256 == sha256("".join(f"{a},{n},{q}\n" for a, n, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
    assert some > 10


def test_runs_edge_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n", 0), (None, "x " * 12, 1), (5, "x " * 11, 1), (5, "x " * 11, 1), (6, "A a " * 6, 0)]
    d = spark.createDataFrame(rows, "doc_id int, text string, n_runs int")
    got = sorted(((r.doc_id is None, r.doc_id, r.n_runs, r.period, r.collapsed) for r in runs.periodic_runs(d).collect()), key=str)
    assert got == sorted([(False, 1, 0, None, ""), (False, 2, 0, None, ""), (False, 3, 0, None, ""), (True, None, 1, 1, "x"), (False, 5, 0, None, "x " * 10 + "x"), (False, 5, 0, None, "x " * 10 + "x"), (False, 6, 1, 2, "A a")], key=str)
    assert runs.periodic_runs(d.limit(0)).count() == 0
    with pytest.raises(ValueError, match="12"):
        runs.RunCatcher(8)


# --- 12: n-gram Jaccard join ---------------------------------------------------------------------


def shingles(text, size=3):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def plain_classes(rows, size=3, least=(9, 10)):
    """{row number: (set size, smallest id)} by comparing all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and least[1] * len(sets[i] & sets[j]) >= least[0] * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)].append(d)
    return [(rows[i][0], len(sets[i]), (min(ids[find(i)]) if ids[find(i)] else None)) for i in range(len(rows))]


def classes(d, **more):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.jaccard_classes(d, **more).collect()), key=str)


def test_join_query_against_brute_force(spark):
    got = sorted(map(tuple, queries.op12_ngram_join(spark, SF).select("doc_id", "n_shingles", "component_id").collect()))
    want = plain_classes(documents(spark))
    assert got == sorted(want) and any(i != c for i, _, c in want)


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("chunk", [8, 1024])
def test_join_of_large_groups_against_brute_force(spark, chunk):
    """Near copies, chains of copies, copies around one text that are not similar to each other, texts that share a passage; buckets in chunks."""
    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(3000)}"
    base = [word() for _ in range(150)]
    texts = [edited(rng, base, rng.randint(0, 4)) for _ in range(120)]
    chain = [word() for _ in range(90)]
    for k in range(40):
        chain[(7 * k) % 90] = f"c{k}"
        texts.append(" ".join(chain))
    passage = [word() for _ in range(60)]
    texts += [" ".join(passage + [word() for _ in range(rng.randint(2, 40))]) for _ in range(80)]
    texts += [" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(30)]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    got = classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), chunk=chunk)
    assert got == sorted(plain_classes(rows), key=str)


def test_join_at_the_threshold(spark):
    """19 shared of 20 or 21 shingles in all, at and below 0.9."""
    w = [f"a{i}" for i in range(40)]
    one = " ".join(w[:20])  # 18 shingles
    rows = [(1, one), (2, " ".join(w[:22])), (3, " ".join(w[:23])), (4, " ".join(w[1:23]))]  # 18/20, 18/21, 20/21
    got = classes(spark.createDataFrame(rows, "doc_id int, text string"))
    assert got == sorted(plain_classes(rows), key=str)
    assert plain_classes(rows[:2])[1][2] == 1 and plain_classes([rows[0], rows[2]])[1][2] == 3


def test_join_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one  TWO"), (6, "one"), (7, "a a a a a"), (8, "a a a"), (None, "a a a"), (None, "z z"), (9, "É é"), (10, "é é"), (4, "One two")]
    d = spark.createDataFrame([(i, t, 0, 1) for i, t in rows], "doc_id int, text string, node int, th int")
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 7), (None, 1, 7), (None, 1, None), (9, 1, 9), (10, 1, 10)]
    assert classes(d) == sorted(want, key=str)
    assert ngramjoin.jaccard_classes(d.limit(0)).count() == 0


def test_filters_lose_no_pair():
    """All similar pairs of random sets pass the filters in the bucket of their first common shingle."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(5, 60))
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.permutation(x)[: n - int(rng.integers(0, 4))], rng.integers(0, 2**63, int(rng.integers(0, 4))).astype(np.uint64)])) for _ in range(6)]
        sets.sort(key=len)
        m = [ngramjoin.prefix_size(len(s)) for s in sets]
        first = set()
        for t in {int(v) for s, k in zip(sets, m, strict=True) for v in s[:k]}:
            on = [i for i, s in enumerate(sets) if t in set(s[: m[i]].tolist())]
            pos = np.array([sets[i].tolist().index(t) for i in on])
            size = np.array([len(sets[i]) for i in on])
            hist = np.array([np.bincount((sets[i] & np.uint64(255)).astype(int), minlength=256) for i in on])
            a, b = ngramjoin.candidates(size, pos, hist, np.arange(len(on)), True)
            first |= {(on[i], on[j]) for i, j in zip(a, b, strict=True)}
        for i in range(6):
            for j in range(i + 1, 6):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 10 * common >= 9 * (len(sets[i]) + len(sets[j]) - common):
                    assert (i, j) in first


def test_buckets_in_batches_of_any_size():
    """Runs over batch edges, copies of a node, long runs: the same rows, and only nodes without a partner missing."""
    import pyarrow as pa

    rng = random.Random(2)
    rows = sorted({(t, n, 10_000 * t + n * 100 + k, 0 if k else n // 10) for t in range(60) for k in range(rng.choice([1, 1, 2, 3, 40])) for n in [rng.randint(20, 60)]} | {(99, 50, i, 0) for i in range(300)})
    rows = [r for r in rows for _ in range(rng.choice([1, 1, 3]))]
    want = None
    for size in (1, 7, 64, 10_000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], ["token", "n", "node", "pos"]) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in ngramjoin._buckets(64)(iter(batches)) for r in b.to_pylist()]
        want = want or got
        assert got == want and len(set(got)) == len(got)
    kept = set(want)
    for t in range(60):
        own = sorted({r for r in rows if r[0] == t})
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if 10 * a[1] >= 9 * b[1] and 19 * min(a[1] - a[3], b[1] - b[3]) >= 9 * (a[1] + b[1]):
                    assert a in kept and b in kept
    assert sum(r[0] == 99 for r in kept) == 300 and len(kept) < len(set(rows))


def test_shingle_sets_of_long_texts():
    """A text hashed in pieces has the set of the text hashed at once, and texts do not touch each other."""
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(n)).encode() for n in (0, 1, 2, 3, 400, 5000)]
    whole = list(ngramjoin.shingle_sets(texts))
    assert [len(x) for x in whole] == [len(shingles(t.decode())) for t in texts]
    for a, b in zip(whole, ngramjoin.shingle_sets(texts, most=97), strict=True):
        assert (a == b).all()


# --- 11: source divergence audit -----------------------------------------------------------------


def plain_audit(rows, least=10, top=10):
    """rows: (text, lang, source)."""
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [t.translate({i: i + 32 for i in range(65, 91)}) for t in divergence.PATTERN.findall(text or "")]
        df[lang].update(set(found))
        counts[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, c in df[lang].items() if c >= least]
        v = len(kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * v) for t in kept}
        p = {s: share(counts[lang, s]) for s in sources}
        total = Counter()
        for s in sources:
            total.update(counts[lang, s])
        q = share(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for k, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.append((lang, s, part, item, value, k + 1))
    return sorted(out)


def test_audit_equals_sql(spark):
    assert compare(spark, "op11", queries.op11_divergence, queries.ORACLE_SQL["op11_divergence"], SF) > 50


def test_audit_edge_cases_and_both_ways(spark):
    rng = random.Random(8)
    rows = [(" ".join(rng.choice(["Red", "green", "blé", "été", "a-b", "x1y", "日本"]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "š", None])) for _ in range(300)]
    rows += [(None, "xx", "a"), ("", "xx", "b"), ("only once", "yy", None), ("tie tie", "xx", "c")] + [rows[0]] * 40
    d = spark.createDataFrame([(*r, "k", 0) for r in rows], "text string, lang string, source string, k string, slot int")
    want = plain_audit(rows)
    assert sorted(map(tuple, divergence.audit(d).collect())) == want
    assert sorted(map(tuple, divergence.audit(d, broadcast=-1).collect())) == want
    assert any(r[4] == 0 and r[2] == "pair" for r in want)
    assert divergence.audit(d.limit(0)).count() == 0


def test_perfect_hash_is_minimal_and_rejects_others():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = np.array([divergence.key_hash(b"en", k) for k in keys], np.uint64)
    h[1] = h[0]  # equal hashes of different keys
    t = divergence.PerfectHash.load(divergence.PerfectHash.build(keys, h).dump())
    assert sorted(t.slots(keys, h).tolist()) == list(range(5000))
    others = [f"o{i}".encode() for i in range(5000)]
    assert (t.slots(others, h) == -1).all()
    assert all(t.keys[s] == k for s, k in zip(t.slots(keys, h).tolist(), keys, strict=True))


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, v = 4 * 10**15, 8 * 10**15, 10**6
    got = spark.range(1).select(F.expr(divergence.share(f"{n}L", f"{total}L", f"{v}L")).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v) and math.log2(10**9 * n) > 64


def test_near_copies_of_many_unlike_members(spark):
    """Texts at Jaccard 0.6 to 0.79 that fill whole buckets: none is linked but the planted pairs, with buckets over and under the chunk. The members are compared by rare shingles only."""
    from reachlake.llm import simhash

    rng = random.Random(7)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for k in range(1500):
        w = list(base)
        a = rng.randrange(75)
        w[a : a + 12] = [f"x{k}y{i}" for i in range(12)]  # 16 of 96 shingles are new: 64/128 to each other at most
        rows.append((k, " ".join(w)))
    rows += [(5000 + k, rows[k][1] + f" tail{k}") for k in range(0, 1500, 100)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    want = {i: i - 5000 if i >= 5000 else i for i, _ in rows}
    for chunk in (200, simhash.CHUNK):
        assert {r.doc_id: r.component_id for r in simhash.near_copies(d, chunk=chunk).collect()} == want


def test_elias_fano_encoding_takes_little_memory():
    """Half a million values of some 40 low bits each: the same numbers come back, and no slot of eight bytes is taken for each bit."""
    import tracemalloc

    from reachlake.llm import lm

    n = 500_003
    values = np.sort(np.random.default_rng(2).integers(0, 1 << 60, n, dtype=np.uint64))
    tracemalloc.start()
    data = lm.ef_encode(values, 1 << 60)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    at = np.concatenate([np.arange(40_000), np.arange(n - 40_000, n)])
    assert (lm.EliasFano(data, 0).get(at) == values[at]).all()
