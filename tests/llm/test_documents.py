"""Operators over documents against brute force, on real rows and on hand-made edge cases."""

import pytest
from pyspark.sql import functions as F

from reachlake.llm import decontaminate, linededup, mixing, quality, simhash
from tests.llm import brute

SF = "/root/testdata/sf0.001"
LINE = "This Line is Long enough to be counted as a long line"
EDGE = [
    (1, None, "b"),
    (2, "", None),
    (3, " \t\n \x0b", "a"),
    (4, f"{LINE}\n{LINE.upper()} \nshort", "a"),
    (5, LINE, "a"),
    (6, f"x\n  {LINE}\t\ny", "a"),
    (7, LINE.lower() + "\n", "b"),
    (8, f"{LINE}\n\n{LINE}", "c"),
    (9, f"{LINE}é", "c"),
    (10, "one two three", "c"),
    (11, "ONE two\nthree", "c"),
    (12, "é ñ one two three four five six seven eight nine ten eleven é", "c"),
    (13, "a b c " * 40, "c"),
    (14, "word " * 30000, "hot"),
    (15, "# * $ % & | < > 数 据 数 据 数 据", "hot"),
]
ITEMS = [(1, "Three"), (2, None), (3, ""), (4, "one two three four five six seven eight nine ten eleven"), (5, "nine-ten"), (50, "THREE"), (None, "one")]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    edge = spark.createDataFrame([(100_000 + i, t, s) for i, t, s in EDGE], real.schema)
    # Clashing extra columns, and more partitions than rows in some of them.
    return real.unionByName(edge).withColumns({c: F.lit("x") for c in ("fp", "h1", "row", "t", "keys", "w", "size", "kept", "u", "n_words")}).repartition(7).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]


def test_decontamination(spark, docs, plain):
    """Items without an id hit too (as in the contract's SQL); a benchmark over the bound is taken in parts with equal rows."""
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900 + i if i else None, t) for i, t in ITEMS]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute.decontamination(plain, items)
    assert want[100_010][1:3] == (2, 3)  # "one two three" by Three, THREE and the item without an id
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = {r[0]: r for r in decontaminate.contamination(docs, bench).collect()}
    assert {k: tuple(r[c] for c in names[1:]) for k, r in got.items()} == want
    size = sum(len(t or "") for _, t in items)
    parts = {r[0]: r for r in decontaminate.contamination(docs, bench, max_benchmark_chars=size // 3).collect()}
    assert parts == got
    for most in (1_000_000, size // 3):
        clean = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench, max_benchmark_chars=most).collect()}
        assert clean == {k for k, v in want.items() if not v[-1]}


def test_decontamination_spans_map_to_the_original(spark):
    text = "Été! ONE, two...three ñandú é"
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    b = spark.createDataFrame([(7, "one two"), (8, "three ñandú")], "item_id bigint, text string")
    r = decontaminate.contamination(d, b).first()
    assert [text[s.start : s.end] for s in r.spans] == ["ONE, two...three ñandú"] and r.n_hit == 4 and r.item_ids == ["7", "8"]


def test_decontamination_null_ids_in_parts(spark):
    d = spark.createDataFrame([(None, "one two"), (None, "one two"), (3, "one"), (3, None)], "doc_id bigint, text string")
    b = spark.createDataFrame([(7, "one two"), (None, "one"), (8, None)], "item_id bigint, text string")
    for most in (1_000_000, 2):
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.item_ids) for r in decontaminate.contamination(d, b, max_benchmark_chars=most).collect())
        assert got == [("3", 0, 0, 0, []), ("3", 1, 1, 1, []), ("None", 2, 2, 2, ["7"]), ("None", 2, 2, 2, ["7"])]


def test_simhash(docs, plain):
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()}
    want = brute.simhash(plain)
    assert got == want
    left = simhash.keep_first_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, c in want.values()})


def test_simhash_links_every_pair_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 12, dtype=np.uint64)
    x = list(base)
    for _ in range(400):
        v = int(x[rng.integers(len(x))])
        for b in rng.integers(0, 64, rng.integers(1, 5)):
            v ^= 1 << int(b)
        x.append(np.uint64(v))
    x = np.unique(np.array(x, np.uint64))
    want = {(i, j) for i in range(len(x)) for j in range(i) if (int(x[i]) ^ int(x[j])).bit_count() <= 3}
    root = list(range(len(x)))

    def find(i, r):
        while r[i] != i:
            i = r[i]
        return i

    for i, j in want:
        a, b = find(i, root), find(j, root)
        root[max(a, b)] = min(a, b)
    for lags in (1, 4, 32, 1000):
        mine = list(range(len(x)))
        for i, j in zip(*simhash.bucket_links(np.zeros(len(x), np.int64), x, lags), strict=True):
            assert (int(x[i]) ^ int(x[j])).bit_count() <= 3
            a, b = find(i, mine), find(j, mine)
            mine[max(a, b)] = min(a, b)
        assert [find(i, mine) for i in range(len(x))] == [find(i, root) for i in range(len(x))]
    a = x.view(np.int64)
    assert all(any((int(x[i]) ^ int(x[j])) >> lo & ((1 << hi - lo) - 1) == 0 for lo, hi in simhash.BLOCKS) for i, j in want) and len(a)


def test_large_buckets_are_dealt_again(spark):
    """With buckets of at most a few members, at every step, the links join the same components."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = [int(v) for v in rng.integers(0, 2**64, 6, dtype=np.uint64)]
    for _ in range(300):  # all near each other: many meet in every bucket
        v = x[int(rng.integers(len(x)))]
        for b in rng.integers(0, 64, int(rng.integers(1, 6))):
            v ^= 1 << int(b)
        x.append(v)
    x = sorted(set(x))
    root = {v: v for v in x}

    def find(v, r):
        while r[v] != v:
            v = r[v]
        return v

    for i, v in enumerate(x):
        for w in x[:i]:
            if (v ^ w).bit_count() <= 3:
                a, b = sorted((find(v, root), find(w, root)))
                root[b] = a
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(signed(v),) for v in x], "fp bigint")
    for most in (1, 4, 4096):
        own = {v: v for v in x}
        for r in simhash.fingerprint_links(nodes, most).collect():
            v, w = r.a % (1 << 64), r.b % (1 << 64)
            assert (v ^ w).bit_count() <= 3
            a, b = sorted((find(v, own), find(w, own)))
            own[b] = a
        assert [find(v, own) for v in x] == [find(v, root) for v in x]


def test_planes_hold_bits_vertically():
    import numpy as np

    x = np.random.default_rng(9).integers(0, 2**64, (200, 2), dtype=np.uint64)
    p = simhash.Planes(x, slab=64)
    for i in (0, 63, 64, 199):
        for b in (0, 1, 63, 64, 127):
            assert int(p.planes[b][i >> 6]) >> (i & 63) & 1 == int(x[i, b >> 6]) >> (b & 63) & 1


def test_wide_comparison_counts_bits():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**64, (300, 4), dtype=np.uint64)
    y = x.copy()
    for i in range(300):
        for b in rng.choice(256, i % 90, replace=False):
            y[i, b // 64] ^= np.uint64(1 << int(b % 64))
    assert simhash.close_wide(x, y, 46).tolist() == [i for i in range(300) if i % 90 <= 46]


def test_near_copies(spark):
    """Edited copies at similarity 0.85 or more meet; unrelated texts, and a chain's far ends, are as the links say."""
    import random

    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = []
    for g in range(40):
        base = [word() for _ in range(rnd.choice([12, 60, 300, 2000]))]
        rows.append((g * 10, " ".join(base)))
        for k in range(1, 4):
            w = list(base)
            for _ in range(max(1, len(w) // 100) if len(w) > 50 else 0):
                w[rnd.randrange(len(w))] = word()
            rows.append((g * 10 + k, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "one"), (None, rows[0][1])]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit(1)).repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(d).collect()}
    assert got == {i: 0 if i is None else 1000 if i == 1001 else i if i >= 1000 else i // 10 * 10 for i, _ in rows}
    assert got == {r.doc_id: r.component_id for r in simhash.near_copies(d, chunk=2).collect()}  # every bucket in pairs of chunks
    assert sorted(r.doc_id for r in simhash.keep_first_of_each(d, near=simhash.near_copies).collect()) == sorted({g * 10 for g in range(40)} | {1000, 1002})
    assert simhash.near_copies(d.where("false")).count() == 0


def test_near_copies_are_exact_at_the_similarity(spark):
    """Shingle sets at exactly 0.8 meet and those just below don't; repeats within a text don't count."""
    text = lambda g, n: " ".join(f"w{g}x{i}" for i in range(n + 4))
    rows, want = [], {}
    for g in range(120):
        n = (5, 10, 50, 100, 1000)[g % 5]
        linked = g < 60
        rows += [(2 * g, text(g, n)), (2 * g + 1, text(g, n * 4 // 5 - (not linked)))]
        want |= {2 * g: 2 * g, 2 * g + 1: 2 * g + (not linked)}
    for g in range(200, 240):
        part = " ".join(f"r{g}x{i}" for i in range(5))
        rows += [(2 * g, f"{part} {part} {text(g, 91)}"), (2 * g + 1, f"{' '.join([part] * 9)} {text(g, 91)}")]
        want |= {2 * g: 2 * g, 2 * g + 1: 2 * g}
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in simhash.near_copies(d).collect()} == want


def test_near_members_are_all_that_have_a_partner():
    import numpy as np

    rng = np.random.default_rng(4)
    keys, n = np.sort(rng.integers(0, 4, 300)), rng.integers(70, 101, 300)
    noise = lambda: rng.integers(0, 2**64, (300, 4), dtype=np.uint64)
    x = np.where(rng.random((300, 1)) < 0.5, rng.integers(0, 2**64, (1, 4), dtype=np.uint64) ^ (noise() & noise() & noise()), noise())
    bits = lambda i, j: sum((int(a) ^ int(b)).bit_count() for a, b in zip(x[i], x[j], strict=True))
    near = lambda i, j: i != j and keys[i] == keys[j] and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]) and bits(i, j) <= 56
    want = [any(near(i, j) for j in range(300)) for i in range(300)]
    for lags in (1, 8, 1000):
        assert simhash.near_members(keys, n, x, 56, lags).tolist() == want
    assert 100 < sum(want) < 200


def test_similar_links_are_exact():
    import numpy as np

    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 40)
    sets = [np.unique(np.where(rng.random(40) < rng.choice([0.02, 0.1, 0.3]), rng.integers(0, 2**63, 40), base)) for _ in range(120)] + [np.zeros(0, np.int64)]
    root = list(range(121))

    def find(i, r):
        while r[i] != i:
            i = r[i]
        return i

    like = lambda a, b: 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b))
    for i in range(120):
        for j in range(i):
            if like(sets[i], sets[j]):
                p, q = sorted((find(i, root), find(j, root)))
                root[q] = p
    mine = list(range(121))
    links = simhash.similar_links(np.array([len(s) for s in sets]), np.concatenate(sets))
    for i, j in links:
        assert like(sets[i], sets[j])
        p, q = sorted((find(i, mine), find(j, mine)))
        mine[q] = p
    assert [find(i, mine) for i in range(121)] == [find(i, root) for i in range(121)] and 20 < len(links) < 120


def test_simhash_repeated_and_null_ids(spark):
    d = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "q r s t u"), (None, "a b c d"), (None, "z z z"), (None, None), (None, "")], "doc_id bigint, text string")
    got = sorted([(str(r.doc_id), r.component_id) for r in simhash.near_duplicates(d).collect()], key=str)
    assert got == sorted([("1", 1)] * 3 + [("None", 1)] + [("None", None)] * 3, key=str)
    assert sorted(str(r.text or "") for r in simhash.keep_first_of_each(d).collect()) == ["", "a b c d", "q r s t u", "z z z"]
    empty = spark.createDataFrame([], d.schema)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first_of_each(empty).count() == 0


def test_components_of_long_paths(spark):
    e = spark.range(60).selectExpr("id as a", "id + 1 as b").union(spark.range(5).selectExpr("id + 1000 as a", "id * 10 + 2000 as b"))
    got = {r.node: r.root for r in simhash.components(e).collect()}
    assert len({got[i] for i in range(61)}) == 1 and got[0] <= 60 and len({got[1000 + i] for i in range(5)}) == 5 and got[2040] in (1004, 2040)


def test_quality(docs, plain):
    got = {r[0]: r for r in quality.quality_verdicts(docs).collect()}
    for k, v in brute.quality_base(plain).items():
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == v, k
        assert not (r.kept and r.base_failed)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}


def test_repeated_windows_are_exact_when_hashes_meet(spark):
    """With almost no hash bits every text has unequal windows of equal hashes, also between repeats of one window."""
    import random

    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(n)) for n in (3, 4, 5, 30, 200, 3000)] + [" ".join(f"w{i % 700}" for i in range(1500)), " ".join(f"u{i}" for i in range(2000))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    words = F.split("text", " ", -1)
    for fewer in (0, 30, 45, 49):
        got = {r.doc_id: r.n for r in d.select("doc_id", quality._covered(words, fewer).alias("n")).collect()}
        assert got == {k: v[4] for k, v in brute.quality_base(list(enumerate(texts))).items()}


def test_quality_of_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string, row int")
    assert quality.quality_verdicts(d).count() == 0 and quality.keep_good(d).count() == 0 and quality.keep_good(d).columns == d.columns
    b = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(d, b).count() == 0 and decontaminate.drop_contaminated(d, b).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert decontaminate.contamination(one, b).first().n_hit == 0


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    r = quality.quality_verdicts(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("n_words >= 50")
    right, n = r.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97


def test_quality_em_recovers_junk_of_one_kind():
    good, bad = (1, 1, None), (1, 0, None)
    share, likely = quality.fit_em([(good, 950), (bad, 50)])
    assert quality.posterior(share, likely, good)[0] > 0.9 > 0.5 > quality.posterior(share, likely, bad)[0]
    assert quality.fit_em([])[0][0] == 0.9


def test_line_dedup(docs, plain):
    got = {r[0]: tuple(r[1:]) for r in linededup.line_bitmaps(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()}
    want = brute.line_dedup(plain)
    assert got == want and sum(v[1] for v in want.values()) > 5
    out = linededup.drop_lines(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert {k: brute.sha(t or "") for k, t in texts.items()} == {k: v[2] for k, v in want.items()}
    assert texts[100_001] is None


@pytest.mark.parametrize("parts", [1, 3, 16, 61])
def test_line_dedup_hot_keys_over_partition_edges(spark, parts):
    rows = [(i, "\n".join(f"{LINE} number {k}" for k in range(6) if i % (k + 1) == 0)) for i in range(120)] + [(200 + i, f"{LINE} rare {i % 9}") for i in range(38)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r[0]: (r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.line_bitmaps(d).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute.line_dedup(rows)


def test_line_dedup_null_and_repeated_ids(spark):
    rows = [(i, LINE) for i in (1, 2, 3, 4)] + [(4, LINE), (None, LINE)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.n_dropped for r in linededup.line_bitmaps(d).collect()} == {0}
    d = d.union(spark.createDataFrame([(5, LINE)], d.schema))
    assert sorted((str(r.doc_id), r.n_dropped) for r in linededup.line_bitmaps(d).collect()) == [("1", 1), ("2", 1), ("3", 1), ("4", 1), ("4", 1), ("5", 0), ("None", 0)]
    assert linededup.line_bitmaps(d.where("false")).count() == 0


def test_line_bitmaps_without_texts(spark):
    """Bitmaps alone give the kept lines back; the plan of their making moves no text."""
    rows = [(i, f"a\n{LINE}\nb {i}\n  {LINE} \n") for i in range(6)] + [(7, None), (None, LINE), (3, LINE)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    maps = linededup.keep_bitmaps(d)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, linededup.zlib.decompress(r.keep_bitmap)[0]) for r in maps.collect())
    assert got == sorted([(i, 5, 2, 0b10101) for i in range(5)] + [(5, 5, 0, 0b11111), (7, 1, 0, 1), (-1, 1, 0, 1), (3, 1, 1, 0)])
    assert sorted(r.text or "" for r in linededup.drop_lines(d).collect()) == sorted([f"a\nb {i}\n" for i in range(5)] + [rows[5][1], "", LINE, ""])


def test_mixing(docs, plain):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(plain)
    size = {k: len(brute.WS.findall(t or "")) for k, t in plain}
    taken, target, total = {}, {}, {}
    for r in rows:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source], total[r.source] = r.target, r.source_size
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1 and t <= 2 * total[s] + 1e-6
    assert abs(sum(target.values()) - min(1.5 * sum(size.values()), 2 * sum(size.values()))) < 1
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)
    assert mixing.mix(docs.where("false")).count() == 0


def test_flow_over_overlapping_sources():
    cap = {("a",): 10, ("a", "b"): 20, ("b",): 5}
    flow = mixing.min_cost_flow(cap, {"a": 12, "b": 20})
    assert sum(v for (_, s), v in flow.items() if s == "a") == 12 and sum(v for (_, s), v in flow.items() if s == "b") == 20
    assert sum(v for (p, _), v in flow.items() if p == ("a", "b")) <= 20  # no repetition is needed
    more = mixing.min_cost_flow(cap, {"a": 60, "b": 10})
    assert sum(v for (_, s), v in more.items() if s == "a") == 60
    assert mixing.min_cost_flow({("a",): 3}, {"a": 100}) == {(("a",), "a"): 6}


def lp_cost(capacity, quota, repeat=2):
    """Least repetition cost of routing all that can be routed, by trying every split of small cases."""
    import itertools

    patterns = list(capacity)
    ways = []
    for p in patterns:
        most = repeat * capacity[p]
        ways.append([x for x in itertools.product(range(most + 1), repeat=len(p)) if sum(x) <= most])
    best = None
    for choice in itertools.product(*ways):
        got = dict.fromkeys(quota, 0)
        for p, x in zip(patterns, choice, strict=True):
            for s, n in zip(p, x, strict=True):
                got[s] += n
        if any(got[s] > quota[s] for s in quota):
            continue
        cost = sum(max(0, sum(x) - capacity[p]) for p, x in zip(patterns, choice, strict=True))
        key = (-sum(got.values()), cost)
        best = key if best is None else min(best, key)
    return best


def test_flow_is_optimal_on_small_cases():
    import random

    rnd = random.Random(8)
    for _ in range(40):
        names = [("a",), ("b",), ("a", "b"), ("b", "c")]
        cap = {p: rnd.randint(0, 3) for p in rnd.sample(names, 3)}
        quota = {s: rnd.randint(0, 5) for p in cap for s in p}
        flow = mixing.min_cost_flow(cap, quota)
        used = {p: sum(v for (q, _), v in flow.items() if q == p) for p in cap}
        assert all(v <= 2 * cap[p] for p, v in used.items()) and all(s in p for p, s in flow)
        got = (-sum(flow.values()), sum(max(0, v - cap[p]) for p, v in used.items()))
        assert got == lp_cost(cap, quota), (cap, quota, flow)


def test_mix_of_overlapping_sources(spark):
    """Words taken by (document, source) add up to each source's target; no source gets words of documents that aren't its own."""
    import random

    rnd = random.Random(6)
    choices = [["a"], ["b"], ["a", "b"], ["b", "a", "a"], ["c", None], [None], [], None]
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), rnd.choice(choices)) for i in range(900)] + [(None, "x y z", ["a", "c"]), (5000, None, ["a"])]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, tags array<string>").withColumns({c: F.lit("q") for c in ("parts", "pattern", "range", "source", "marks")}).repartition(6)
    got = mixing.mix(d, members=F.col("tags"), seed=3).collect()
    assert len(got) == len(rows)
    by = {i: (len((t or "").split()), sorted({x for x in m or [] if x is not None}) + [None] * (None in (m or []))) for i, t, m in rows}
    taken, size = {}, {}
    for r in got:
        n, own = by[r.doc_id]
        assert r.size == n and r.sources == own and r.taken == sum(p.words for p in r.parts) <= 2 * n and all(p.words >= 0 and p.source in own for p in r.parts)
        for s in own:
            size[s] = size.get(s, 0) + n
        for p in r.parts:
            taken[p.source] = taken.get(p.source, 0) + p.words
        if not own:
            assert r.taken == 0 and r.target is None and r.source_size is None
    words = sum(n for n, own in by.values() if own)
    want = mixing.source_targets(size, mixing.default_weights(list(size)), words=words)
    assert sum(want.values()) <= 1.5 * words + 1e-6
    cap = {}
    for n, own in by.values():
        if own:
            cap[tuple(own)] = cap.get(tuple(own), 0) + n
    flow = mixing.min_cost_flow(cap, {s: round(t) for s, t in want.items()})
    routed = {s: sum(v for (_, x), v in flow.items() if x == s) for s in size}
    assert taken == {s: v for s, v in routed.items() if s in taken} and sum(taken.values()) == sum(routed.values())
    again = mixing.mix(d.repartition(2), members=F.col("tags"), seed=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    with pytest.raises(ValueError, match="patterns"):
        mixing.mix(d, members=F.col("tags"), max_patterns=3)


def test_targets_cap_and_reshare():
    t = mixing.source_targets({"a": 10, "b": 100, "c": 100, None: 0}, mixing.default_weights(["a", "b", "c", None]))
    assert t[None] == 0 and t["a"] == 20 and abs(sum(t.values()) - 315) < 1e-9 and all(t[s] <= 2 * n for s, n in {"b": 100, "c": 100}.items())


def test_texts_of_over_a_million_characters(spark):
    """Whole texts count: what matters stands at the end of each."""
    body = " ".join(f"w{i % 5000}x{i % 7}" for i in range(150_000))
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, f"{body} {passage}", "a"), (2, f"{body} {passage}.", "b"), (3, f"{body}\n{LINE}", "a"), *((i, LINE, "c") for i in range(4, 8))]
    assert len(rows[0][1]) > 1_000_000
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    b = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    assert {r.doc_id for r in decontaminate.contamination(d, b).where("contaminated").collect()} == {1, 2}
    assert {r.doc_id: r.n_dropped for r in linededup.line_bitmaps(d).collect()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 1, 7: 0}
    assert {r.doc_id: r.component_id for r in simhash.near_copies(d).collect()} == {1: 1, 2: 1, 3: 1} | dict.fromkeys(range(4, 8), 4)
    assert {r.doc_id: r.size for r in mixing.mix(d).collect()}[1] == 150_010
    q = {r.doc_id: r for r in quality.quality_verdicts(d).collect()}
    assert q[1].n_words == 150_010 and q[1].n_repeat_words == brute.quality_base(rows[:1] and [(1, rows[0][1])])[1][4]
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(d).select("doc_id", "fingerprint", "component_id").collect()}
    assert got == brute.simhash([r[:2] for r in rows])
