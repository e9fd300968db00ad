"""SimHash near-dedup (operator 6): bit-sliced comparison of fingerprints.

1. A map over the whole texts: words, 3-word shingles, XXH64 of each, and one 64-bit fingerprint a document.
   Bit counts are summed in byte lanes of machine words, many hashes at once.
2. Equal fingerprints are one node (its smallest doc_id is kept), so copies never meet each other again.
3. A pair at distance 3 or less agrees on at least two of five bit blocks, so each distinct fingerprint goes
   to ten buckets keyed by two blocks (25 or 26 bits). Buckets of more than BUCKET members are dealt again: the pair agrees
   on at least one of four parts of the remaining bits, so each member goes to four smaller buckets, and so on while
   some are too large; rows grow by four times a step, not with the square, and a last bucket has at most 2**14 members.
   A task stores its fingerprints vertically (`Planes`): plane b holds bit b of 64 fingerprints a word. Planes
   are XORed with themselves shifted by 1, 2, 3, ... places, and the differing planes are summed by carry-save
   counters for 64 pairs a word. Words whose lanes have all passed the radius are abandoned, and pairs that are joined
   already are masked out. Only pairs that join two components of the bucket leave it, fewer
   than it has members: every link is used and no list of all pairs is made.
4. Components over these edges: each round every node takes its neighbour of lowest random rank and the edges
   are rewritten by it, with each round written to the shared folder. Nothing but row counts reaches the
   driver.

Null, empty and blank texts have fingerprint 0 and link like others. Repeated rows are separate rows with equal
results. Rows with a null doc_id are linked but name no component unless all its rows are null, which
gives component_id null. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, lower_ascii, slices

RADIUS = 3
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
PAIRS = tuple(combinations(range(5), 2))


def shingle_hashes(data: bytes, size: int = 3) -> list[int]:
    """XXH64 (seed 42) of every shingle of `size` words, repeats included; of all words if there are fewer."""
    from xxhash import xxh64_intdigest as h

    words = lower_ascii(data).split()
    if len(words) < size:
        return [h(b" ".join(words), 42)] if words else []
    text = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    return [h(text[a:b], 42) for a, b in zip([0, *(e + 1 for e in ends[:-size])], ends[size - 1 :], strict=True)]


def majority(x, n):
    """For each run of n[i] hashes in x, the bits set in over half of them (0 for an empty run).

    Counts of bit s, s+8, ... sit in the eight byte lanes of a word and are summed in runs of at most 255.
    """
    import numpy as np

    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    cuts = np.concatenate([np.arange(s, s + k, 255) for s, k in zip(starts[full], n[full], strict=True)])
    owner = np.repeat(np.arange(len(full)), -(-n[full] // 255))
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    bits = np.zeros((len(full), 8, 8), bool)
    for s in range(8):
        lanes = np.add.reduceat((x >> np.uint64(s)) & np.uint64(0x0101010101010101), cuts).view(np.uint8).reshape(-1, 8)
        bits[:, :, s] = 2 * np.add.reduceat(lanes, first, axis=0, dtype=np.int64) > n[full][:, None]
    out[full] = np.packbits(bits, axis=2, bitorder="little").reshape(-1, 8).copy().view(np.uint64).ravel()
    return out


def _pooled(texts, size: int, make, most: int = 200_000) -> list:
    """make(hashes, run lengths) over texts in pools of about `most` shingles."""
    import numpy as np

    out, pool, sizes = [], [], []
    for data in texts:
        h = shingle_hashes(data, size)
        pool += h
        sizes.append(len(h))
        if len(pool) > most:
            out.append(make(np.array(pool, np.uint64), np.array(sizes)))
            pool, sizes = [], []
    if sizes or not out:
        out.append(make(np.array(pool, np.uint64), np.array(sizes, np.int64)))
    return out


def fingerprints(texts):
    """One uint64 for each text."""
    import numpy as np

    return np.concatenate(_pooled(texts, 3, majority))


BINS, ROWS, BANDS, WORDS = 64, 3, 21, 4
CHUNK = 16_384
#: Least similarity of near copies, as a fraction.
LEAST = (4, 5)


def _mix(x, seed: int):
    import numpy as np

    x = (x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def wide_sketch(x, n):
    """Per run of shingle hashes: a 256-bit SimHash (four words) and 21 band keys of a one-permutation MinHash.

    An empty MinHash bin takes the value of the next full one, with its distance mixed in.
    """
    import numpy as np

    signature = np.stack([majority(_mix(x, k + 1), n) for k in range(WORDS)], axis=1)
    g = _mix(x, 9)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.full(len(n) * BINS, empty)
    np.minimum.at(low, np.repeat(np.arange(len(n)) * BINS, n) + (g >> np.uint64(58)).astype(np.int64), g & np.uint64((1 << 58) - 1))
    low = low.reshape(-1, BINS)
    for _ in range(BINS - 1):
        hole = low == empty
        if not hole[n > 0].any():
            break
        low = np.where(hole & (np.roll(low, -1, axis=1) != empty), _mix(np.roll(low, -1, axis=1), 11) >> np.uint64(1), low)
    keys = [_mix(_mix(_mix(low[:, 3 * k], 20 + k) ^ low[:, 3 * k + 1], 1) ^ low[:, 3 * k + 2], 2) for k in range(BANDS)]
    return np.concatenate([signature, np.stack(keys, axis=1)], axis=1)


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, fp): th is a hash of the text that tells rows of one doc_id apart; fp is signed. No shuffle."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fp = fingerprints(slices(batch.column(2))).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], ["doc_id", "th", "fp"])

    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("t"))
    return d.mapInArrow(run, "doc_id bigint, th bigint, fp bigint")


class Planes:
    """Fingerprints stored vertically: bit i of word w of plane b is bit b of fingerprint 64 w + i."""

    def __init__(self, x, slab: int = 8192):
        import numpy as np

        x = x.reshape(len(x), -1)
        self.bits, self.n = 64 * x.shape[1], len(x)
        words = -(-len(x) // 64)
        self.planes = np.zeros((self.bits, words + 1), np.uint64)
        out = self.planes.view(np.uint8)
        for a in range(0, len(x), slab):
            rows = np.unpackbits(np.ascontiguousarray(x[a : a + slab]).view(np.uint8).reshape(-1, self.bits // 8), axis=1, bitorder="little")
            packed = np.packbits(rows, axis=0, bitorder="little").T
            out[:, a // 8 : a // 8 + packed.shape[1]] = packed

    def shifted(self, lag: int):
        """diff(b, words): plane b XOR itself moved by lag places."""
        import numpy as np

        q, r = divmod(lag, 64)
        last = self.planes.shape[1] - 1

        def diff(b: int, word):
            plane = self.planes[b]
            moved = plane[np.minimum(word + q, last)]
            if r:
                moved = (moved >> np.uint64(r)) | (plane[np.minimum(word + q + 1, last)] << np.uint64(64 - r))
            return plane[word] ^ moved

        return diff

    def against(self, fingerprint):
        """diff(b, words): plane b XOR the bit of one fingerprint."""
        import numpy as np

        bits = np.unpackbits(np.ascontiguousarray(fingerprint).view(np.uint8), bitorder="little").astype(bool)
        return lambda b, word: ~self.planes[b][word] if bits[b] else self.planes[b][word]

    def near(self, diff, at, radius: int):
        """Those of the sorted positions `at` where diff has at most radius planes set.

        Counters of radius.bit_length() carry-save digits; after every eight planes words without a live lane are abandoned.
        """
        import numpy as np

        if not len(at):
            return at
        starts = np.flatnonzero(np.concatenate([[True], (at[1:] >> 6) != (at[:-1] >> 6)]))
        word = (at >> 6)[starts]
        live = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), starts)
        k = radius.bit_length()
        digits = [np.zeros(len(word), np.uint64) for _ in range(k)]
        for group in range(0, self.bits, 8):
            for b in range(group, group + 8):
                carry = diff(b, word)
                for d in range(k):
                    digits[d], carry = digits[d] ^ carry, digits[d] & carry
                    if d and not carry.any():
                        break
                else:
                    live &= ~carry
            if radius + 1 < 1 << k:
                above, same = np.zeros(len(word), np.uint64), ~np.zeros(len(word), np.uint64)
                for d in range(k - 1, -1, -1):
                    if radius >> d & 1:
                        same &= digits[d]
                    else:
                        above |= same & digits[d]
                        same &= ~digits[d]
                live &= ~above
            on = live != 0
            if not on.all():
                word, live, digits = word[on], live[on], [d[on] for d in digits]
            if not len(word):
                return np.zeros(0, np.int64)
        w, lane = np.nonzero(np.unpackbits(live.view(np.uint8), bitorder="little").reshape(-1, 64))
        return word[w] * 64 + lane


def close_wide(x, y, radius: int):
    """Positions where the fingerprints x and y (rows of one or more words) differ in at most radius bits."""
    import numpy as np

    return Planes(x ^ y).near(Planes(x ^ y).against(np.zeros(x[:1].size, np.uint64)), np.arange(len(x)), radius)


def outsiders(root, start, end):
    """Positions in the runs [start, end) that are outside their run's largest component."""
    import numpy as np

    out = [np.zeros(0, np.int64)]
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        own, at, count = np.unique(root[a:b], return_inverse=True, return_counts=True)
        out.append(a + np.flatnonzero(at != count.argmax()))
    return np.concatenate(out)


def bucket_links(keys, x, lags: int = 32, radius: int = RADIUS):
    """Spanning links (positions a, b) of each run of equal keys; x is distinct within a run.

    All runs are compared at shifts 1, 2, ... together, which settles runs of up to that many and one more. After `lags` shifts, and
    after as many again and again, longer runs leave the shifts if fewer members are outside their largest components
    than shifts are to come: each of these members is compared with all members outside its own component, as a
    link that is still missing has such an end.
    """
    import numpy as np

    planes = Planes(x)
    n = len(x)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def flat(a: int = 0, b: int = n) -> None:
        while (root[root[a:b]] != root[a:b]).any():
            root[a:b] = root[root[a:b]]

    left: list[int] = []
    right: list[int] = []

    def link(a: list[int], b: list[int]) -> None:
        for i, j in zip(a, b, strict=True):
            p, q = find(i), find(j)
            if p != q:
                root[max(p, q)] = min(p, q)
                left.append(i)
                right.append(j)

    start = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    end = np.concatenate([start[1:], [n]])
    reach = np.repeat(end, end - start)
    at = np.arange(n)
    lag = 0
    while True:
        lag += 1
        at = at[reach[at] - at > lag]
        if not len(at):
            return left, right
        p = planes.near(planes.shifted(lag), at[root[at] != root[at + lag]], radius)
        if len(p):
            link(p.tolist(), (p + lag).tolist())
            flat()
        if lag % lags == 0:
            long = end - start > lag + 1
            rest = outsiders(root, start[long], end[long])
            if len(rest) <= (end - start).max() - lag:
                break
    first = np.repeat(start, end - start)
    for i in rest.tolist():
        a, b = int(first[i]), int(reach[i])
        p = planes.near(planes.against(x[i]), a + np.flatnonzero(root[a:b] != find(i)), radius)
        if len(p):
            link([i] * len(p), p.tolist())
            flat(a, b)
    return left, right


def near_members(keys, n, x, radius: int, lags: int = 32):
    """Which positions have another one of equal key within the radius whose set size n allows the similarity.

    Runs are compared at shifts 1, 2, ... together; pairs of which both are known already are masked out. Members that are still
    alone after `lags` shifts, and after as many again and again, are compared with their whole run if they are fewer
    than the shifts to come.
    """
    import numpy as np

    planes, found = Planes(x), np.zeros(len(x), bool)
    fit = lambda p, q: LEAST[1] * np.minimum(n[p], n[q]) >= LEAST[0] * np.maximum(n[p], n[q])
    start = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    end = np.concatenate([start[1:], [len(x)]])
    first, reach = np.repeat(start, end - start), np.repeat(end, end - start)
    at, lag = np.arange(len(x)), 0
    while True:
        lag += 1
        at = at[reach[at] - at > lag]
        if not len(at):
            return found
        p = at[~(found[at] & found[at + lag])]
        p = planes.near(planes.shifted(lag), p[fit(p, p + lag)], radius)
        found[p] = found[p + lag] = True
        if lag % lags == 0:
            rest = np.flatnonzero(~found & (reach - first > lag + 1))
            if len(rest) <= (end - start).max() - lag:
                break
    for i in rest.tolist():
        q = np.arange(first[i], reach[i])
        q = q[q != i]
        q = planes.near(planes.against(x[i]), q[fit(np.full(len(q), i), q)], radius)
        if len(q):
            found[i] = found[q] = True
    return found


def similar_links(n, shingles):
    """Links (i, j) that join all sets (n shingles each, one after the other, no repeats within a set) at Jaccard similarity LEAST or more, exactly.

    Common shingles of one set with all others come from the lists of sets that hold each shingle.
    """
    import numpy as np

    m, ends = len(n), np.concatenate([[0], np.cumsum(n)])
    _, code, held = np.unique(shingles, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), n)[np.argsort(code, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(held)])
    root = np.arange(m)
    out = []
    for i in range(m - 1):
        if (root[i + 1 :] == root[i]).all():
            continue
        own = code[ends[i] : ends[i + 1]]
        size = held[own]
        places = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        common = np.bincount(owner[places], minlength=m)
        for j in (i + 1 + np.flatnonzero(LEAST[1] * common[i + 1 :] >= LEAST[0] * (n[i] + n[i + 1 :] - common[i + 1 :]))).tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def _by_run(found):
    """Rows (k, columns) sorted by k -> the batches of found(k, columns) over whole runs of k. The last run of a batch waits for the next one."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        held, size = [], 0
        for batch in batches:
            k, *cols = (batch.column(i).to_numpy() for i in range(batch.num_columns))
            x = cols[0] if len(cols) == 1 else np.stack(cols, axis=1)
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))
            if held and held[-1][0][-1] == k[-1] and held[-1][0][0] == k[-1] or size + cut < 50_000:
                held.append((k, x))
                size += len(k)
                continue
            k, x = (np.concatenate([*(h[i] for h in held), v]) for i, v in enumerate((k, x)))
            cut = int(np.searchsorted(k, k[-1]))
            yield from found(k[:cut], x[:cut])
            held, size = [(k[cut:], x[cut:])], len(k) - cut
        if held:
            yield from found(*(np.concatenate([h[i] for h in held]) for i in range(2)))

    return run


def _link_batch(left, right):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _links(radius: int = RADIUS):
    """Rows (k, node, then any signature words) sorted by k, then node -> links (a, b) of nodes.

    Without signature words the node is the fingerprint itself.
    """

    def found(k, x):
        import numpy as np

        node = x if x.ndim == 1 else x[:, 0]
        left, right = bucket_links(k, (x if x.ndim == 1 else x[:, 1:]).copy().view(np.uint64), radius=radius) if len(k) > 1 else ([], [])
        yield _link_batch(node[left], node[right])

    return _by_run(found)


def _near_nodes(radius: int):
    """Rows (k, node, set size, signature words) sorted by k -> (k, node) of near_members."""

    def found(k, x):
        import pyarrow as pa

        on = near_members(k, x[:, 1], x[:, 2:].copy().view("uint64"), radius)
        yield pa.RecordBatch.from_arrays([pa.array(k[on]), pa.array(x[on, 0].copy())], ["k", "node"])

    return _by_run(found)


#: Members of a bucket that one task compares.
BUCKET = 4096


def _parts(width: int) -> list[tuple[int, int]]:
    """Four parts (low bit, high bit) of `width` bits."""
    cuts = [-(-width * i // 4) for i in range(5)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _ones(n: int) -> int:
    return (1 << n) - 1


def _bits(c, low: int, high: int):
    return F.shiftrightunsigned(c, low).bitwiseAND(_ones(high - low))


def block_buckets(nodes: DataFrame) -> DataFrame:
    """(k, fp, rest): ten rows a fingerprint, keyed by two of its five blocks; rest has the bits of the other three."""
    rows = []
    for j, (p, q) in enumerate(PAIRS):
        k = F.lit(j << 26).cast("bigint").bitwiseOR(F.shiftleft(_bits("fp", *BLOCKS[p]), 13)).bitwiseOR(_bits("fp", *BLOCKS[q]))
        rest, at = F.lit(0).cast("bigint"), 0
        for i in sorted({0, 1, 2, 3, 4} - {p, q}):
            rest = rest.bitwiseOR(F.shiftleft(_bits("fp", *BLOCKS[i]), at))
            at += BLOCKS[i][1] - BLOCKS[i][0]
        rows.append(F.struct(k.alias("k"), rest.alias("rest")))
    return nodes.select("fp", F.explode(F.array(*rows)).alias("b")).select("b.k", "fp", "b.rest")


def smaller_buckets(buckets: DataFrame, width: int) -> DataFrame:
    """Four rows a row of (k, fp, rest of width bits): keyed by one of four parts of the rest too, which goes out of the rest."""
    rows = []
    for i, (low, high) in enumerate(_parts(width)):
        rest = F.col("rest").bitwiseAND(_ones(low)).bitwiseOR(F.shiftleft(F.shiftrightunsigned("rest", high), low))
        rows.append(F.struct(F.xxhash64("k", F.lit(i), _bits("rest", low, high)).alias("k"), rest.alias("rest")))
    return buckets.select("fp", F.explode(F.array(*rows)).alias("b")).select("b.k", "fp", "b.rest")


def fingerprint_links(nodes: DataFrame, most: int = BUCKET) -> DataFrame:
    """(a, b) with a < b: links that connect all distinct fingerprints (column fp) at distance 3 or less."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pending, width, buckets = block_buckets(nodes), 39, None
    while width > 14:
        large = keep(pending.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > most).select("k"), "large-buckets")
        if large.isEmpty():
            break
        fits = pending.join(large.hint("shuffle_hash"), "k", "left_anti")
        buckets = fits if buckets is None else buckets.unionByName(fits)
        pending = keep(smaller_buckets(pending.join(large.hint("shuffle_hash"), "k", "left_semi"), width), "smaller-buckets")
        width -= min(high - low for low, high in _parts(width))
    buckets = pending if buckets is None else buckets.unionByName(pending)
    links = buckets.select("k", "fp").repartition(parts, "k").sortWithinPartitions("k", "fp").mapInArrow(_links(), "a bigint, b bigint")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges (a, b): root is one node of its component, the same on every run.

    Round: nodes get a seeded random rank, each takes the node of lowest rank among itself and its neighbours as
    its parent, edges are rewritten to parents, loops and repeats go. As ranks are random, nodes in play fall
    by a constant share a round, on paths and stars alike. The parent tables are composed from the last
    round back.
    """
    rounds: list[DataFrame] = []
    edges = keep(edges, name)
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, r=len(rounds): F.struct(F.xxhash64(F.lit(r), F.col(c)), F.col(c).alias("v"))
        parent = keep(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least(rank("a"), F.col("m"))["v"].alias("p")), name)
        rounds.append(parent)
        left = edges.join(parent.select("a", F.col("p").alias("pa")).hint("merge"), "a")
        right = left.join(parent.select(F.col("a").alias("b"), F.col("p").alias("pb")).hint("merge"), "b")
        edges = keep(right.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), name)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def compose(later: DataFrame, earlier: DataFrame) -> DataFrame:
        step = earlier.select(F.col("a").alias("node"), "p")
        return step.join(later.select(F.col("node").alias("p"), "root").hint("merge"), "p", "left").select("node", F.coalesce("root", "p").alias("root"))

    last = rounds[-1].select(F.col("a").alias("node"), F.col("p").alias("root"))
    return reduce(compose, reversed(rounds[:-1]), last)


def _classes(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (with node) joined to class_id (one node of the component, by roots: node, root) and component_id (its smallest doc_id)."""
    classes = nodes.join(roots.select("node", "root").hint("merge"), "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("class_id"))
    # Written out, so that the join below stands on plain exchanges and a large class can be split.
    classes = keep(classes, "fingerprint-class-ids")
    smallest = keep(classes.groupBy("class_id").agg(F.min("first_id").alias("component_id")), "fingerprint-smallest")
    named = keep(classes.join(smallest.hint("merge"), "class_id").select("node", "class_id", "component_id"), "fingerprint-classes")
    # A node that many rows share is one large key on the left only, which adaptive execution splits.
    return rows.join(named.hint("merge"), "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, th, fingerprint (hex), class_id (one fingerprint of the component), component_id."""
    rows = keep(fingerprint_rows(docs, id_col, text_col), "fingerprints").withColumnRenamed("fp", "node")
    nodes = keep(rows.groupBy("node").agg(F.min("doc_id").alias("first_id")), "fingerprint-nodes")
    links = fingerprint_links(nodes.select(F.col("node").alias("fp")))
    found = _classes(rows, nodes, keep(components(links), "fingerprint-roots"))
    return found.select("doc_id", "th", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "class_id", "component_id")


def sketch_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(doc_id, th, node, n, s0..s3, bands) over whole texts: a hash of the set of shingle hashes (node), the set's size, its 256-bit SimHash and
    MinHash band keys. Repeats of a shingle count once. No shuffle."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        def rows(batch, at: int, sets: list) -> pa.RecordBatch:
            x, n = np.concatenate(sets), np.array([len(s) for s in sets], np.int64)
            node = np.array([xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            y = wide_sketch(x, n).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(y[:, WORDS:].ravel()))
            cols = [*(batch.column(i).slice(at, len(n)) for i in range(2)), pa.array(node), pa.array(n), *(pa.array(np.ascontiguousarray(y[:, i])) for i in range(WORDS))]
            return pa.RecordBatch.from_arrays([*cols, bands], ["doc_id", "th", "node", "n", *(f"s{i}" for i in range(WORDS)), "bands"])

        for batch in batches:
            at, sets, size = 0, [], 0
            for data in slices(batch.column(2)):
                sets.append(np.unique(np.array(shingle_hashes(data, shingle), np.uint64)))
                size += len(sets[-1])
                if size > 200_000:
                    yield rows(batch, at, sets)
                    at, sets, size = at + len(sets), [], 0
            if sets:
                yield rows(batch, at, sets)

    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("t"))
    return d.mapInArrow(run, "doc_id bigint, th bigint, node bigint, n bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, bands array<bigint>")


def node_texts(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, t) of the asked nodes (node, rep_id, rep_th: the row that stands for it). Once for each row of that doc_id and text."""
    slot, bit = F.col("th").bitwiseAND((1 << 18) - 1), F.shiftrightunsigned("th", 18).bitwiseAND(63).cast("int")
    # 2**24 bits, whatever the data's size, keep most texts that are not asked for out of the shuffle.
    bits = asked.select(F.col("rep_th").alias("th")).groupBy(slot.alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits"))
    d = docs.select(F.col(id_col).cast("bigint").alias("i"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    d = d.withColumn("slot", slot).join(F.broadcast(bits), "slot").where(F.call_function("shiftrightunsigned", F.col("bits"), bit).bitwiseAND(1) == 1)
    return d.select("i", "th", "t").join(asked.hint("shuffle_hash"), F.col("i").eqNullSafe(F.col("rep_id")) & (F.col("th") == F.col("rep_th"))).select("node", "t")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 72, chunk: int = CHUNK, least: tuple[int, int] = LEAST) -> DataFrame:
    """doc_id, th, class_id, component_id: components of the pairs whose sets of 5-word shingles have Jaccard similarity 0.8 (`least`) or more.

    Null, empty and blank texts have the empty set and are one node; texts of fewer than five words have one shingle of all. Repeated rows give repeated
    rows; component_id is the smallest doc_id, null only if all its rows have none. Extra columns are not read.

    1. Equal sets are one node. Buckets come from 21 MinHash bands of three: a pair at 0.8 meets in none with probability 3e-7.
    2. In each bucket the members that have another one within `radius` of 256 SimHash bits are found with the bit-sliced counters, as a filter only: a
       pair at 0.8 differs in 39 bits (standard deviation 6; 48 if the sets are of four and five shingles). Only these members leave
       it. Members of a bucket of over `chunk` all do, unfiltered, so no bucket is compared with itself in more than one task.
    3. The members' texts are joined exactly by the n-gram join (rare-first prefixes, verified pairs), which cuts its own buckets and never holds one whole.
    """
    from .ngramjoin import jaccard_classes

    sign = [f"s{i}" for i in range(WORDS)]
    rows = keep(sketch_rows(docs, id_col, text_col, shingle), "sketches")
    # One row a node, so copies cost nothing.
    nodes = keep(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first(F.struct(F.col("doc_id").alias("rep_id"), F.col("th").alias("rep_th"), "n", *sign, "bands")).alias("x")).select("node", "first_id", "x.*"), "sketch-nodes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = nodes.select("node", "n", *sign, F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("k"), "node", "n", *sign)
    large = keep(keyed.groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") > chunk).select("k"), "large-bands")
    some = large.isEmpty()
    small = keyed if some else keyed.join(large.hint("shuffle_hash"), "k", "left_anti")
    dealt = small.select("k", "node", "n", *sign).repartition(parts, "k").sortWithinPartitions("k", "node")
    near = dealt.mapInArrow(_near_nodes(radius), "k bigint, node bigint").select("node")
    if not some:
        near = near.unionByName(keyed.join(large.hint("shuffle_hash"), "k", "left_semi").select("node"))
    near = keep(near.distinct(), "near-nodes")
    asked = keep(nodes.join(near.hint("merge"), "node", "left_semi").select("node", "rep_id", "rep_th"), "near-asked")
    texts = keep(node_texts(docs, asked, id_col, text_col), "near-texts")
    roots = jaccard_classes(texts, "node", "t", shingle, least).where("component_id IS NOT NULL").select(F.col("doc_id").alias("node"), F.col("component_id").alias("root")).distinct()
    roots = keep(roots, "near-roots")
    return _classes(rows.select("doc_id", "th", "node"), nodes.select("node", "first_id"), roots).select("doc_id", "th", "class_id", "component_id")


def keep_first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near=near_duplicates) -> DataFrame:
    """One row of each component of near_duplicates or near_copies, the one of its smallest doc_id (a null doc_id only where there is no other; of
    rows with one doc_id, the smallest text hash), with the columns of docs."""
    best = near(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    best = keep(best.groupBy("class_id").agg(F.min(F.struct("doc_id", "th")).alias("r"), F.count("*").alias("n")), "kept-ids")
    best = best.select("r.*", "n")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    row = row.select("row", F.xxhash64(F.col("row")[text_col]).alias("th"))
    on = lambda b: [row["row"][id_col].eqNullSafe(b["doc_id"]), row["th"] == b["th"]]
    sure, twice = best.where("n = 1"), best.where("n > 1")
    out = row.join(sure.hint("shuffle_hash"), on(sure), "left_semi").select("row.*")
    if twice.isEmpty():
        return out
    # Rows that share doc_id and text: one of each, by a group as large as its repeats.
    more = row.join(twice.hint("shuffle_hash"), on(twice), "left_semi").withColumn("i", F.col("row")[id_col]).dropDuplicates(["i", "th"]).select("row.*")
    return out.unionByName(more)
