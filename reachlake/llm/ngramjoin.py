"""N-gram Jaccard join (operator 12): sets of 3-word shingles with a similarity of 0.9 or more, by rare-first prefix filtering.

1. A scan of the whole texts gives a row per document (a hash of its set, the set's size) and counts all shingles in SLOTS slots, a table of one
   fixed size that is broadcast. Equal sets are one node.
2. A second scan sorts each set rare-first (slot count, then hash: one order for all sets) and keeps its prefix: two sets of similarity t share a
   shingle of the first n - ceil(t n) + 1. Prefix rows meet on the shingle, in one shuffle of 32 bytes a row; nodes without a partner that
   passes the first two filters go at once, which leaves a few rows in a hundred.
3. Inside a shingle's bucket pairs pass the length filter (a window, as members are sorted by size), the positional filter (the first common shingle at
   places i and j leaves at most 1 + min(rest) common ones) and the suffix filter (counts of the set's shingles in CLASSES classes: the sum of
   their differences is at most the symmetric difference). All three are exact: no similar pair fails them in the bucket of its first common shingle.
4. First only pairs that join candidate components leave a bucket, at most one a member. They are verified on the whole sets, and true components
   follow. Then all pairs that pass the filters and are still in different components leave it, so each pair of texts is verified once at most and
   a group of near copies never becomes all its pairs. A bucket of over `chunk` members is cut in chunks: a few members go to all chunks in the
   first step; in the second those outside the bucket's largest component do, and its chunks need not meet each other.
5. Sets of the asked nodes only are made, in a third scan; intersections are counted in the JVM.

Shingles are 64-bit hashes of exact words, sets 64-bit hashes of these: two different ones agree with probability 5e-20 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, lower_ascii, slices
from .simhash import _classes, components

#: Least similarity as a fraction; slots of the frequency table; classes of the suffix filter; members of a bucket that meet in one task.
LEAST = (9, 10)
SLOTS = 1 << 18
BLOCK = 256
CLASSES = 256
CHUNK = 1024
ANCHORS = 16
_K = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_SPACE = [chr(i).isspace() and i < 128 and not 28 <= i <= 31 for i in range(256)]
_BASE = 0x2545F4914F6CDD1D
_tables: dict = {}


def _powers(n: int):
    """Powers of the base and of its inverse modulo 2**64, for n places at least, and a random word for each byte."""
    import numpy as np

    if len(_tables.get("up", ())) < n:
        size = max(1 << (n - 1).bit_length(), 1 << 21)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                _tables[name] = np.multiply.accumulate(x)
        _tables["byte"] = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_K[0]))
        _tables["space"] = np.array(_SPACE)
    return _tables["up"], _tables["down"], _tables["byte"], _tables["space"]


def word_hashes(data: bytes):
    """64-bit hashes of the words of lower-cased bytes, and where each word starts: polynomials modulo 2**64 over random byte values, then mixed."""
    import numpy as np

    up, down, byte, space = _powers(len(data))
    x = np.frombuffer(data, np.uint8)
    gap = np.concatenate([[True], space[x], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(byte[x] * up[: len(x)], out=total[1:])
    return _mixed((total[end] - total[start]) * down[start]), start


def _pieces(data: bytes, most: int) -> Iterator[bytes]:
    """Parts of about `most` bytes, cut before a space."""
    at = 0
    while len(data) - at > most:
        cut = max(data.find(b" ", at + most), 0) or len(data)
        yield data[at:cut]
        at = cut
    yield data[at:]


def shingle_sets(texts, size: int = 3, most: int = 1 << 20) -> Iterator:
    """For each text its sorted distinct shingle hashes (uint64): of all its words if there are fewer, none if it has none. Short texts are hashed together."""
    import numpy as np

    def sets(words):
        n = min(len(words), size)
        if not n:
            return np.zeros(0, np.uint64)
        x = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            x = _mixed(x * np.uint64(_K[0]) + words[i : len(words) - n + 1 + i] * np.uint64(_K[1]) + np.uint64(_K[2]))
        x.sort()
        return x[np.concatenate([[True], x[1:] != x[:-1]])]

    def pooled(pool):
        h, start = word_hashes(b" ".join(pool))
        cuts = np.searchsorted(start, np.cumsum([0, *(len(p) + 1 for p in pool)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield sets(h[a:b])

    pool, held = [], 0
    for data in texts:
        data = lower_ascii(data)
        if held + len(data) > most and pool:
            yield from pooled(pool)
            pool, held = [], 0
        if len(data) > most:
            yield sets(np.concatenate([word_hashes(p)[0] for p in _pieces(data, most)]))
        else:
            pool.append(data)
            held += len(data) + 1
    if pool:
        yield from pooled(pool)


def _node(x) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(x.tobytes(), 7)
    return h - (1 << 64) if h >> 63 else h


def _slot(x):
    import numpy as np

    return (x >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def prefix_size(n: int, least=LEAST) -> int:
    """Of a set of n: n - ceil(t n) + 1."""
    return n - -(-least[0] * n // least[1]) + 1


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("t"))


def _set_rows(size: int):
    """(doc_id, th, t) -> (doc_id, th, node, n, null, null) for each row, then (null, ..., block, counts) for the blocks of the slot table."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(SLOTS, np.int64)
        names = ["doc_id", "th", "node", "n", "block", "counts"]
        for batch in batches:
            node, n = [], []
            for x in shingle_sets(slices(batch.column(2)), size):
                np.add.at(total, _slot(x), 1) if len(x) < SLOTS // 4 else np.add(total, np.bincount(_slot(x), minlength=SLOTS), out=total)
                node.append(_node(x))
                n.append(len(x))
            k = len(node)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        used = total.reshape(-1, BLOCK)
        at = np.flatnonzero(used.any(axis=1))
        none = [pa.nulls(len(at), pa.int64()) for _ in range(4)]
        yield pa.RecordBatch.from_arrays([*none, pa.array(at, pa.int32()), pa.array([used[i].tobytes() for i in at.tolist()], pa.binary())], names)

    return run


def _sum_blocks(batches: Iterator) -> Iterator:
    """(block, counts) -> their sums by block."""
    import numpy as np
    import pyarrow as pa

    total: dict = {}
    for batch in batches:
        for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(data, np.int64)
            total[b] = total[b] + x if b in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "counts"])


def slot_counts(rows: DataFrame):
    """The slot table (numpy, SLOTS numbers) of the rows of _set_rows."""
    import numpy as np

    out = np.zeros((SLOTS // BLOCK, BLOCK), np.int64)
    blocks = rows.where("block is not null").select("block", "counts").repartition(16, "block").mapInArrow(_sum_blocks, "block int, counts binary")
    for r in blocks.collect():  # SLOTS numbers, whatever the data's size
        out[r.block] = np.frombuffer(r.counts, np.int64)
    return out.ravel()


def _prefixes(size: int, counts, least=LEAST):
    """(doc_id, th, t) -> (node, n, hist, prefix) once for each set of the task. hist: shingles by class, at most 255."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table, seen = counts.value, set()
        for batch in batches:
            node, n, hist, prefix = [], [], [], []
            for x in shingle_sets(slices(batch.column(2)), size):
                if not len(x) or (k := _node(x)) in seen:
                    continue
                seen.add(k)
                m = prefix_size(len(x), least)
                c = table[_slot(x)]
                if m < len(x):  # the m smallest, ties included, then in order
                    fit = np.flatnonzero(c <= np.partition(c, m - 1)[m - 1])
                    first = fit[np.argsort(c[fit], kind="stable")[:m]]
                else:
                    first = np.argsort(c, kind="stable")
                node.append(k)
                n.append(len(x))
                hist.append(np.minimum(np.bincount((x & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8).tobytes())
                prefix.append(x[first].view(np.int64))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefix])]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*prefix, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(hist, pa.binary()), lists], ["node", "n", "hist", "prefix"])

    return run


def candidates(n, pos, hist, root, every: bool, least=LEAST):
    """Pairs (i, j) of a bucket's members (sorted by n) with different root that pass the length, positional and suffix filters.

    Without `every` only pairs that join two groups of candidates: at most one fewer than there are roots.
    """
    import numpy as np

    p, q = least
    root = root.copy()
    h = hist.astype(np.int16)
    reach = np.searchsorted(n, q * n // p, side="right")
    left, right = [], []
    for i in range(len(n) - 1):
        j = np.arange(i + 1, reach[i])
        j = j[root[j] != root[i]]
        if not len(j):
            continue
        both = n[i] + n[j]
        j = j[(p + q) * (1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1) >= p * both]
        for a in range(0, len(j), 4096):
            k = j[a : a + 4096]
            k = k[(p + q) * np.abs(h[k] - h[i]).sum(axis=1, dtype=np.int64) <= (q - p) * (n[i] + n[k])]
            if not every and len(k):
                joined, at = np.unique(root[k], return_index=True)
                fresh = joined != root[i]
                joined, k = joined[fresh], k[at[fresh]]
                root[np.isin(root, joined)] = root[i]
            left += [i] * len(k)
            right += k.tolist()
        if not every and (root == root[0]).all():
            break
    return left, right


def partnered(n, pos, least=LEAST):
    """Which members of a bucket (sorted by n) have a partner that passes the length and the positional filter."""
    import numpy as np

    p, q = least
    found = np.zeros(len(n), bool)
    reach = np.searchsorted(n, q * n // p, side="right")
    for lag in range(1, int((reach - np.arange(len(n))).max()) if len(n) else 0):
        i = np.flatnonzero(np.arange(len(n)) + lag < reach)
        i = i[~(found[i] & found[i + lag])]
        on = i[(p + q) * np.minimum(n[i] - pos[i], n[i + lag] - pos[i + lag]) >= p * (n[i] + n[i + lag])]
        found[on] = found[on + lag] = True
        if found.all():
            break
    return found


def _buckets(chunk: int, least=LEAST):
    """Rows (token, n, node, pos) sorted by token, n, node -> each node of a token once, of tokens with more than one node; of those with at most `chunk` only nodes that
    have a partner. Longer runs pass through as they come, so no run is held whole."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def rows(x):
            return pa.RecordBatch.from_arrays([pa.array(v) for v in x], ["token", "n", "node", "pos"])

        def kept(x):
            """Of whole runs."""
            start = np.flatnonzero(np.concatenate([[True], x[0][1:] != x[0][:-1]]))
            size = np.diff(np.concatenate([start, [len(x[0])]]))
            on = np.repeat(size > 1, size)
            if (size == 2).any():  # two members, all at once
                i = start[size == 2]
                fit = (least[1] * x[1][i] >= least[0] * x[1][i + 1]) & (sum(least) * np.minimum(x[1][i] - x[3][i], x[1][i + 1] - x[3][i + 1]) >= least[0] * (x[1][i] + x[1][i + 1]))
                on[i] = on[i + 1] = fit
            for a, b in zip(start[size > 2].tolist(), (start + size)[size > 2].tolist(), strict=True):
                if b - a <= chunk:
                    on[a:b] = partnered(x[1][a:b], x[3][a:b], least)
            return [v[on] for v in x]

        held, long = None, False  # the last run so far; of a long one, whose rows are on their way, its last row
        for batch in batches:
            if not batch.num_rows:
                continue
            x = [batch.column(i).to_numpy() for i in range(4)]
            if held is not None:
                x = [np.concatenate([h, v]) for h, v in zip(held, x, strict=True)]
            new = np.concatenate([[True], (x[0][1:] != x[0][:-1]) | (x[2][1:] != x[2][:-1])])
            x = [v[new] for v in x]
            cut, first = int(np.searchsorted(x[0], x[0][-1])), 0
            if cut and long:
                first = int(np.searchsorted(x[0], x[0][0], side="right"))
                yield rows([v[1:first] for v in x])
                long = False
            if cut > first:
                yield rows(kept([v[first:cut] for v in x]))
            held = [v[cut:] for v in x]
            if long or len(held[0]) > chunk:
                yield rows([v[int(long) :] for v in held])
                held, long = [v[-1:] for v in held], True
        if held is not None and not long:
            yield rows(kept(held))

    return run


def _pairs_of(every: bool, least=LEAST):
    """Rows (token, chunk, n, node, pos, hist, root) sorted by token, chunk, n, node -> candidate pairs (a, b), a < b."""

    def found(x) -> tuple[list, list]:
        import numpy as np

        token, chunk, n, node, pos, hist, root = x
        new = np.flatnonzero((token[1:] != token[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        a_out, b_out = [], []
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(token)], strict=True):
            if b - a > 1:
                i, j = candidates(n[a:b], pos[a:b], hist[a:b], root[a:b], every, least)
                a_out.append(node[a:b][i])
                b_out.append(node[a:b][j])
        return np.concatenate(a_out) if a_out else np.zeros(0, np.int64), np.concatenate(b_out) if b_out else np.zeros(0, np.int64)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def links(x):
            a, b = found(x)
            for at in range(0, len(a), 1 << 20):
                u, v = a[at : at + (1 << 20)], b[at : at + (1 << 20)]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["a", "b"])

        held, size = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = [batch.column(i).to_numpy() for i in range(5)]
            hist = batch.column(5).cast(pa.large_binary())
            x.append(np.frombuffer(b"".join(hist.to_pylist()), np.uint8).reshape(-1, CLASSES))
            x.append(batch.column(6).to_numpy())
            if held is not None:
                x = [np.concatenate([u, v]) for u, v in zip(held, x, strict=True)]
            cut = np.flatnonzero((x[0] != x[0][-1]) | (x[1] != x[1][-1]))
            cut = int(cut[-1]) + 1 if len(cut) else 0  # the last bucket may go on
            if cut:
                yield from links([v[:cut] for v in x])
            held = [v[cut:] for v in x]
        if held is not None:
            yield from links(held)

    return run


def _deal(rows: DataFrame, parts: int) -> DataFrame:
    cols = ("token", "chunk", "n", "node", "pos", "hist", "root")
    return rows.select(*cols).repartition(parts, "token", "chunk").sortWithinPartitions("token", "chunk", "n", "node")


def verified(pairs: DataFrame, sets: DataFrame, least=LEAST) -> DataFrame:
    """The pairs (a, b) whose sets (node, shingles) have the similarity asked for, counted exactly."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    met = pairs.join(one.hint("shuffle_hash"), "a").join(two.hint("shuffle_hash"), "b")
    common = F.size(F.array_intersect("x", "y")).cast("bigint")
    return met.where(common * (least[0] + least[1]) >= (F.size("x") + F.size("y")).cast("bigint") * least[0]).select("a", "b")


def _asked_sets(size: int, bits):
    """(doc_id, th, t) -> (node, shingles) once a task for each set whose node the bit table knows."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        known, seen = bits.value, set()
        for batch in batches:
            node, out, total = [], [], 0

            def rows(node=node, out=out):
                ends = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in out])]), pa.int32())
                return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*out, np.zeros(0, np.int64)])))], ["node", "shingles"])

            for x in shingle_sets(slices(batch.column(2)), size):
                if not len(x) or (k := _node(x)) in seen:
                    continue
                at = k & ((1 << 24) - 1)
                if known[at >> 3] >> (at & 7) & 1:
                    seen.add(k)
                    node.append(k)
                    out.append(x.view(np.int64))
                    total += len(x)
                    if total > 500_000:
                        yield rows(node, out)
                        node, out, total = [], [], 0
            if node:
                yield rows(node, out)

    return run


def asked_sets(source: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the nodes asked for. 2**24 bits, whatever the data's size, keep most other sets out of the shuffle."""
    import numpy as np

    spark = source.sparkSession
    at = F.col("node").bitwiseAND((1 << 24) - 1)
    words = nodes.select(F.shiftright(at, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int")).alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))
    table = np.zeros(1 << 18, np.int64)
    for r in words.collect():  # at most 2**18 rows
        table[r.w] = r.v
    bits = spark.sparkContext.broadcast(table.view(np.uint8))
    rows = source.mapInArrow(_asked_sets(size, bits), "node bigint, shingles array<bigint>")
    return rows.join(nodes.select("node").hint("shuffle_hash"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _united(batches: Iterator) -> Iterator:
    """Edges (a, b) -> (node, root): root is the smallest node of the component."""
    import pyarrow as pa

    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in list(root)], pa.int64())], ["node", "root"])


def connected(edges: DataFrame, name: str, most: int = 1 << 20) -> DataFrame:
    """(node, root) of edges (a, b), written: by rounds of contraction, or in one task if there are at most `most` edges (some 100 bytes each)."""
    edges = keep(edges.select("a", "b"), name)
    if edges.count() <= most:
        return keep(edges.coalesce(1).mapInArrow(_united, "node bigint, root bigint"), name)
    return keep(components(edges, name), name)


def set_roots(source: DataFrame, rows: DataFrame, size: int = 3, least=LEAST, chunk: int = CHUNK) -> DataFrame:
    """(node, root): components of all sets at the similarity asked for or above; nodes without a link may be missing. source: (doc_id, th, t); rows: of _set_rows."""
    spark = source.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = spark.sparkContext.broadcast(slot_counts(rows))
    sets = keep(source.mapInArrow(_prefixes(size, counts, least), "node bigint, n bigint, hist binary, prefix array<bigint>"), "join-prefixes")
    tokens = sets.select("node", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "n", "node", F.col("pos").cast("bigint").alias("pos"))
    tokens = tokens.repartition(parts, "token").sortWithinPartitions("token", "n", "node")
    met = keep(tokens.mapInArrow(_buckets(chunk, least), "token bigint, n bigint, node bigint, pos bigint"), "join-met")
    nodes = keep(met.select("node").distinct(), "join-nodes")
    hists = sets.join(nodes.hint("shuffle_hash"), "node", "left_semi").groupBy("node").agg(F.first("hist").alias("hist"))
    met = met.join(hists.hint("merge"), "node")
    # Buckets of more than `chunk` members, with the number of their chunks.
    large = met.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > chunk).select("token", F.ceil(F.col("c") / chunk).cast("int").alias("m"))
    large = keep(large, "join-large")
    met = met.join(large.hint("shuffle_hash"), "token", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    met = keep(met.withColumn("home", F.pmod(F.xxhash64("node", F.lit(3)), F.col("m")).cast("int")), "join-buckets")

    def dealt(rows: DataFrame, everywhere) -> DataFrame:
        out = rows.where("m = 1").withColumn("chunk", F.lit(0))
        if large.isEmpty():
            return out
        many = rows.where("m > 1")
        home = many.where(~everywhere).withColumn("chunk", F.col("home"))
        return out.unionByName(home).unionByName(many.where(everywhere).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("m") - 1))))

    # First step: links that join candidates. About ANCHORS members of a bucket go to all its chunks, drawn by a hash.
    anchor = F.pmod(F.xxhash64("node", F.lit(5)), F.col("m") * chunk) < ANCHORS
    first = _deal(dealt(met.withColumn("root", F.col("node")), anchor), parts).mapInArrow(_pairs_of(False, least), "a bigint, b bigint").distinct()
    first = keep(first, "join-pairs-1")
    asked = keep(first.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "join-asked")
    shingles = keep(asked_sets(source, asked, size), "join-sets")
    roots = connected(verified(first, shingles, least), "join-roots-1")
    # Second step: members of a bucket in different components; the largest one of a large bucket stays in its chunks.
    rooted = keep(met.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), "join-rooted")
    open_ = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    rooted = rooted.join(open_.hint("shuffle_hash"), "token", "left_semi")
    if not large.isEmpty():
        tops = rooted.where("m > 1").groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("top"))
        rooted = rooted.join(tops.hint("shuffle_hash"), "token", "left")
    else:
        rooted = rooted.withColumn("top", F.lit(None).cast("bigint"))
    second = _deal(dealt(rooted, ~F.col("root").eqNullSafe(F.col("top"))), parts).mapInArrow(_pairs_of(True, least), "a bigint, b bigint").distinct()
    second = keep(second.join(first.hint("shuffle_hash"), ["a", "b"], "left_anti"), "join-pairs-2")
    if second.isEmpty():
        return roots
    more = keep(second.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(asked.hint("shuffle_hash"), "node", "left_anti"), "join-asked-2")
    if not more.isEmpty():
        shingles = shingles.unionByName(keep(asked_sets(source, more, size), "join-sets-2"))
    # Later links join components of the first step.
    links = verified(second, shingles, least)
    for c in ("a", "b"):
        links = links.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")).hint("shuffle_hash"), c, "left").withColumn(c, F.coalesce(f"r{c}", c))
    later = connected(links.select("a", "b").where("a <> b").distinct(), "join-roots-2")
    all_nodes = roots.unionByName(later.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min_by("root", F.col("node") == F.col("root")).alias("p"))
    return all_nodes.join(later.select(F.col("node").alias("p"), "root").hint("shuffle_hash"), "p", "left").select("node", F.coalesce("root", "p").alias("root"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, least=LEAST, chunk: int = CHUNK) -> DataFrame:
    """One row per document row: doc_id, th (hash of the text), n_shingles, class_id (one node of the component; null for empty sets), component_id.

    Null, empty and blank texts have the empty set and are linked with nothing; texts of fewer words than a shingle have one, the whole sequence. Repeated rows
    give repeated rows. component_id is the smallest doc_id of the component, null only where all its rows have none. Extra columns are not read.
    """
    source = _source(docs, id_col, text_col)
    schema = "doc_id bigint, th bigint, node bigint, n bigint, block int, counts binary"
    rows = keep(source.mapInArrow(_set_rows(size), schema), "join-rows")
    roots = keep(set_roots(source, rows, size, least, chunk), "join-roots")
    of_docs = rows.where("block is null").select("doc_id", "th", "node", "n")
    full = of_docs.where("n > 0")
    nodes = keep(full.groupBy("node").agg(F.min("doc_id").alias("first_id")), "join-firsts")
    found = _classes(full, nodes, roots)
    found = found.select("doc_id", "th", F.col("n").alias("n_shingles"), "class_id", "component_id")
    empty = of_docs.where("n = 0").select("doc_id", "th", F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("class_id"), F.col("doc_id").alias("component_id"))
    return found.unionByName(empty)
