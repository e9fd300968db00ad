"""Source divergence audit (operator 11): how far the sources of a language differ in their words, by a minimal-perfect-hash recount.

1. Exact frequency filter: a map counts each text's distinct terms by language, the counts are summed, and terms of at least LEAST documents are kept.
2. The kept terms are dealt to shards by hash, and each shard becomes a minimal perfect hash on an executor: levels of bit arrays, where keys that are
   alone at their bit leave, and the rank of the bit is the slot. Beside it lie the keys themselves, by slot.
3. Recount: a map over the texts asks the shards for each distinct term of a batch, compares the stored key, and adds to dense counters, an array over all slots
   of the language for each (language, source) that the task meets. Only counters by slot, no terms, are shuffled.
   The shards are broadcast only if their keys, counted first, have at most BROADCAST bytes; beyond that counts by term are joined with the kept
   terms instead (`counts_by_join`), with equal rows.
4. A slot's counts in all groups meet in one task, as rows by group. Sums over terms are kept by pair of sources in the task; terms that neither of two
   sources has are a number times one value, as are those that only one has, so the work of a term is its sources times all sources.

All arithmetic is on integers. Shares are p = 1 + floor(10**9 (count + 2) / (N + 2 V)), in steps of three digits, so nothing overflows below 9e15 words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, slices

LEAST = 10
TOP = 10
#: Bytes of kept terms, with 48 for each, up to which the shards are broadcast; keys of a shard, about.
BROADCAST = 64 << 20
SHARD = 1 << 15
BLOCK = 4096
UNIT = 10**9
#: Bytes to terms: A-Z lower-cased, other ASCII but letters to spaces.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(data: bytes) -> list[bytes]:
    return data.translate(_TERMS).split()


def key_hash(lang: bytes, term: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(lang + b"\0" + term, 11)


# --- minimal perfect hashes ----------------------------------------------------------------------


def _level(h, i: int):
    """Another hash of the hashes, for level i."""
    import numpy as np

    x = (h + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Slots 0 .. n-1 for n byte strings, with the strings by slot. Strings whose 64-bit hashes are equal are told apart by a plain list at the end."""

    def __init__(self, levels: list, keys: list[bytes], rest: dict[bytes, int]):
        import numpy as np

        self.levels, self.keys, self.rest = levels, keys, rest
        self.ranks, at = [], 0
        for bits in levels:
            self.ranks.append(at + np.concatenate([[0], np.cumsum(bits)]))
            at += int(bits.sum())

    @classmethod
    def build(cls, keys: list[bytes], hashes) -> PerfectHash:
        """keys are distinct; hashes: their uint64 hashes."""
        import numpy as np

        left, levels, order = np.arange(len(keys)), [], []
        while len(left) and len(levels) < 40:
            size = 2 * len(left)
            at = (_level(hashes[left], len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            on = alone[at]
            order += left[on][np.argsort(at[on])].tolist()
            left = left[~on]
        by_slot = [keys[i] for i in order]
        rest = {keys[i]: len(by_slot) + j for j, i in enumerate(left.tolist())}
        return cls(levels, by_slot + list(rest), rest)

    def slots(self, keys: list[bytes], hashes):
        """The slot of each key, -1 for those that are not stored."""
        import numpy as np

        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for i, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (_level(hashes[todo], i) % np.uint64(len(bits))).astype(np.int64)
            on = bits[at]
            out[todo[on]] = rank[at[on]]
            todo = todo[~on]
        for i in np.flatnonzero(out >= 0).tolist():
            if self.keys[out[i]] != keys[i]:
                out[i] = -1
        if self.rest:
            for i in np.flatnonzero(out < 0).tolist():
                out[i] = self.rest.get(keys[i], -1)
        return out

    def dump(self) -> bytes:
        import pickle

        import numpy as np

        return pickle.dumps(([(len(b), np.packbits(b).tobytes()) for b in self.levels], b"\n".join(self.keys), len(self.rest)))

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        import pickle

        import numpy as np

        levels, keys, more = pickle.loads(data)  # noqa: S301  written by dump
        keys = keys.split(b"\n") if keys else []
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for n, b in levels]
        return cls(bits, keys, {k: len(keys) - more + j for j, k in enumerate(keys[len(keys) - more :])} if more else {})


class Shards:
    """All shards of all languages; slots are numbered through a language, shard by shard."""

    def __init__(self, shards: int, rows: list[tuple[bytes, int, bytes]]):
        self.shards, self.tables, self.first, self.size = shards, {}, {}, {}
        for lang, k, data in sorted(rows, key=lambda r: r[:2]):
            t = PerfectHash.load(data)
            self.tables[lang, k], self.first[lang, k] = t, self.size.get(lang, 0)
            self.size[lang] = self.size.get(lang, 0) + len(t.keys)

    def slots(self, lang: bytes, found: list[bytes]):
        import numpy as np

        h = np.array([key_hash(lang, t) for t in found], np.uint64)
        shard = (h >> np.uint64(33)) % np.uint64(self.shards)
        out = np.full(len(found), -1, np.int64)
        for k in np.unique(shard).tolist():
            if t := self.tables.get((lang, k)):
                at = np.flatnonzero(shard == k)
                s = t.slots([found[i] for i in at.tolist()], h[at])
                out[at] = np.where(s >= 0, s + self.first[lang, k], -1)
        return out


# --- the two passes ------------------------------------------------------------------------------


def _groups(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))), F.col(text_col).cast("binary").alias("t"))


def _batches(batch):
    """Row numbers of the batch by (lang, source), both as bytes."""
    by: dict = {}
    for i, k in enumerate(zip(slices(batch.column(0)), slices(batch.column(1)), strict=True)):
        by.setdefault(k, []).append(i)
    return by, slices(batch.column(2))


def _document_counts(most: int = 400_000):
    """(lang, source, t) -> (lang, term, n): texts with the term, in parts."""

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        held: dict = {}

        def out():
            for lang, c in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.binary()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["lang", "term", "n"])

        for batch in batches:
            by, texts = _batches(batch)
            for (lang, _), rows in by.items():
                c = held.setdefault(lang, Counter())
                for i in rows:
                    c.update(set(terms(texts[i])))
                    if len(c) > most:
                        yield from out()
                        held = {}
                        c = held.setdefault(lang, Counter())
            if sum(map(len, held.values())) > most:
                yield from out()
                held = {}
        yield from out()

    return run


def kept_terms(groups: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term), both binary: the terms of at least `least` documents of the language."""
    counts = groups.mapInArrow(_document_counts(), "lang binary, term binary, n bigint")
    return counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


def _build(shards: int):
    """(lang, shard, term) sorted -> (lang, shard, data) of each shard."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, key = [], None

        def made():
            t = PerfectHash.build(held, np.array([key_hash(key[0], x) for x in held], np.uint64))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.binary()), pa.array([key[1]], pa.int64()), pa.array([t.dump()], pa.binary())], ["lang", "shard", "data"])

        for batch in batches:
            for lang, shard, term in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != (lang, shard):
                    if held:
                        yield made()
                    held, key = [], (lang, shard)
                held.append(term)
        if held:
            yield made()

    return run


def _shard_of(shards: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lang, term = batch.column(0), batch.column(1)
            k = [(key_hash(a, b) >> 33) % shards for a, b in zip(lang.to_pylist(), term.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([lang, pa.array(k, pa.int64()), term], ["lang", "shard", "term"])

    return run


def _recount(shared, most: int = 8 << 20):
    """(lang, source, t) -> (lang, source, block, data): occurrences of kept terms, from dense counters of at most `most` slots in all, then anew.

    A row has the counters of BLOCK slots that are not 0, packed: places in the block (uint16), then counts (int64).
    """

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        shards = Shards(*shared.value)
        known: dict = {}  # lang -> term -> slot
        counters: dict = {}

        def out():
            rows = []
            for (lang, source), x in counters.items():
                at = np.flatnonzero(x)
                cuts = np.searchsorted(at, np.arange(0, len(x) + BLOCK, BLOCK))
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    own = at[cuts[k] : cuts[k + 1]]
                    rows.append((lang, source, k, (own - k * BLOCK).astype(np.uint16).tobytes() + x[own].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["lang", "source", "block", "data"])

        for batch in batches:
            by, texts = _batches(batch)
            for (lang, source), rows in by.items():
                size = shards.size.get(lang, 0)
                if not size:
                    continue
                slot_of = known.setdefault(lang, {})
                for at in range(0, len(rows), 256):
                    c: Counter = Counter()
                    for i in rows[at : at + 256]:
                        c.update(terms(texts[i]))
                    if len(slot_of) > 500_000:
                        slot_of.clear()
                    new = [t for t in c if t not in slot_of]
                    if new:
                        slot_of.update(zip(new, shards.slots(lang, new).tolist(), strict=True))
                    slot = np.fromiter(map(slot_of.__getitem__, c), np.int64, len(c))
                    n = np.fromiter(c.values(), np.int64, len(c))
                    if (lang, source) not in counters:
                        if sum(map(len, counters.values())) + size > most and counters:
                            yield from out()
                            counters.clear()
                        counters[lang, source] = np.zeros(size, np.int64)
                    on = slot >= 0
                    counters[lang, source][slot[on]] += n[on]
        yield from out()

    return run


def _added(batches: Iterator) -> Iterator:
    """(lang, source, block, data) sorted by the first three -> (lang, source, slot, n), summed."""
    import numpy as np
    import pyarrow as pa

    key, total = None, None

    def out():
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(at), pa.binary()), pa.array([key[1]] * len(at), pa.binary()), pa.array(at + key[2] * BLOCK), pa.array(total[at])], ["lang", "source", "slot", "n"])

    for batch in batches:
        for lang, source, k, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if key != (lang, source, k):
                if key is not None:
                    yield out()
                key, total = (lang, source, k), np.zeros(BLOCK, np.int64)
            n = len(data) // 10
            total[np.frombuffer(data, np.uint16, n)] += np.frombuffer(data, np.int64, n, 2 * n)
    if key is not None:
        yield out()


def _term_counts(most: int = 400_000):
    """(lang, source, t) -> (lang, source, term, n) in parts."""

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        held: dict = {}

        def out():
            for (lang, source), c in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.binary()), pa.array([source] * len(c), pa.binary()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["lang", "source", "term", "n"])

        for batch in batches:
            by, texts = _batches(batch)
            for k, rows in by.items():
                for i in rows:
                    held.setdefault(k, Counter()).update(terms(texts[i]))
                    if len(held[k]) > most:
                        yield from out()
                        held = {}
            if sum(map(len, held.values())) > most:
                yield from out()
                held = {}
        yield from out()

    return run


def counts_by_join(groups: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source, slot, n) where n > 0, and (lang, slot, term), all names binary: with a join on the term instead of a broadcast. Slots are row numbers with gaps."""
    names = keep(kept.withColumn("slot", F.monotonically_increasing_id()), "audit-names")
    counts = groups.mapInArrow(_term_counts(), "lang binary, source binary, term binary, n bigint").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return counts.join(names.hint("merge"), ["lang", "term"]).select("lang", "source", "slot", "n"), names.select("lang", "slot", "term")


def counts_by_hash(groups: DataFrame, kept: DataFrame, n_kept: int) -> tuple[DataFrame, DataFrame]:
    """The same through perfect hashes."""
    spark = groups.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, n_kept // SHARD)
    dealt = kept.mapInArrow(_shard_of(shards), "lang binary, shard bigint, term binary")
    built = keep(dealt.repartition(parts, "lang", "shard").sortWithinPartitions("lang", "shard", "term").mapInArrow(_build(shards), "lang binary, shard bigint, data binary"), "audit-shards")
    rows = [(bytes(r.lang), r.shard, bytes(r.data)) for r in built.collect()]  # at most BROADCAST bytes of keys, checked by the caller
    shared = spark.sparkContext.broadcast((shards, rows))
    packed = groups.mapInArrow(_recount(shared), "lang binary, source binary, block bigint, data binary")
    counts = packed.repartition(parts, "lang", "source", "block").sortWithinPartitions("lang", "source", "block").mapInArrow(_added, "lang binary, source binary, slot bigint, n bigint")

    def named(batches: Iterator) -> Iterator:
        import pyarrow as pa

        s = Shards(*shared.value)
        for batch in batches:
            for lang, k in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                t, first = s.tables[lang, k].keys, s.first[lang, k]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(t), pa.binary()), pa.array(range(first, first + len(t)), pa.int64()), pa.array(t, pa.binary())], ["lang", "slot", "term"])

    return counts, built.select("lang", "shard").mapInArrow(named, "lang binary, slot bigint, term binary")


# --- shares and divergences ----------------------------------------------------------------------


def share(n: str, total: str, v: str) -> str:
    """SQL for 1 + floor(10**9 (n + 2) / (total + 2 v)) on bigints, three digits at a time."""
    a, b = f"({n} + 2)", f"({total} + 2 * {v})"
    r1 = f"(({a} % {b}) * 1000)"
    r2 = f"(({r1} % {b}) * 1000)"
    r3 = f"(({r2} % {b}) * 1000)"
    return f"(1 + ({a} div {b}) * {UNIT} + ({r1} div {b}) * 1000000 + ({r2} div {b}) * 1000 + ({r3} div {b}))"


def divergence(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def _pair_sums(most: int = 4 << 20):
    """Rows (lang, term, source numbers, shares there) and the shares of absent terms by source (base, all groups of the language in one list) ->
    (lang, a, b, value): sums over the task's terms of f between a source a with the term and each other source b, a < b or b without the term, less what the
    formula for absent terms would give; so the caller adds V times that of absent terms."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums: dict = {}

        def f(p, q):
            return (p - q) * (p - q) // (p + q)

        def out():
            for lang, x in sums.items():
                i, j = np.nonzero(x)
                on = i < j
                i, j = i[on], j[on]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i), pa.array(j), pa.array(x[i, j])], ["lang", "a", "b", "value"])

        for batch in batches:
            for lang, at, p, base in zip(*(batch.column(i) for i in range(4)), strict=True):
                lang, at, p, base = lang.as_py(), at.values.to_numpy(), p.values.to_numpy(), base.values.to_numpy()
                if lang not in sums:
                    if sum(x.size for x in sums.values()) + len(base) ** 2 > most and sums:
                        yield from out()
                        sums.clear()
                    sums[lang] = np.zeros((len(base), len(base)), np.int64)
                here = base.copy()
                here[at] = p
                more = f(p[:, None], here[None, :]) - f(base[at][:, None], base[None, :])
                sums[lang][at] += more
                rest = np.ones(len(base), bool)
                rest[at] = False
                sums[lang][np.ix_(rest, at)] += more[:, rest].T
        yield from out()

    return run


def _with(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """rows (with a slot) joined to a table of groups or languages. A copy of that table goes to each of so many parts, so that one language's rows are spread by slot."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("slot"), F.lit(parts)).cast("int")).join(small.hint("shuffle_hash"), [*on, "salt"]).drop("salt")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST, top: int = TOP, broadcast: int = BROADCAST) -> DataFrame:
    """lang, source, part, item, value, rank: for each group (lang, source) its divergence from every other source of the language (part `pair`), and the `top`
    terms that it has more often than the language as a whole (part `term`).

    Null language, source and text are empty strings; an empty string is a group like any other. A group without terms, or a language without kept terms, has its pairs:
    with value 0 if the language keeps no term. Repeated rows count as often as they occur; ties go by the item's UTF-8 bytes. An empty table gives no rows. Extra columns
    are not read.
    """
    groups = _groups(docs, lang_col, source_col, text_col)
    kept = keep(kept_terms(groups, least), "audit-kept")
    size = kept.agg(F.count("*").alias("n"), F.sum(F.length("term") + F.length("lang") + 48).alias("b")).first()
    counts, names = counts_by_hash(groups, kept, size.n) if (size.b or 0) <= broadcast else counts_by_join(groups, kept)
    text = lambda c: F.decode(c, "utf-8").alias(c)
    counts = keep(counts.select(text("lang"), text("source"), "slot", "n"), "audit-counts")
    v = kept.groupBy(text("lang")).agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = keep(groups.select("lang", "source").distinct(), "audit-groups")
    known = known.join(totals.hint("merge"), ["lang", "source"], "left").join(v.hint("merge"), "lang", "left")
    known = known.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    # The sources of a language in one list: as long as its groups, of which the pairs of the result are the square.
    known = known.withColumn("base", F.when(F.col("v") > 0, F.expr(share("0L", "total", "v"))).otherwise(F.lit(0).cast("bigint")))
    known = keep(known.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "audit-totals")
    whole = keep(known.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.max("v").alias("v"), F.sort_array(F.collect_list(F.struct("k", "base"))).getField("base").alias("bases")), "audit-langs")
    placed = _with(counts, known.select("lang", "source", "total", "v", "k"), ["lang", "source"])
    placed = keep(placed.withColumn("p", F.expr(share("n", "total", "v"))), "audit-shares")
    by_term = placed.groupBy("lang", "slot").agg(F.collect_list(F.struct("k", "p")).alias("x"))
    parts = _with(by_term, whole.select("lang", "bases"), ["lang"]).select("lang", F.col("x.k").alias("at"), "x.p", "bases")
    sums = parts.mapInArrow(_pair_sums(), "lang string, a bigint, b bigint, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("more"))
    one, two = (known.select("lang", F.col("k").cast("bigint").alias(c), F.col("source").alias(s), F.col("base").alias(b), *more) for c, s, b, more in (("i", "source", "pb", ("v",)), ("j", "item", "qb", ())))
    pairs = one.join(two.hint("shuffle_hash"), "lang").where("i <> j").withColumns({"a": F.least("i", "j"), "b": F.greatest("i", "j")})
    absent = F.when(F.col("v") > 0, F.col("v") * F.expr(divergence("pb", "qb"))).otherwise(F.lit(0).cast("bigint"))
    pairs = pairs.join(sums.hint("merge"), ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (absent + F.coalesce("more", F.lit(0))).alias("value"))
    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_rank))
    wide = counts.groupBy("lang", "slot").agg(F.sum("n").alias("lang_n"))
    wide = _with(wide, whole.select("lang", "lang_total", "v"), ["lang"])
    wide = wide.select("lang", "slot", F.expr(share("lang_n", "lang_total", "v")).alias("q"))
    own = placed.select("lang", "source", "slot", "p").join(wide.hint("merge"), ["lang", "slot"]).where("p > q").select("lang", "source", "slot", F.expr(divergence("p", "q")).alias("value"))
    # The first `top` values with all their ties get names; these settle the ties.
    own = own.withColumn("_r", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("_r") <= top)
    own = own.join(names.select(text("lang"), "slot", text("term")).hint("merge"), ["lang", "slot"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    own = own.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top)
    return pairs.unionByName(own)


#: Terms by the contract's pattern, for texts as str (tests and other readers).
PATTERN = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
