"""LM scoring (operator 10): a bigram model in Elias-Fano tries, one trie a shard of the vocabulary.

Model. p(w | v) = (c(v w) + m(v) p(w)) / (c(v) + m(v)) with p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). It sums to one for
any positive m(v); m(v) = 0.6 * 2**class(v), where class is the rounded log2 of the training count of all words in v's
slot of a fixed table of 2**17 slots, so frequent words reserve mass as they gather new successors. The table's
size is fixed, so it is broadcast whatever the corpus.

The score of a text separates by word: a token w after v adds log(c(v w) + m(v) p(w)), which needs w's counts and one byte
about v, and as the context of the next token it takes away log(c(w) + m(w)). So everything is dealt by the word
scored, counted and scored in one place, and no table of words or bigrams is ever broadcast or collected:

1. Training words are counted by task, then by word (shuffle of distinct words a task); N, V and the slot table are
   sums over that. There is one shard for every SHARD_TOKENS tokens. Words with more than a share 1/(4 * shards) of all
   training tokens are at most 4 * shards; they are collected with their counts, and their tokens are dealt by
   (word, previous word) so that no word is a hot key.
2. `fit`: pairs of training texts are counted by batch of text, dealt to shards and merged there into a two-level trie
   (words, then previous words): keys of a level are made monotone by adding range bases and held as Elias-Fano sequences,
   range pointers are an Elias-Fano sequence too, and smoothed log probabilities are quantised to 16 bits. The
   tries are stored as a table in the shared folder; they score any documents, any number of times.
3. `score`: a pass over the texts sends every token to its shard: blocks with the distinct words of a batch, run lengths,
   document numbers and 40-bit hashes of previous words. A task gets a shard's trie as its first row, maps it from a
   file and scores one block after the other: memory is one trie and one block. A word's range is found by
   successor search among the words, then the previous word's place relative to that range. Searches work on
   the compressed form: a sampled count of zeros leads to the 512 high bits that hold a bucket's start.
4. Sums by document return as one block for each (batch, shard) and are added up per batch in the order of shards, so
   reruns agree to the last digit.

Words are held as XXH64 digests and previous words within a word's range as 40 bits of one: with n distinct
previous words of one word the share of false matches is n / 2**40.

Null text is empty: one end token. Rows with a null id are hashed as crc32 of the empty text and count as training
rows (remainder 0). Repeated rows count and are scored each. Extra columns are not read.
"""

from __future__ import annotations

import mmap
import struct
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, lower_ascii, slices

SLOTS = 1 << 17
SHARE = 0.6
#: Training tokens for each shard. Fewer and larger shards send back fewer sums by (document, shard).
SHARD_TOKENS = 2_000_000
#: Digests of the end and start of a text: no word hashes to them by design of the seed, and no word is empty.
END_WORD, START_WORD = b"\x00end", b"\x00start"
MASK40 = (1 << 40) - 1


def word_hash(words: list[bytes]):
    import numpy as np
    from xxhash import xxh64_intdigest as h

    return np.array([h(w) for w in words], np.uint64)


# ---- Elias-Fano sequences over a flat buffer ----


def ef_encode(values, universe: int) -> bytes:
    """Non-decreasing integers below `universe` (values as uint64): header, low bits, high bits in unary."""
    import numpy as np

    n = len(values)
    low = min(56, max(0, (universe // max(n, 1)).bit_length() - 1)) if n else 0
    high = (values >> np.uint64(low)).astype(np.int64)
    bits = np.zeros((int(high[-1]) + n + 8) // 8 * 8 if n else 8, np.uint8)
    bits[high + np.arange(n)] = 1
    if low:
        # In slices of a multiple of eight values, whose bits are whole bytes: a bit of all values at once would take eight bytes.
        part = lambda v: np.packbits(((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        lows = b"".join(part(values[i : i + (1 << 14)]) for i in range(0, n, 1 << 14))
    else:
        lows = b""
    lows += b"\x00" * (-len(lows) % 8 + 16)
    highs = np.packbits(bits, bitorder="little").tobytes()
    highs += b"\x00" * (-len(highs) % 8)
    return struct.pack("<qqqq", n, low, len(lows), len(highs)) + lows + highs


def _select_table():
    """[byte, k]: place of the k-th one of a byte."""
    import numpy as np

    out = np.zeros((256, 8), np.uint8)
    for b in range(256):
        places = [i for i in range(8) if b >> i & 1]
        out[b, : len(places)] = places
    return out


class EliasFano:
    """Reads ef_encode's form in place. Beside it stand the ones before each 512 high bits, a 16th of their size."""

    def __init__(self, buffer, at: int):
        import numpy as np

        self.n, self.low, lows, highs = struct.unpack_from("<qqqq", buffer, at)
        at += 32
        self.lows = np.frombuffer(buffer, np.uint8, lows, at)
        self.high = np.frombuffer(buffer, np.uint8, highs, at + lows).view("<u8") if (at + lows) % 8 == 0 else np.frombuffer(buffer, np.uint8, highs, at + lows).copy().view("<u8")
        self.end = at + lows + highs
        counts = np.bitwise_count(self.high).astype(np.int64)
        self.blocks = np.concatenate([[0], np.cumsum(np.add.reduceat(counts, np.arange(0, len(counts), 8)) if len(counts) else counts)])
        self.table = _select_table()

    def _select(self, k, zeros: bool):
        """Place of the k-th (from 0) one, or zero, among the high bits; k is below their number."""
        import numpy as np

        ones = self.blocks
        before = np.arange(len(ones), dtype=np.int64) * 512 - ones if zeros else ones
        block = np.searchsorted(before, k, "right") - 1
        block = np.minimum(block, len(before) - 2)
        rest = k - before[block]
        out = np.empty(len(k), np.int64)
        for a in range(0, len(k), 65_536):  # 64 bytes of bits for each query at a time
            b, r = block[a : a + 65_536], rest[a : a + 65_536].copy()
            place = b[:, None] * 8 + np.arange(8)
            words = self.high[np.minimum(place, len(self.high) - 1)]
            words = ~words if zeros else words.copy()
            words[place >= len(self.high)] = ~np.uint64(0) if zeros else np.uint64(0)
            sums = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
            word = np.minimum((sums <= r[:, None]).sum(axis=1), 7)
            row = np.arange(len(b))
            r -= np.where(word > 0, sums[row, word - 1], 0)
            own = words[row, word].astype("<u8").view(np.uint8).reshape(-1, 8)
            sums = np.cumsum(np.bitwise_count(own), axis=1, dtype=np.int64)
            byte = np.minimum((sums <= r[:, None]).sum(axis=1), 7)
            r -= np.where(byte > 0, sums[row, byte - 1], 0)
            out[a : a + 65_536] = b * 512 + word * 64 + byte * 8 + self.table[own[row, byte], r]
        return out

    def low_bits(self, i):
        """Low parts of the values at positions i."""
        import numpy as np

        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.int64) * self.low
        byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
        out = np.zeros(len(i), np.uint64)
        for k in range(8):
            out |= self.lows[byte + k].astype(np.uint64) << np.uint64(8 * k)
        out >>= shift
        return out & np.uint64((1 << self.low) - 1)

    def get(self, i):
        import numpy as np

        i = np.asarray(i, np.int64)
        return ((self._select(i, False) - i).astype(np.uint64) << np.uint64(self.low)) | self.low_bits(i)

    def successor(self, x, exact: bool = False):
        """Position of the first value >= x, for each x (uint64): the bucket by its high part, then a binary search in it.

        With exact, also whether that value is x.
        """
        import numpy as np

        want = (x >> np.uint64(self.low)).astype(np.int64)
        last = 64 * len(self.high) - self.n  # zeros there are: one ends each bucket
        inside = want < last
        lo, hi = np.full(len(x), self.n), np.full(len(x), self.n)
        h = want[inside]
        ends = self._select(h, True)
        hi[inside] = ends - h
        # A bucket begins after the zero before its own, at place 0 for the first.
        begins = np.where(h > 0, self._select(np.maximum(h - 1, 0), True) + 1, 0)
        lo[inside] = begins - h
        stop = np.minimum(hi, self.n)
        lo, hi = np.minimum(lo, self.n), stop.copy()
        rest = x & np.uint64((1 << self.low) - 1) if self.low else np.zeros(len(x), np.uint64)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.low_bits(mid) < rest[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        if not exact:
            return lo
        found = lo < stop
        found[found] = self.low_bits(lo[found]) == rest[found]
        return lo, found


# ---- the trie of one shard ----


def quantise(x, lo: float, hi: float):
    import numpy as np

    return np.round((x - lo) / (hi - lo) * 65535).astype("<u2")


def build_trie(words, counts, owner, previous, values) -> bytes:
    """words: sorted uint64 digests with counts; pairs sorted by (owner, previous): owner is a place in words, values the
    natural numerators c(v w) + m(v) p(w)."""
    import numpy as np

    n, m = len(words), len(owner)
    logs = np.log10(values) if m else np.zeros(0)
    lo, hi = (float(logs.min()), float(logs.max()) + 1e-9) if m else (0.0, 1.0)
    pointers = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.uint64) if n else np.zeros(1, np.uint64)
    level2 = (owner.astype(np.uint64) << np.uint64(40)) + previous
    parts = [struct.pack("<qqdd", n, m, lo, hi), ef_encode(words, 1 << 64), ef_encode(pointers, m + 1), ef_encode(level2, max(n, 1) << 40)]
    return b"".join([*parts, counts.astype("<i8").tobytes(), quantise(logs, lo, hi).tobytes()])


class Trie:
    """Levels of build_trie, read from a file that is mapped and has no name (the stored row is in the shared folder)."""

    def __init__(self, data: bytes):
        import numpy as np

        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            buffer = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, m, self.lo, self.hi = struct.unpack_from("<qqdd", buffer, 0)
        self.words = EliasFano(buffer, 32)
        self.pointers = EliasFano(buffer, self.words.end)
        self.level2 = EliasFano(buffer, self.pointers.end)
        self.counts = np.frombuffer(buffer, "<i8", n, self.level2.end)
        self.codes = np.frombuffer(buffer, "<u2", m, self.level2.end + 8 * n)

    def find_words(self, w):
        """Place of each digest among the words, or -1."""
        import numpy as np

        at, found = self.words.successor(w, exact=True)
        return np.where(found, at, -1)

    def find_pairs(self, place, previous):
        """log10 of the stored numerator of (word place, previous), and whether it is stored.

        place * 2**40 + previous lies between the pointers of its range, so the key's successor is searched in that context alone.
        """
        import numpy as np

        key = (place.astype(np.uint64) << np.uint64(40)) + previous
        at, ok = self.level2.successor(key, exact=True)
        out = np.zeros(len(place))
        out[ok] = self.lo + self.codes[at[ok]] / 65535 * (self.hi - self.lo)
        return out, ok


# ---- passes over texts ----


def held_out(id_text):
    return F.coalesce(F.pmod(F.crc32(id_text.cast("binary")), F.lit(5)) == 1, F.lit(False))


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    i = F.col(id_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(i).alias("held"), F.col(text_col).cast("binary").alias("t"))


def training_counts(docs: DataFrame) -> DataFrame:
    """(w, c): training tokens by word digest (signed), the end included; counted by task before the shuffle."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        words, counts, new, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merge() -> None:
            nonlocal words, counts, new, size
            own, n = np.unique(np.concatenate(new), return_counts=True)
            both, at = np.unique(np.concatenate([words, own]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
            words, new, size = both, [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["w", "c"])

        for batch in batches:
            for held, data in zip(batch.column(1).to_pylist(), slices(batch.column(2)), strict=True):
                if not held:
                    h = word_hash([*lower_ascii(data).split(), END_WORD])
                    new.append(h)
                    size += len(h)
                    if size > 2_000_000:
                        merge()
            if len(words) > 2_000_000:  # bounded memory: what is counted so far goes out
                yield out()
                words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if new:
            merge()
        yield out()

    return docs.mapInArrow(run, "w bigint, c bigint").groupBy("w").agg(F.sum("c").alias("c"))


def _pack(arrays: list) -> bytes:
    return b"".join(struct.pack("<q", len(b)) + b for b in (a.tobytes() for a in arrays))


def _unpack(data: bytes, kinds: list[str]) -> list:
    import numpy as np

    out, at = [], 0
    for k in kinds:
        (n,) = struct.unpack_from("<q", data, at)
        out.append(np.frombuffer(data, k, n // np.dtype(k).itemsize, at + 8))
        at += 8 + n
    return out


#: Token blocks: distinct words, tokens of each, document numbers, previous words' hashes (5 bytes each).
KINDS = ["<u8", "<u4", "<u2", "u1"]
#: Pair blocks: distinct words, pairs of each, previous words' hashes, counts.
PAIR_KINDS = ["<u8", "<u4", "u1", "<u4"]


def _five(v):
    """The low 40 bits of each number as five bytes, and back."""
    import numpy as np

    return np.ascontiguousarray((v & np.uint64(MASK40)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _from_five(x):
    import numpy as np

    return np.pad(x.reshape(-1, 5), ((0, 0), (0, 3))).copy().view("<u8").ravel()


def _dealt(w, v, hot, shards: int):
    """Shard of each token: by its word, for hot words by the previous word too."""
    import numpy as np

    shard = (w % np.uint64(shards)).astype(np.int64)
    if len(hot):
        is_hot = np.isin(w, hot)
        shard[is_hot] = ((w[is_hot] ^ (v[is_hot] >> np.uint64(7))) % np.uint64(shards)).astype(np.int64)
    return shard


def _text_blocks(texts, block: int):
    """(first, end) of runs of texts of about `block` bytes and fewer than 65,536 texts."""
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size < block) and end - at < 65_535:
            size += texts.ends[end + 1] - texts.ends[end]
            end += 1
        yield at, end
        at = end


def _word_pairs(texts, rows):
    """Digests of the words of the texts, of the words before them, and how many each text has."""
    import numpy as np

    # Words are hashed text by text, so that one text's words at a time are Python objects.
    parts = [word_hash([*lower_ascii(texts[i]).split(), END_WORD]) for i in rows]
    lens, w = np.array([len(x) for x in parts], np.int64), np.concatenate(parts)
    v = np.concatenate([word_hash([START_WORD]), w[:-1]])
    v[np.concatenate([[0], np.cumsum(lens)[:-1]])] = v[0]
    return w, v, lens


def _cuts(x):
    import numpy as np

    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]])


def _pairs(hot_words, shards: int, block: int = 8_000_000):
    """Training rows (held, text) -> (shard, data): pairs of words counted within a block of text."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        hot = np.array(list(hot_words.value), np.uint64)
        for batch in batches:
            held, texts = batch.column(0).to_pylist(), slices(batch.column(1))
            for first, end in _text_blocks(texts, block):
                rows = [i for i in range(first, end) if not held[i]]
                if not rows:
                    continue
                w, v, _ = _word_pairs(texts, rows)
                shard, prev = _dealt(w, v, hot, shards), v & np.uint64(MASK40)
                order = np.lexsort((prev, w, shard))
                shard, w, prev = shard[order], w[order], prev[order]
                new = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (w[1:] != w[:-1]) | (prev[1:] != prev[:-1])]))
                count = np.diff(np.concatenate([new, [len(w)]]))
                shard, w, prev = shard[new], w[new], prev[new]
                out_shard, out_data = [], []
                for a, b in zip(*(c.tolist() for c in (_cuts(shard)[:-1], _cuts(shard)[1:])), strict=True):
                    starts = _cuts(w[a:b])
                    out_shard.append(int(shard[a]))
                    out_data.append(_pack([w[a:b][starts[:-1]].astype("<u8"), np.diff(starts).astype("<u4"), _five(prev[a:b]), count[a:b].astype("<u4")]))
                yield pa.RecordBatch.from_arrays([pa.array(out_shard, pa.int64()), pa.array(out_data, pa.binary())], ["shard", "data"])

    return run


def shard_trie(w, prev, count, hot: dict[int, int], n_train: int, n_words: int, slots) -> bytes:
    """The trie of pairs (w, prev) with counts, in any order and with repeats; hot words have their counts of all shards."""
    import numpy as np

    total = n_train + 0.5 * (n_words + 1)
    order = np.lexsort((prev, w))
    w, prev, count = w[order], prev[order], count[order].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (prev[1:] != prev[:-1])])) if len(w) else np.zeros(0, np.int64)
    count = np.add.reduceat(count, new) if len(new) else count
    w, prev = w[new], prev[new]
    words, place = np.unique(w, return_inverse=True)
    counts = np.bincount(place, count, len(words)).astype(np.int64)
    for i in np.flatnonzero(np.isin(words, np.array(list(hot), np.uint64))).tolist() if hot else ():
        counts[i] = hot[int(words[i])]
    reserve = SHARE * 2.0 ** slots[(prev & np.uint64(SLOTS - 1)).astype(np.int64)].astype(float)
    return build_trie(words, counts, place, prev, count + reserve * (counts[place] + 0.5) / total)


def _tries(slots, hot_words, n_train: int, n_words: int):
    """Rows (shard, data) sorted by shard -> (shard, trie). A shard's pairs are held together: SHARD_TOKENS tokens make them."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table = np.frombuffer(slots.value, np.uint8)

        def done(shard: int, held: list) -> pa.RecordBatch:
            parts = [_unpack(d, PAIR_KINDS) for d in held]
            w = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
            prev, count = np.concatenate([_from_five(p[2]) for p in parts]), np.concatenate([p[3] for p in parts])
            trie = shard_trie(w, prev, count, hot_words.value, n_train, n_words, table)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([trie], pa.binary())], ["shard", "trie"])

        now, held = None, []
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != now and held:
                    yield done(now, held)
                    held = []
                now = shard
                held.append(data)
        if held:
            yield done(now, held)

    return run


@dataclass
class Model:
    """A fitted model: its tries as a stored table (shard, trie), and what is small enough to broadcast."""

    tries: DataFrame
    shards: int
    n_train: int
    n_words: int
    n_docs: int
    slots: bytes
    hot: dict[int, int]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> Model:
    """The model of the training rows of docs."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    d = _inputs(docs, id_col, text_col)
    words = keep(training_counts(d), "lm-words")
    end = int(word_hash([END_WORD]).view("int64")[0])
    n_train, n_words, n_docs = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("w") == end, F.col("c"))), F.lit(0))).first()
    shards = max(1, -(-n_train // shard_tokens))
    many = words.where(F.col("c") > n_train / (4 * shards)).collect()  # fewer than 4 * shards rows
    table = bytearray(SLOTS)
    slots = words.groupBy(F.col("w").bitwiseAND(SLOTS - 1).cast("int").alias("slot")).agg(F.round(F.log2(F.sum("c"))).cast("int").alias("k"))
    for r in slots.collect():  # at most 2**17 rows
        table[r["slot"]] = min(60, r["k"])
    start_slot = int(word_hash([START_WORD])[0]) % SLOTS
    table[start_slot] = max(table[start_slot], n_docs.bit_length())
    hot = {r["w"] % (1 << 64): r["c"] for r in many}
    pairs = d.where(~F.col("held")).select("held", "t").mapInArrow(_pairs(sc.broadcast(hot), shards), "shard bigint, data binary")
    dealt = pairs.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard")
    tries = keep(dealt.mapInArrow(_tries(sc.broadcast(bytes(table)), sc.broadcast(hot), n_train, n_words), "shard bigint, trie binary"), "lm-tries")
    return Model(tries, shards, n_train, n_words, n_docs, bytes(table), hot)


def _tokens(hot_words, shards: int, block: int = 8_000_000):
    """Blocks (shard, batch, data) of tokens, and one row (with a negative shard) for the batch's documents.

    A batch is about `block` bytes of text and fewer than 65,536 documents.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        hot = np.array(list(hot_words.value), np.uint64)
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, held, texts = batch.column(0), np.array(batch.column(1).to_pylist(), bool), slices(batch.column(2))
            for first, end in _text_blocks(texts, block):
                w, v, lens = _word_pairs(texts, range(first, end))
                shard, doc = _dealt(w, v, hot, shards), np.repeat(np.arange(end - first, dtype="<u2"), lens)
                order = np.lexsort((w, shard))
                w, v, doc, shard = w[order], v[order], doc[order], shard[order]
                cut = _cuts(shard).tolist()
                key = (part << 32) | number
                number += 1
                rows_shard, rows_data = [-1 - key], [_pack([lens.astype("<u4"), held[first:end].astype(np.uint8)])]
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    starts = _cuts(w[a:b])
                    rows_shard.append(int(shard[a]))
                    rows_data.append(_pack([w[a:b][starts[:-1]].astype("<u8"), np.diff(starts).astype("<u4"), doc[a:b], _five(v[a:b])]))
                n = len(rows_shard)
                id_list = [ids.slice(first, end - first).to_pylist()] + [None] * (n - 1)
                yield pa.RecordBatch.from_arrays([pa.array(rows_shard, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(rows_data, pa.binary()), pa.array(id_list, pa.list_(pa.int64()))], ["shard", "batch", "data", "ids"])

    return run


def score_tokens(trie: Trie | None, words, runs, prev, hot: dict[int, int], n_train: int, n_words: int, slots):
    """Base, score and whether it is known for the tokens of distinct words with run lengths `runs` and previous words' hashes."""
    import numpy as np

    total = n_train + 0.5 * (n_words + 1)
    place = trie.find_words(words) if trie else np.full(len(words), -1)
    c = np.zeros(len(words), np.int64)
    c[place >= 0] = trie.counts[place[place >= 0]] if trie else 0
    for i in np.flatnonzero((place < 0) & np.isin(words, np.array(list(hot), np.uint64))).tolist() if hot else ():  # a hot word whose pairs here have no training text
        c[i] = hot[int(words[i])]
    base = np.log10((c + 0.5) / total)
    own = c + SHARE * 2.0 ** slots[(words & np.uint64(SLOTS - 1)).astype(np.int64)].astype(float)
    after = np.where(words == word_hash([END_WORD])[0], 0.0, np.log10(own))
    score = np.log10(SHARE) + slots[(prev & np.uint64(SLOTS - 1)).astype(np.int64)] * np.log10(2.0) + np.repeat(base, runs)
    at = np.repeat(place, runs)
    known = np.flatnonzero(at >= 0)
    if len(known):
        found, ok = trie.find_pairs(at[known], prev[known])
        score[known[ok]] = found[ok]
    return np.repeat(base, runs), score - np.repeat(after, runs), np.repeat(c > 0, runs)


def _score(slots, hot, n_train: int, n_words: int):
    """Rows sorted by shard, then batch, a shard's trie first -> (batch, shard, data). Documents' rows pass through."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table = np.frombuffer(slots.value, np.uint8)
        now, trie = None, None
        for batch in batches:
            shards, keys, ids = (batch.column(i).to_pylist() for i in (0, 1, 3))
            out: list[tuple] = []
            for i, (shard, key) in enumerate(zip(shards, keys, strict=True)):
                if shard < 0:
                    out.append((key, shard, batch.column(2)[i].as_py(), ids[i]))
                    continue
                if shard != now:
                    now, trie = shard, None
                data = batch.column(2)[i].as_py()
                if key < 0:
                    trie = Trie(data)
                    continue
                words, runs, doc, prev = _unpack(data, KINDS)
                docs, inv = np.unique(doc, return_inverse=True)
                base, score, known = score_tokens(trie, words, runs, _from_five(prev), hot.value, n_train, n_words, table)
                sums = [np.bincount(inv, x, len(docs)) for x in (base, score, known)]
                out.append((key, shard, _pack([docs.astype("<u4"), sums[0].astype("<f8"), sums[1].astype("<f8"), sums[2].astype("<u4")]), None))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["batch", "shard", "data", "ids"])

    return run


def _totals(n_train: int, n_docs: int, slot: int):
    """Rows sorted by batch, the documents' row first, then by shard -> one row a document."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        first = -np.log10(n_docs + SHARE * 2.0**slot)

        def done(ids, lens, held, base, score, known) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held.astype(bool)), pa.array(lens.astype(np.int64)), pa.array(known), pa.array(np.full(len(lens), n_train, np.int64)), pa.array(base), pa.array(score + first)], names)

        now = None
        for batch in batches:
            for data, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids is not None:
                    if now:
                        yield done(*now)
                    lens, held = _unpack(data, ["<u4", "u1"])
                    now = (ids, lens, held, np.zeros(len(lens)), np.zeros(len(lens)), np.zeros(len(lens), np.int64))
                else:
                    docs, base, score, known = _unpack(data, ["<u4", "<f8", "<f8", "<u4"])
                    now[3][docs] += base
                    now[4][docs] += score
                    now[5][docs] += known
        if now:
            yield done(*now)

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score by a fitted model: one row per document row."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = sc.broadcast(model.hot)
    tokens = _inputs(docs, id_col, text_col).mapInArrow(_tokens(hot, model.shards), "shard bigint, batch bigint, data binary, ids array<bigint>")
    stored = model.tries.select("shard", F.lit(-1).cast("bigint").alias("batch"), F.col("trie").alias("data"), F.lit(None).cast("array<bigint>").alias("ids"))
    by_shard = tokens.unionByName(stored).repartitionById(model.shards, F.pmod("shard", F.lit(model.shards)).cast("int")).sortWithinPartitions("shard", "batch")
    sums = by_shard.mapInArrow(_score(sc.broadcast(model.slots), hot, model.n_train, model.n_words), "batch bigint, shard bigint, data binary, ids array<bigint>")
    by_batch = sums.repartition(max(parts, model.shards), "batch").sortWithinPartitions("batch", F.col("ids").isNull(), "shard").select("data", "ids")
    start = int(word_hash([START_WORD])[0]) % SLOTS
    return by_batch.mapInArrow(_totals(model.n_train, model.n_docs, model.slots[start]), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """All rows of docs scored by the model of its training rows."""
    return score(docs, fit(docs, id_col, text_col, shard_tokens), id_col, text_col)
