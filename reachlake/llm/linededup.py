"""Line dedup (operator 9): range-partitioned line hashes, streamed in order, keep bitmaps per document.

1. One pass over the texts emits (128-bit key hash, doc_id, text hash, line number) for each line whose key has at least
   `min_chars` code points, written to the shared folder. Only hashes and positions travel, no text.
2. These rows are range-partitioned by (hash, doc_id descending) and sorted by document and position within, so a key that a
   third of all documents hold spreads over many partitions. Each partition is streamed: in a key's run the first
   document is the largest doc_id, which keeps its lines; once `min_docs` documents are seen the lines of the others
   are emitted as drops. A key that touches a partition's edge can go on in the next one: its rows there are
   emitted as open, with a (key, count) summary per edge. The summaries are at most two a partition, a bound
   that doesn't grow with a key, and are summed and broadcast to settle the open rows.
3. Drops are line numbers; gathered by document row (doc_id, text hash) they become its compressed keep bitmap
   (`keep_bitmaps`) without a text being read or moved again. Texts meet bitmaps only where kept texts or
   their digests are asked for (`line_bitmaps`, `drop_lines`).

A line's key is the line without white space at either end, A-Z lower-cased. Rows with the same doc_id are
one document: a key counts once for them and all their lines stay or go together. Null or empty text is
one empty line. Rows with a null doc_id belong to no document: they count for nothing and keep all lines.
Repeated lines inside the largest document stay. Extra columns are carried or ignored, never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, lower_ascii, slices

STRIP = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: bytes) -> bytes:
    return lower_ascii(line.strip(STRIP))


def _long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)


def _digest(key: bytes) -> tuple[int, int]:
    import xxhash

    x = xxhash.xxh3_128_intdigest(key)
    return (x >> 64) - (1 << 63), (x & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, th, pos), one row a long line of a document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b, ids, hashes, at = [], [], [], [], []
            for doc_id, th, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), slices(batch.column(2)), strict=True):
                if doc_id is None or len(data) < min_chars:
                    continue
                for pos, line in enumerate(data.split(b"\n")):
                    if len(line) >= min_chars and _long(key := line_key(line), min_chars):
                        x, y = _digest(key)
                        a.append(x)
                        b.append(y)
                        ids.append(doc_id)
                        hashes.append(th)
                        at.append(pos)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, ids, hashes, at)], ["h1", "h2", "doc_id", "th", "pos"])

    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("t"))
    return d.mapInArrow(run, "h1 bigint, h2 bigint, doc_id bigint, th bigint, pos bigint")


def _stream(min_docs: int):
    """kind 0: drop; 1: open row; 2: edge summary, with the documents seen in n and the largest in doc_id."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["kind", "h1", "h2", "doc_id", "th", "pos", "n"]

        def out(parts: list) -> pa.RecordBatch:
            cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(len(names))]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names)

        def rows(kind: int, key: tuple[int, int], own, n: int = 0) -> tuple:
            """own: columns doc_id, th, pos."""
            full = lambda v: np.full(own.shape[1], v, np.int64)
            return full(kind), full(key[0]), full(key[1]), *own, full(n)

        # The run at hand: its key, documents seen, largest and last document, whether it is the partition's
        # first, and its rows while fewer than min_docs documents are seen.
        key, n, top, last, first, held = None, 0, 0, None, True, []

        def close(parts: list, at_end: bool) -> None:
            if key is not None and (first or at_end):
                parts.append(rows(2, key, np.array([[top], [0], [0]], np.int64), n))
                if not first and n < min_docs:
                    parts.append(rows(1, key, np.concatenate(held, axis=1)))

        for batch in batches:
            h1, h2, *rest = (batch.column(i).to_numpy() for i in range(5))
            if not len(h1):
                continue
            cols = np.stack(rest)
            cut = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(h1)]])
            parts: list = []
            # Short runs that touch neither end of the batch can't reach min_docs.
            for k in np.flatnonzero((ends - starts >= min_docs) | (starts == 0) | (ends == len(h1))):
                now, own = (int(h1[starts[k]]), int(h2[starts[k]])), cols[:, starts[k] : ends[k]]
                if now != key:
                    close(parts, False)
                    key, n, top, last, first, held = now, 0, int(own[0, 0]), None, key is None, []
                before = n
                n += int((own[0, 1:] != own[0, :-1]).sum()) + (own[0, 0] != last)
                last = int(own[0, -1])
                if first:
                    parts.append(rows(1, key, own))
                elif n < min_docs:
                    held = [*held, own]
                else:
                    if before < min_docs:
                        own, held = np.concatenate([*held, own], axis=1), []
                    parts.append(rows(0, key, own[:, own[0] != top]))
            yield out(parts)
        parts = []
        close(parts, True)
        yield out(parts)

    return run


def line_drops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, th, lines): for each document row that loses lines, their numbers in order."""
    hashes = keep(line_hashes(docs, id_col, text_col, min_chars), "line-hashes")
    parts = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc()]
    # Equal documents of a key are never parted, so each edge counts its documents once.
    dealt = hashes.repartitionByRange(parts, *order).sortWithinPartitions(*order, "th", "pos")
    streamed = keep(dealt.mapInArrow(_stream(min_docs), "kind bigint, h1 bigint, h2 bigint, doc_id bigint, th bigint, pos bigint, n bigint"), "line-drops")
    edges = streamed.where("kind = 2").groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("doc_id").alias("top")).where(F.col("docs") >= min_docs)
    opened = streamed.where("kind = 1").select("h1", "h2", "doc_id", "th", "pos")
    settled = opened.join(F.broadcast(edges), ["h1", "h2"]).where("doc_id <> top").select("doc_id", "th", "pos")  # edges: at most 2 rows a partition
    drops = streamed.where("kind = 0").select("doc_id", "th", "pos").unionByName(settled)
    # Rows that are equal in doc_id and text have the same lines; each is counted once.
    return drops.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("lines"))


def bitmap(n_lines: int, dropped) -> bytes:
    """A little-endian bitmap of n_lines bits, those of dropped lines 0, compressed."""
    import numpy as np

    bits = np.ones(n_lines, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)


def kept_text(data: bytes, keep_bitmap: bytes) -> bytes:
    bits = zlib.decompress(keep_bitmap)
    return b"\n".join(x for i, x in enumerate(data.split(b"\n")) if bits[i >> 3] >> (i & 7) & 1)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, all_rows: bool = True) -> DataFrame:
    """doc_id, th (xxhash64 of the text), n_lines, n_dropped, keep_bitmap, once for each distinct (doc_id, th); texts are not shuffled.

    Without all_rows only document rows that lose lines are there.
    """
    drops = line_drops(docs, id_col, text_col, min_chars, min_docs)
    n = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1
    sizes = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.coalesce(n, F.lit(1)).cast("bigint").alias("n_lines"))
    sizes = sizes.groupBy("doc_id", "th").agg(F.first("n_lines").alias("n_lines"))
    drops = drops.withColumnsRenamed({"doc_id": "drop_id", "th": "drop_th"})
    on = (F.col("doc_id") == F.col("drop_id")) & (F.col("th") == F.col("drop_th"))
    d = sizes.join(drops.hint("shuffle_hash"), on, "left" if all_rows else "inner").select("doc_id", "th", "n_lines", "lines")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n_lines, lines = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            maps = [bitmap(k, x or []) for k, x in zip(n_lines, lines, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([len(x or ()) for x in lines], pa.int64()), pa.array(maps, pa.binary())], ["doc_id", "th", "n_lines", "n_dropped", "keep_bitmap"])

    return d.mapInArrow(run, "doc_id bigint, th bigint, n_lines bigint, n_dropped bigint, keep_bitmap binary")


def _with_bitmaps(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """Columns row (all of docs) and keep_bitmap, n_dropped (null where nothing goes). Rows without a doc_id are dealt by their text."""
    maps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs, all_rows=False).select(F.col("doc_id").alias("drop_id"), F.col("th").alias("drop_th"), "n_dropped", "keep_bitmap")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(text_col).alias("th"))
    return row.join(maps.hint("shuffle_hash"), (F.col("row")[id_col] == F.col("drop_id")) & (F.col("th") == F.col("drop_th")), "left").select("row", "n_dropped", "keep_bitmap")


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per document row: n_lines, n_dropped, the compressed keep bitmap and the kept text's SHA-256; no text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for doc_id, data, gone, bits in zip(batch.column(0).to_pylist(), slices(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n = data.count(b"\n") + 1
                rows.append((doc_id, n, gone or 0, bits or bitmap(n, []), hashlib.sha256(kept_text(data, bits) if gone else data).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], ["doc_id", "n_lines", "n_dropped", "keep_bitmap", "kept_sha256"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t"))
    d = _with_bitmaps(slim, "doc_id", "t", min_chars, min_docs)
    return d.select("row.doc_id", F.col("row.t").cast("binary").alias("t"), "n_dropped", "keep_bitmap").mapInArrow(run, "doc_id bigint, n_lines bigint, n_dropped bigint, keep_bitmap binary, kept_sha256 string")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the dropped lines taken out of the text; no row goes. Texts that lose nothing stay as they are."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            table = []
            for data, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table.append(data if bits is None else kept_text(data.encode(), bits).decode())
            yield pa.RecordBatch.from_arrays([pa.array(table, pa.string()), *(batch.column(i) for i in range(2, batch.num_columns))], ["t", *batch.schema.names[2:]])

    d = _with_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    rest = [c for c in docs.columns if c != text_col]
    safe = [f"c{i}" for i in range(len(rest))]
    d = d.select(F.col("row")[text_col].alias("t"), "keep_bitmap", *(F.col("row")[c].alias(s) for c, s in zip(rest, safe, strict=True)))
    fields = ", ".join(["t string", *(f"{s} {docs.schema[c].dataType.simpleString()}" for c, s in zip(rest, safe, strict=True))])
    out = d.mapInArrow(run, fields)
    back = dict(zip(rest, safe, strict=True)) | {text_col: "t"}
    return out.select(*(F.col(back[c]).alias(c) for c in docs.columns))
