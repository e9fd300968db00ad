"""Benchmark decontamination (operator 2): one Aho-Corasick automaton, one scan of each text.

Texts and items are normalised on UTF-8 bytes: A-Z are lower-cased, every other ASCII character but digits
and letters becomes a space, and words are joined by single spaces. An item's windows are its runs of
`window` consecutive words (a shorter item, if not empty, is one window). Each window is a pattern
" w1 ... wn ", so hits begin and end at word boundaries. The automaton finds all occurrences, overlapping
ones included; the word numbers of a hit map back to code points of the original text.

The benchmark's windows are broadcast and built into an automaton once a Python worker, of about 400 bytes a character
(measured; one window a word). So a benchmark of more than `max_benchmark_chars` (default 1 million, 400 MB) is taken in
parts by item: each part is one scan that gives the documents it hits with word runs and items, and these are merged by
document row. Nothing is dropped at any size.

Null texts have no words, no hits and contaminated false. Null or empty items have no windows. Items with a null id
hit like others; all of them together count as one item, which is not among the listed ids. Repeated rows are judged
one by one. Items with equal windows are all reported. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, slices

WINDOW = 10
#: Letters, digits and bytes from 0x80 stay (A-Z lower-cased); the rest separates words.
_NORM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, item_ids array<string>, spans array<struct<start:bigint,end:bigint>>"


def normal_words(data: bytes) -> list[bytes]:
    return data.translate(_NORM).split()


def item_windows(items: list[tuple], window: int = WINDOW) -> dict[str, tuple[int, list]]:
    """Pattern text -> (its words, item ids as strings or None)."""
    out: dict[str, tuple[int, list]] = {}
    for item_id, text in items:
        if text is None:
            continue
        words = normal_words(text.encode())
        for i in range(max(1, len(words) - window + 1) if words else 0):
            part = words[i : i + window]
            n, ids = out.setdefault((b" " + b" ".join(part) + b" ").decode("latin-1"), (len(part), []))
            own = None if item_id is None else str(item_id)
            if own not in ids:
                ids.append(own)
    return out


def build_automaton(windows: dict[str, tuple[int, list[str]]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, v in windows.items():
        a.add_word(k, v)
    if windows:
        a.make_automaton()
    return a


_BUILT: dict = {}


def automaton_of(token: str, windows):
    """The automaton of a broadcast table of windows, built once a Python worker; the one before it is let go."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = build_automaton(windows.value)
    return _BUILT[token]


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def original_spans(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point spans in the original text of runs of word numbers [first, last]."""
    at = [m.span() for m in _WORD.finditer(data)]
    out, done, points = [], 0, 0
    for a, b in runs:
        start = points + len(data[done : at[a][0]].decode())
        done, points = at[b][1], start + len(data[at[a][0] : at[b][1]].decode())
        out.append((start, points))
    return out


def merge_runs(runs: list[tuple]) -> list[tuple]:
    """Sorted runs (first, last, ...) of word numbers, neighbours and overlaps joined; further fields are (start, end) in the text."""
    out: list[list] = []
    for first, last, *at in sorted(runs):
        if out and first <= out[-1][1] + 1:
            if last > out[-1][1]:
                out[-1][1] = last
                if at:
                    out[-1][3] = at[1]
        else:
            out.append([first, last, *at])
    return [tuple(r) for r in out]


def scan_text(data: bytes, automaton) -> tuple[int, list[tuple], set]:
    """Words, runs (first word, last word, start, end) that are hit, and items with occurring windows."""
    words = normal_words(data)
    if not words or not len(automaton):
        return len(words), [], set()
    text = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = [(end, v) for end, v in automaton.iter(text)]
    ids: set = set()
    # The number of spaces before a hit's last space is the number of its last word plus one.
    spans, seen, at = [], 0, 0
    for end, (n, own) in found:
        seen += text.count(" ", at, end)
        at = end
        spans.append((seen - n, seen - 1))
        ids.update(own)
    runs = merge_runs(spans)
    return len(words), [(*r, *s) for r, s in zip(runs, original_spans(data, runs), strict=True)] if runs else [], ids


def digest(ids: set) -> tuple[int, str, list[str]]:
    """n_items, items_sha256 and the listed ids."""
    listed = sorted(i for i in ids if i is not None)
    return len(ids), hashlib.sha256(",".join(listed).encode()).hexdigest(), listed


def _rows(rows: list[tuple]):
    """Rows (doc_id, words, runs, ids) as a record batch of SCHEMA."""
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    out = []
    for doc_id, n, runs, ids in rows:
        hit = sum(r[1] - r[0] + 1 for r in runs)
        n_items, sha, listed = digest(ids)
        out.append((doc_id, n, hit, n_items, sha, hit > 0, listed, [{"start": r[2], "end": r[3]} for r in runs]))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "spans"])


def _scan(token: str, windows) -> callable:
    def run(batches: Iterator) -> Iterator:
        automaton = automaton_of(token, windows)
        for batch in batches:
            yield _rows([(doc_id, *scan_text(data, automaton)) for doc_id, data in zip(batch.column(0).to_pylist(), slices(batch.column(1)), strict=True)])

    return run


def _scan_part(token: str, windows) -> callable:
    """Document rows (doc_id, th, text) -> those hit: doc_id, th, runs and ids."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        run_kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "end")]))
        automaton = automaton_of(token, windows)
        for batch in batches:
            out = []
            for doc_id, th, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), slices(batch.column(2)), strict=True):
                _, runs, ids = scan_text(data, automaton)
                if runs:
                    out.append((doc_id, th, [dict(zip(("first", "last", "start", "end"), r, strict=True)) for r in runs], list(ids)))
            kinds = [pa.int64(), pa.int64(), run_kind, pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "th", "runs", "ids"])

    return run


def benchmark_parts(benchmark: DataFrame, id_col: str, text_col: str, max_chars: int) -> tuple[DataFrame, int]:
    """Rows (part, i, t) of the benchmark and the number of parts; each part is about max_chars at most (an item is never cut)."""
    b = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    size = b.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-size // max_chars))
    return b.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(n))), n


def _windows(parts: DataFrame, part: int, window: int):
    """A name and the broadcast windows of one part."""
    items = [(r["i"], r["t"]) for r in parts.where(F.col("part") == part).select("i", "t").distinct().collect()]
    return uuid.uuid4().hex, parts.sparkSession.sparkContext.broadcast(item_windows(sorted(items, key=str), window))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_benchmark_chars: int = 1_000_000) -> DataFrame:
    """One row per document row: counts, items, and the spans hit in the original. A map without a shuffle for one part."""
    parts, n = benchmark_parts(benchmark, item_col, item_text_col, max_benchmark_chars)
    text = F.col(text_col).cast("binary").alias("t")
    if n == 1:
        return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text).mapInArrow(_scan(*_windows(parts, 0, window)), SCHEMA)
    row = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("th"), text)
    hits = [keep(row.mapInArrow(_scan_part(*_windows(parts, k, window)), "doc_id bigint, th bigint, runs array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>, ids array<string>"), "benchmark-hits") for k in range(n)]
    found = hits[0]
    for h in hits[1:]:
        found = found.unionByName(h)
    # Rows of equal id and text have equal hits, so each part counts once for them.
    found = found.groupBy("doc_id", "th").agg(F.flatten(F.collect_set("runs")).alias("runs"), F.flatten(F.collect_set("ids")).alias("ids"))
    found = found.withColumnsRenamed({"doc_id": "hit_id", "th": "hit_th"})
    words = F.size(F.filter(F.split(F.col(text_col), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1), lambda x: x != ""))
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.coalesce(words, F.lit(0)).cast("bigint").alias("n"))
    both = slim.join(found.hint("shuffle_hash"), slim["doc_id"].eqNullSafe(found["hit_id"]) & (slim["th"] == found["hit_th"]), "left").select("doc_id", "n", "runs", "ids")

    def merged(batches: Iterator) -> Iterator:
        for batch in batches:
            cols = (batch.column(i).to_pylist() for i in range(4))
            yield _rows([(d, k, merge_runs([(r["first"], r["last"], r["start"], r["end"]) for r in runs or []]), set(ids or ())) for d, k, runs, ids in zip(*cols, strict=True)])

    return both.mapInArrow(merged, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_benchmark_chars: int = 1_000_000) -> DataFrame:
    """The rows of docs without any hit, with the columns of docs: scans filter Arrow batches in place, one for each part, no join."""
    parts, n = benchmark_parts(benchmark, item_col, item_text_col, max_benchmark_chars)
    at = docs.columns.index(text_col)

    def clean(token: str, windows):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            automaton = automaton_of(token, windows)
            for batch in batches:
                yield batch.filter(pa.array([not scan_text(data, automaton)[1] for data in slices(batch.column(at))], pa.bool_()))

        return run

    out = docs
    for k in range(n):
        out = out.mapInArrow(clean(*_windows(parts, k, window)), docs.schema)
        out = keep(out, "benchmark-clean") if k + 1 < n else out
    return out
