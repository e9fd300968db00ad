"""Periodic run detection (operator 13): online dyadic square catching over the words of a text.

A run of period q and length max(12, 2 q) or more holds at least max(12 - q, q) consecutive words that equal the words q before
them. `RunCatcher` takes a text word by word:

1. Blocks of 2**k words, k = 2, 3, ..., start at every multiple of 2**(k-1). A completed block is a catcher for the periods
   3 * 2**(k-1) - 1 to 3 * 2**k - 2 (for k = 2 from 1): so many equal words in a row always hold one whole block. Only the three or four
   blocks whose window reaches the present word are live on a level.
2. An appended word first meets the set of four-word blocks completed so far. Where its last four words are new, no block of any level can end
   here a second time, and nothing more happens. Otherwise the live catchers of each level are compared with the last 2**k words.
3. A caught block opens a suffix comparison: it reaches back to where the equal words begin (less than one half block, else an earlier block
   would have caught it), and each further word either advances it or closes it.
4. A closing comparison of 2 q words or more is a maximal stretch: all its squares are merged into one run. A catch of a multiple of an
   open period inside the same stretch is that run again and opens nothing, so runs come with their smallest period.

Each word costs a dictionary look-up, plus a few comparisons a level where text repeats: n log n for any text. Memory is the text's words
and an entry for every second word. A text is one row and is taken whole; texts are independent, so there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

LEAST = 12
COLUMNS = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, collapsed binary"


class RunCatcher:
    """append() words (any hashable values), then finish(); runs() gives (start, length, period) of all runs closed so far."""

    def __init__(self, least: int = LEAST):
        if least < 12:
            raise ValueError("runs of fewer than 12 words need smaller blocks")
        self.least = least
        self.words: list = []
        self._blocks: set = set()
        self._open: dict[int, int] = {}  # period -> first word that equals the one a period later
        self._closed: dict[tuple[int, int], int] = {}  # (start, length) -> smallest period

    def extend(self, words) -> None:
        """Append many words. The loop is written out for speed; `_look` has the rest of the work."""
        s, blocks, opened = self.words, self._blocks, self._open
        i = len(s)
        for w in words:
            s.append(w)
            if opened:
                for q in [q for q in opened if s[i - q] != w]:
                    self._close(q, i)
            if i >= 3:
                last = (s[i - 3], s[i - 2], s[i - 1], w)
                if last in blocks:
                    self._look(i)
                if i & 1:
                    blocks.add(last)  # the block that starts at i - 3, an even place
            i += 1

    def append(self, word) -> None:
        self.extend((word,))

    def finish(self) -> list[tuple[int, int, int]]:
        for q in list(self._open):
            self._close(q, len(self.words))
        return self.runs()

    def runs(self) -> list[tuple[int, int, int]]:
        return sorted((a, n, q) for (a, n), q in self._closed.items())

    def _close(self, q: int, end: int) -> None:
        start = self._open.pop(q)
        n = end - start
        if n >= 2 * q and n >= self.least:
            self._closed[start, n] = min(q, self._closed.get((start, n), q))

    def _look(self, i: int) -> None:
        """Compare the last 2**k words with the live catchers of each level, and open a comparison for each catch."""
        s, opened = self.words, self._open
        size, low, high = 4, 1, 10
        end = s[i]
        short = min(opened, default=0)
        while True:
            at = i + 1 - size  # where the last block starts
            if at - low < 0:
                return
            step = size >> 1
            b = (at - low) // step * step
            last = max(at - high, 0)
            first = s[at]
            if 0 < short <= size and b >= opened[short]:
                b = (opened[short] - 1) // step * step  # inside that stretch only its multiples can be caught
            while b >= last:
                if s[b] == first and s[b + size - 1] == end:
                    q = at - b
                    if q not in opened and not any(q % p == 0 and a <= b for p, a in opened.items()) and s[b : b + size] == s[at : i + 1]:
                        a = b
                        while a and s[a - 1] == s[a - 1 + q]:
                            a -= 1
                        opened[q] = a
                b -= step
            low, high, size = high + 1, 2 * high + 2, 2 * size


def find_runs(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    c = RunCatcher(least)
    c.extend(words)
    return sorted(c.finish(), key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run contains after its first period."""
    gone: list[tuple[int, int]] = sorted((a + q, a + n) for a, n, q in runs)
    out, at = [], 0
    for a, b in gone:
        if a > at:
            out += words[at:a]
        at = max(at, b)
    return out + words[at:]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, texts: bool = True) -> DataFrame:
    """One row per document row: doc_id, n_runs, the longest run (start, length, period, exponent_milli; ties: smallest start, then period; nulls if there
    is none), digests of all runs and of the collapsed text, and that text (null if `texts` is false).

    Null, empty and blank texts have no words and no runs; their digests are those of the empty string. Repeated rows give repeated rows, a null doc_id
    stays null, extra columns are not read.
    """

    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import pyarrow as pa

        names = [c.split()[0] for c in COLUMNS.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.binary()]
        for batch in batches:
            out, size = [], 0
            for i, data in zip(batch.column(0).to_pylist(), slices(batch.column(1)), strict=True):
                words = data.split()
                runs = find_runs(words, least)
                a, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
                rest = b" ".join(collapse(words, runs))
                digest = sha256("".join(f"{x},{y},{z}\n" for x, y, z in runs).encode()).hexdigest()
                out.append((i, len(runs), a, n, q, 1000 * n // q if runs else None, digest, sha256(rest).hexdigest(), rest if texts else None))
                size += len(rest)
                if size > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return d.mapInArrow(run, COLUMNS).withColumn("collapsed", F.col("collapsed").cast("string"))
