"""URL filters (operator 4): a sorted digest array, memory-mapped and probed by binary search.

A rule is a host and a path prefix ("example.net/en/") with a verdict. It fits its host, all subdomains, and paths that
begin with its path; the longest rule wins (ties: the longer host). Rules are stored as one file of three
parts: sorted 64-bit XXH64 digests, offsets and verdicts, and the full strings. The file is written to the
shared folder and shipped by addFile; each Python worker maps it, so workers of a machine share the pages.
For each URL the keys that a rule could have (host suffixes times the path lengths that occur in the list) are
hashed and probed together with a vectorised binary search; a digest that is found counts only if its
stored string is equal, which settles collisions.

The array is built on the driver and checked against `max_bytes` (default 256 MB). A larger list goes through
`judge_urls_by_join`, which shuffles keys to rules and gives the same rows.

Null URLs and those without "://" have an empty host and path, fit no rule and get the default verdict. Repeated
rules must agree. Repeated rows get equal results. Extra columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MAPPED: dict = {}


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def digest_array(rules: list[tuple[str, str]]) -> bytes:
    """The file: counts (rules, path lengths, most dots of a host), path lengths, digests, offsets, verdicts, strings. rules: (key, verdict)."""
    import numpy as np
    from xxhash import xxh64_intdigest

    by: dict[bytes, str] = {}
    for key, verdict in rules:
        if by.setdefault(key.encode(), verdict) != verdict:
            raise ValueError(f"rules disagree on {key}")
    order = sorted((xxh64_intdigest(k), k) for k in by)
    lengths = sorted({len(k) - k.index(b"/") for k in by})
    ends = np.cumsum([0, *(len(k) for _, k in order)]).astype("<i8")
    return (
        struct.pack("<qqq", len(order), len(lengths), max((k[: k.index(b"/")].count(b".") for k in by), default=0))
        + np.array(lengths, "<i8").tobytes()
        + np.array([h for h, _ in order], "<u8").tobytes()
        + ends.tobytes()
        + bytes(by[k] == "block" for _, k in order)
        + b"".join(k for _, k in order)
    )


def ship(spark: SparkSession, data: bytes, name: str) -> str:
    """Write bytes to the shared folder and have executors fetch them; returns the name for SparkFiles.get."""
    path = f"{scratch(spark, name)}.bin"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    for i in range(0, len(data), 1 << 20):
        out.write(bytearray(data[i : i + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


class DigestArray:
    """The mapped file."""

    def __init__(self, path: str):
        import numpy as np

        raw = np.memmap(path, np.uint8, "r")
        n, m, self.dots = raw[:24].view("<i8").tolist()
        at = 24
        self.lengths, at = raw[at : at + 8 * m].view("<i8").tolist(), at + 8 * m
        self.digests, at = raw[at : at + 8 * n].view("<u8"), at + 8 * n
        self.ends, at = raw[at : at + 8 * (n + 1)].view("<i8"), at + 8 * (n + 1)
        self.block, at = raw[at : at + n], at + n
        self.text = raw[at:]

    def probe(self, keys: list[bytes]) -> list[int]:
        """Place of each key in the array, or -1."""
        import numpy as np
        from xxhash import xxh64_intdigest

        h = np.array([xxh64_intdigest(k) for k in keys], np.uint64)
        at = np.searchsorted(self.digests, h)
        out = np.full(len(keys), -1)
        n = len(self.digests)
        for i in np.flatnonzero(self.digests[np.minimum(at, n - 1)] == h).tolist() if n else ():
            j = int(at[i])
            while j < n and self.digests[j] == h[i]:
                if self.text[self.ends[j] : self.ends[j + 1]].tobytes() == keys[i]:
                    out[i] = j
                    break
                j += 1
        return out.tolist()


def host_suffixes(host: bytes, most: int) -> list[bytes]:
    """The host and the parts of it after a dot, of at most `most` dots (more than any rule's host has fit none)."""
    out, at = [], len(host)
    while at >= 0 and len(out) <= most:
        at = host.rfind(b".", 0, at)
        out.append(host[at + 1 :])
    return out


def mapped(path: str) -> DigestArray:
    """The array of a file, mapped once a Python worker."""
    return _MAPPED.get(path) or _MAPPED.setdefault(path, DigestArray(path))


def _judge(name: str, default: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rules = mapped(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = slices(batch.column(1)), slices(batch.column(2))
            keys, owner = [], []
            for i, (host, p) in enumerate(zip(hosts, paths, strict=True)):
                fit = [n for n in rules.lengths if n <= len(p)]
                for suffix in host_suffixes(host, rules.dots) if fit and host else ():
                    keys += [suffix + p[:n] for n in fit]
                    owner += [i] * len(fit)
            best: dict[int, tuple] = {}
            for i, key, at in zip(owner, keys, rules.probe(keys) if keys else [], strict=True):
                if at >= 0:
                    best[i] = max(best.get(i, (-1,)), (len(key), key.index(b"/"), key, int(at)))
            rule = [best[i][2].decode() if i in best else None for i in range(len(hosts))]
            verdict = [("block" if rules.block[best[i][3]] else "allow") if i in best else default for i in range(len(hosts))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*batch.schema.names, "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_bytes: int = 256_000_000) -> DataFrame:
    """(id, host, path, rule, verdict), one row a page; rules: ("host/path", "allow" or "block"). A map."""
    size = sum(len(k) + 32 for k, _ in rules)
    if size > max_bytes:
        raise ValueError(f"{size} bytes of rules, more than {max_bytes}: use judge_urls_by_join")
    name = ship(pages.sparkSession, digest_array(rules), "url-rules")
    host, path = host_and_path(F.col(url_col))
    d = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    kind = pages.schema[id_col].dataType.simpleString()
    return d.mapInArrow(_judge(name, default), f"id {kind}, host string, path string, rule string, verdict string")


def judge_urls_by_join(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The same rows for lists of any size (columns rule, verdict): keys meet rules in a shuffled join on the string.

    Repeated pages are judged once by (host, path). The path lengths that occur are collected: at most
    `distinct lengths` numbers.
    """
    lengths = sorted(r[0] for r in rules.select(F.octet_length(F.expr("substring(rule, instr(rule, '/'))")).alias("n")).distinct().collect())
    host, path = host_and_path(F.col(url_col))
    d = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.when(n <= F.octet_length("path"), F.left(F.encode("path", "utf-8"), n).cast("string"))), lambda x: x.isNotNull())
    keys = d.where("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("s"), prefixes.alias("p")).select("host", "path", F.explode(F.transform("p", lambda x: F.concat("s", x))).alias("rule"))
    fit = keys.join(rules.select("rule", F.col("verdict").alias("v")).distinct().hint("merge"), "rule")
    best = fit.groupBy("host", "path").agg(F.max(F.struct(F.octet_length("rule"), F.instr("rule", "/"), "rule", "v")).alias("b"))
    out = d.join(best.hint("merge"), ["host", "path"], "left")
    return out.select("id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.v", F.lit(default)).alias("verdict"))
