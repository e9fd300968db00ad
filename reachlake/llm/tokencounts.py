"""Token counts (operator 5): rollups by source, language and tokenizer version, kept by signed deltas.

A ledger is a folder of committed batches. A batch holds signed sums (documents, tokens) by key: an insert adds, a
delete subtracts, a revised count subtracts the old and adds the new. Totals are the sum over batches, so
they follow changes without reading documents again. A commit writes to a staging folder and renames it to
batch=ID/attempt=A with a new A. Of several attempts at one batch the smallest A counts when the ledger is read, so each batch counts once
however often and by however many committers at a time it is sent; once there is an attempt, a commit that is sent again computes nothing.

Sums are made before the shuffle (partial aggregation), so a source with a third of all rows sends one row a task.
Null text has 0 tokens. Null sources and languages are keys of their own. Repeated rows count each. Totals whose
documents and tokens are both 0 are not reported. An op other than insert, delete and revise (null too) raises. A ledger
without a batch has no totals. Texts of any length are encoded whole. Extra columns are not read.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import slices, words_sql

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KEYS = ("source", "lang", "tokenizer")
LEDGER = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def with_token_counts(docs: DataFrame, text_col: str = "text", ranks_path: str = RANKS, version: str | None = None, carry: tuple[str, ...] = ("doc_id", "source", "lang")) -> DataFrame:
    """The carried columns, tokenizer (the version) and tokens, one row per document row; a map."""
    version = version or os.path.basename(ranks_path).partition(".")[0]
    if ranks_path == "words":
        return docs.select(*carry, F.lit("words").alias("tokenizer"), F.size(words_sql(F.col(text_col))).cast("bigint").alias("tokens"))
    with open(ranks_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: fixed size

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = Encoder(data.value, version)
        for batch in batches:
            n = [encoder.count(x.decode()) for x in slices(batch.column(len(carry)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], [*batch.schema.names[: len(carry)], "tokenizer", "tokens"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    return docs.select(*carry, F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, ", ".join([*kinds, "tokenizer string", "tokens bigint"]))


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows from changes with columns op (insert, delete, revise), the keys, tokens, and old_tokens for revise."""
    unknown = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))).cast("int")
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(unknown)
    tokens = F.coalesce("tokens", F.lit(0))
    delta = F.when(F.col("op") == "revise", tokens - F.coalesce("old_tokens", F.lit(0))).otherwise(sign * tokens)
    return changes.select(*KEYS, sign.cast("bigint").alias("n_docs"), delta.cast("bigint").alias("n_tokens"))


def rollup(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _attempts(spark: SparkSession, ledger: str, batch_id: str) -> list[str]:
    fs, p = _fs(spark, f"{ledger}/batch={batch_id}")
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def commit_batch(deltas: DataFrame, ledger: str, batch_id: str) -> bool:
    """Commit signed rows under batch_id; False if another attempt at that batch counts (nothing is computed if it is there already)."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", batch_id):
        raise ValueError("a batch id has letters, digits, dots, dashes and underscores only")
    spark = deltas.sparkSession
    if _attempts(spark, ledger, batch_id):
        return False
    own = f"attempt={time.time_ns():020d}-{os.urandom(8).hex()}"
    staged = f"{ledger}/_staging/{batch_id}-{own}"
    rollup(deltas).write.parquet(staged)
    fs, folder = _fs(spark, f"{ledger}/batch={batch_id}")
    fs.mkdirs(folder)
    if not fs.rename(_fs(spark, staged)[1], _fs(spark, f"{ledger}/batch={batch_id}/{own}")[1]):
        raise OSError(f"{staged} can't be renamed")
    return _attempts(spark, ledger, batch_id)[0] == own


def totals(spark: SparkSession, ledger: str) -> DataFrame:
    """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
    fs, pattern = _fs(spark, f"{ledger}/batch=*/attempt=*")
    if not fs.globStatus(pattern):
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(f"{LEDGER}, batch string, attempt string").option("basePath", ledger).parquet(f"{ledger}/batch=*/attempt=*")
    sums = rows.groupBy(*KEYS, "batch", "attempt").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    # One row a key and attempt: the attempt that counts is found in a batch's rows by a window.
    first = F.min("attempt").over(Window.partitionBy("batch"))
    return rollup(sums.withColumn("first", first).where("attempt = first")).where("n_docs <> 0 or n_tokens <> 0")
