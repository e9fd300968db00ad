"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import keep, scratch

__all__ = ["SPACE", "SPACE_RE", "keep", "lower_ascii", "scratch", "slices", "table", "words_sql"]

#: ASCII white space of the contracts: space and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_ascii(data: bytes) -> bytes:
    """A-Z to a-z on UTF-8 bytes; other characters stay."""
    return data.translate(_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Slices:
    """UTF-8 bytes of each value of an Arrow string or binary array, cut out when asked for; null gives b''."""

    def __init__(self, column):
        import numpy as np
        import pyarrow as pa

        if not pa.types.is_large_binary(column.type):
            column = column.cast(pa.large_binary())
        _, ends, data = column.buffers()
        self.n = len(column)
        self.ends = np.frombuffer(ends, np.int64, self.n + 1, 8 * column.offset).tolist() if self.n else [0]
        self.valid = column.is_valid().to_pylist() if column.null_count else None
        self.data = memoryview(data) if data is not None else memoryview(b"")

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> bytes:
        if i >= self.n:
            raise IndexError(i)
        return b"" if self.valid and not self.valid[i] else bytes(self.data[self.ends[i] : self.ends[i + 1]])


def slices(column) -> Slices:
    return Slices(column)


def words_sql(text: Column) -> Column:
    """Words of a text as an array; null or blank gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RE, -1), lambda w: w != "")
