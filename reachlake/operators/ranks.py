"""Row numbers in order within keys, where one key may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import keep
from .overlay import _meet

#: Rows of a key that one task numbers.
MOST = 1 << 20


def by_size(df: DataFrame, keys: list[str], most: int = MOST) -> tuple[DataFrame, DataFrame | None]:
    """(rows of keys with at most `most` rows, rows of larger keys; None if there are none)."""
    large = keep(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys), "rank-large")
    if large.isEmpty():
        return df, None
    return _meet(df, large, keys, "shuffle_hash", "left_anti"), _meet(df, large, keys, "shuffle_hash", "left_semi")


def ranked(df: DataFrame, keys: list[str], order: list[Column | str], name: str, most: int = MOST) -> DataFrame:
    """df with the row's number from 1 in its key, by `order` (which should be total).

    Keys of at most `most` rows are numbered by a window. Rows of larger ones are range-partitioned by key and order and sorted; a row's number is its place
    in its partition plus the key's rows in the partitions before, so no task holds more of a key than a partition. Null keys are keys.
    """
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    few, many = by_size(df, keys, most)
    return few.withColumn(name, number) if many is None else few.withColumn(name, number.cast("bigint")).unionByName(_spread(many, keys, order, name))


def _spread(df: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    many = keep(many.withColumn("_rank_at", F.monotonically_increasing_id()), "rank-rows").withColumn("_rank_part", F.shiftright("_rank_at", 33))
    starts = many.groupBy(*keys, "_rank_part").agg(F.min("_rank_at").alias("_rank_first"), F.count("*").alias("_rank_count"))
    before = Window.partitionBy(*keys).orderBy("_rank_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*keys, "_rank_part", (F.coalesce(F.sum("_rank_count").over(before), F.lit(0)) - F.col("_rank_first") + 1).alias("_rank_shift"))
    return _meet(many, starts, [*keys, "_rank_part"], "shuffle_hash").withColumn(name, F.col("_rank_at") + F.col("_rank_shift")).drop("_rank_at", "_rank_part", "_rank_shift")


def at_places(df: DataFrame, keys: list[str], value: str, places: dict[str, str]) -> DataFrame:
    """keys and, by name, the value at a place: SQL over n, the key's number of values, that gives a place from 0, or one between two for their interpolation. Nulls are no values.

    For keys of any size: rows are spread by value, and the few at the places are picked.
    """
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_value"))
    sizes = keep(d.groupBy(*keys).agg(F.count("*").alias("n")), "rank-sizes")
    sizes = sizes.select(*keys, *(F.expr(f"CAST({sql} AS DOUBLE)").alias(f"_place_{name}") for name, sql in places.items()))
    d = _meet(_spread(d, keys, ["_value"], "_place"), sizes, keys, "merge").withColumn("_place", F.col("_place") - 1)
    at = lambda name, f: F.max(F.when(F.col("_place") == f(F.col(f"_place_{name}")), F.col("_value")))
    share = lambda name: F.max(F.col(f"_place_{name}") - F.floor(f"_place_{name}"))
    d = d.groupBy(*keys).agg(*(x for name in places for x in (at(name, F.floor).alias(f"_lo_{name}"), at(name, F.ceil).alias(f"_hi_{name}"), share(name).alias(f"_w_{name}"))))
    mixed = lambda name: F.when(F.col(f"_w_{name}") == 0, F.col(f"_lo_{name}")).otherwise((1 - F.col(f"_w_{name}")) * F.col(f"_lo_{name}") + F.col(f"_w_{name}") * F.col(f"_hi_{name}"))
    return d.select(*keys, *(mixed(name).alias(name) for name in places))
