"""Request columns: range lists, category lists, polygons, budgets, geocoder rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import coordinate_text, filled


def normal_ranges(c: Column) -> Column:
    """Draft form: distinct and sorted."""
    return F.array_sort(F.array_distinct(c))


def strict_ranges(c: Column, most: int = 10) -> Column:
    """Strictly ascending positive numbers, 1 to most of them."""
    return F.coalesce(F.size(c).between(1, most) & F.forall(c, lambda x: x > 0) & (normal_ranges(c) == c), F.lit(False))


def normal_categories(c: Column) -> Column:
    """Trimmed, no blanks, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""))


def validate_isochrones(isochrones: DataFrame, analysis: DataFrame) -> DataFrame:
    """Per analysis: whether exactly one polygon came for each requested range, with what is missing, extra or repeated."""
    got = isochrones.groupBy("analysis_id", "range_minutes").agg(F.count("*").alias("n")).groupBy("analysis_id").agg(F.collect_set("range_minutes").alias("got"), F.array_sort(F.collect_set(F.when(F.col("n") > 1, F.col("range_minutes")))).alias("repeated"))
    d = analysis.join(got.hint("merge"), "analysis_id", "left")
    empty = F.array().cast("array<int>")
    d = d.withColumns({"got": F.coalesce(F.col("got").cast("array<int>"), empty), "repeated": F.coalesce(F.col("repeated").cast("array<int>"), empty)})
    d = d.withColumns({"missing": F.array_sort(F.array_except("ranges", "got")), "extra": F.array_sort(F.array_except("got", "ranges"))})
    return d.select("analysis_id", "missing", "extra", "repeated", ((F.size("missing") == 0) & (F.size("extra") == 0) & (F.size("repeated") == 0)).alias("valid"))


def validate_polygons(df: DataFrame) -> DataFrame:
    """reason for a polygon column: empty, not-finite, out-of-range, open-ring (first and last differ or under four vertices)."""
    rings = F.flatten("polygon")
    points = F.flatten(rings)
    inf = float("inf")
    finite = F.forall(points, lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) != inf) & (F.abs(p["y"]) != inf))
    reason = (
        F.when(F.coalesce(F.size(points), F.lit(0)) <= 0, "empty").when(~finite, "not-finite").when(~F.forall(points, lambda p: p["x"].between(-180, 180) & p["y"].between(-90, 90)), "out-of-range")
        .when(~F.forall(rings, lambda r: (F.size(r) >= 4) & (r[0] == F.element_at(r, -1))), "open-ring")
    )
    return df.withColumn("reason", reason)


def normalize_geocoder(df: DataFrame) -> DataFrame:
    """label (name, else "lon, lat"), context list and candidate id of geocoder rows."""
    label = F.coalesce(filled(F.col("label")), filled(F.col("name")), F.format_string("%.6f, %.6f", F.col("lon"), F.col("lat")))
    context = F.array_distinct(F.filter(F.transform("context", lambda x: F.trim(x)), lambda x: x != ""))
    return df.withColumns({"label": label, "context": context, "candidate_id": F.coalesce(filled(F.col("id")), F.format_string("%.6f,%.6f", F.col("lon"), F.col("lat")))})


def with_coordinate_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("point", coordinate_text(F.col(column)))


def estimate_requests(df: DataFrame, reserve: float = 0.2) -> DataFrame:
    """Budget columns of plans (n_pieces, n_pois, n_sources, budget): matrix batches, least, reserve, most, verdict."""
    per = F.least(F.lit(500), F.greatest(F.lit(1), F.floor(F.lit(3500) / F.col("n_sources"))))
    d = df.withColumn("matrix_batches", F.ceil(F.col("n_pois") / per)).withColumn("least", F.col("n_pieces") + F.col("matrix_batches"))
    d = d.withColumn("reserve", F.ceil(F.col("least") * reserve)).withColumn("most", F.col("least") + F.col("reserve"))
    return d.withColumn("verdict", F.when(F.col("most") <= F.col("budget"), "within-budget").otherwise("approval-required"))


def split_cached(pieces: DataFrame, cache: DataFrame, key: str = "geometry_hash") -> tuple[DataFrame, DataFrame]:
    """(cached, remaining): pieces whose key has a response in cache (key, truncated) that is not truncated, and the others."""
    good = cache.where(~F.coalesce("truncated", F.lit(False))).select(key).distinct()
    return pieces.join(good.hint("merge"), key, "left_semi"), pieces.join(good.hint("merge"), key, "left_anti")
