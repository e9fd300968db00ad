"""Exact travel times: response arrays, status and band rules, the strict join, and its audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .overlay import _meet
from .ranks import MOST, at_places, by_size

BANDS = ((600, "ring-0-10"), (1200, "ring-10-20"), (1800, "ring-20-30"))
OUT_OF_RANGE = "matrix-out-of-range"


def finite(c: Column) -> Column:
    """A finite double, or null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def matrix_status(duration: Column, distance: Column, same_snap: Column | None = None) -> Column:
    """unreachable if either value is null; invalid if negative or not finite, or zero without a shared snap point; else ok."""
    bad = finite(duration).isNull() | finite(distance).isNull() | (duration < 0) | (distance < 0)
    zero = (duration == 0) & ~(F.lit(False) if same_snap is None else same_snap)
    return F.when(duration.isNull() | distance.isNull(), "unreachable").when(bad | zero, "invalid").otherwise("ok")


def time_band(duration: Column, bands=BANDS) -> Column:
    """Right-closed bands; beyond the last one out of range."""
    out = F.lit(OUT_OF_RANGE)
    for limit, name in reversed(bands):
        out = F.when(duration <= limit, name).otherwise(out)
    return F.when(duration.isNotNull(), out)


def with_status(acc: DataFrame) -> DataFrame:
    d = acc.withColumn("status", matrix_status(F.col("duration_s"), F.col("distance_m")))
    return d.withColumn("band", F.when(F.col("status") == "ok", time_band(F.col("duration_s"))))


def explode_matrix(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (batch columns, poi_id, position, duration_s, distance_m) from 1 x N responses, and rejected batches.

    Columns poi_ids, durations, distances (arrays of one array). A batch whose sizes differ is rejected whole.
    """
    n = F.size("poi_ids")
    ok = F.coalesce((F.size("durations") == 1) & (F.size("distances") == 1) & (F.size(F.col("durations")[0]) == n) & (F.size(F.col("distances")[0]) == n), F.lit(False))
    rest = [c for c in batches.columns if c not in ("poi_ids", "durations", "distances")]
    rows = batches.where(ok).select(*rest, F.posexplode(F.arrays_zip("poi_ids", F.col("durations")[0].alias("d"), F.col("distances")[0].alias("m"))).alias("position", "z"))
    return rows.select(*rest, "position", F.col("z.poi_ids").alias("poi_id"), F.col("z.d").alias("duration_s"), F.col("z.m").alias("distance_m")), batches.where(~ok).select(*rest, F.lit("dimension-mismatch").alias("reason"))


def publish_accessibility(poi: DataFrame, acc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strict one-to-one join by (analysis_id, poi_id): (published rows, violations).

    Violations: duplicate-poi, duplicate-accessibility, missing-accessibility, extra-accessibility, non-positive-ok.
    An analysis with any violation publishes nothing. Both sides are counted by key before they meet, so
    repeats never multiply.
    """
    keys = ["analysis_id", "poi_id"]
    p = poi.groupBy(*keys).agg(F.count("*").alias("n_poi"), F.first("spatial_ring", ignorenulls=True).alias("spatial_ring"))
    a = with_status(acc).groupBy(*keys).agg(F.count("*").alias("n_acc"), F.max(F.struct("status", "band", "duration_s", "distance_m")).alias("a"))
    both = p.join(a.hint("merge"), keys, "full_outer")
    zero = F.coalesce((F.col("a.status") == "ok") & (F.col("a.duration_s") <= 0), F.lit(False))
    found = F.array_compact(F.array(
        F.when(F.col("n_poi") > 1, "duplicate-poi"), F.when(F.col("n_acc") > 1, "duplicate-accessibility"), F.when(F.col("n_acc").isNull(), "missing-accessibility"),
        F.when(F.col("n_poi").isNull(), "extra-accessibility"), F.when(zero, "non-positive-ok"),
    ))
    both = both.withColumn("found", found)
    violations = both.select(*keys, F.explode("found").alias("violation"))
    bad = violations.select("analysis_id").distinct()
    status = F.when(F.col("a.status") == "unreachable", "null").otherwise(F.col("a.status"))
    good = both.join(bad.hint("merge"), "analysis_id", "left_anti").select(*keys, "spatial_ring", status.alias("matrix_status"), F.coalesce("a.band", F.concat(F.lit("matrix-"), status)).alias("ring_id"), F.when(status == "ok", F.col("a.duration_s")).alias("travel_time_s"), F.when(status == "ok", F.col("a.distance_m")).alias("distance_m"))
    return good, violations


def restore_spatial_band(published: DataFrame, spatial: DataFrame) -> DataFrame:
    """ring_id from the spatial assignment where there is one; times cleared."""
    s = spatial.select("analysis_id", "poi_id", F.col("ring_id").alias("_ring"))
    d = published.join(s.hint("merge"), ["analysis_id", "poi_id"], "left").withColumn("ring_id", F.coalesce("_ring", "ring_id"))
    return d.drop("_ring").withColumns({"travel_time_s": F.lit(None).cast("double"), "distance_m": F.lit(None).cast("double")})


def build_eligible(acc: DataFrame, poi: DataFrame, max_s: float = 1800) -> DataFrame:
    """Named points with status ok and 0 < time <= max_s, banded. Points that belong to analyses (analysis_id) meet their own only."""
    keys = ["analysis_id", "poi_id"] if "analysis_id" in poi.columns else ["poi_id"]
    d = with_status(acc).join(poi.hint("merge"), keys).where((F.col("status") == "ok") & (F.col("duration_s") > 0) & (F.col("duration_s") <= max_s))
    return d.where(F.coalesce(F.length(F.trim("name")) > 0, F.lit(False)))


def eligible_pois(published: DataFrame, rings: tuple[str, ...] = tuple(name for _, name in BANDS), max_s: float = 1800) -> DataFrame:
    """Published rows (matrix_status, travel_time_s, ring_id, band, name) that a display may choose from: ok, timed, in the ring of their band, a known ring, named."""
    t = F.col("travel_time_s")
    good = (F.col("matrix_status") == "ok") & (t > 0) & (t <= max_s) & (F.col("ring_id") == F.col("band")) & F.col("ring_id").isin(*rings) & (F.coalesce("name", F.lit("")) != "")
    return published.where(good)


def accessibility_summary(acc: DataFrame) -> DataFrame:
    """Per analysis: requested, ok, null, invalid, out of range, within; with a column spatial_ring also mismatch: ok rows whose ring is not their band."""
    d = with_status(acc)
    ok = F.col("status") == "ok"
    more = [F.count_if(ok & ~F.col("spatial_ring").eqNullSafe(F.col("band"))).alias("mismatch")] if "spatial_ring" in acc.columns else []
    return d.groupBy("analysis_id").agg(
        F.count("*").alias("requested"), F.count_if(ok).alias("ok"), F.count_if(F.col("status") == "unreachable").alias("null_count"), F.count_if(F.col("status") == "invalid").alias("invalid"),
        F.count_if(F.col("band") == OUT_OF_RANGE).alias("out_of_range"), F.count_if(ok & (F.col("band") != OUT_OF_RANGE)).alias("within"), *more,
    )


def distribution(acc: DataFrame, most: int = MOST) -> DataFrame:
    """Per analysis, over ok rows: min, median (middle pair averaged), nearest-rank p90 and max of time and distance. Values of an analysis of over `most` rows are
    never in one buffer: their order is spread over tasks."""
    few, many = by_size(with_status(acc).where("status = 'ok'"), ["analysis_id"], most)

    def summary(d: DataFrame, middle: bool) -> DataFrame:
        out = []
        for c, name in (("duration_s", "time"), ("distance_m", "distance")):
            out += [F.round(F.min(c), 3).alias(f"{name}_min"), F.round(F.max(c), 3).alias(f"{name}_max")]
            if middle:
                out += [F.round(F.median(c), 3).alias(f"{name}_median"), F.round(F.expr(f"percentile_disc(0.9) within group (order by {c})"), 3).alias(f"{name}_p90")]
        return d.groupBy("analysis_id").agg(F.count("*").alias("n"), *out)

    names = ["analysis_id", "n", *(f"{x}_{y}" for x in ("time", "distance") for y in ("min", "median", "p90", "max"))]
    found = summary(few, True).select(*names)
    if many is None:
        return found
    large = summary(many, False)
    for c, name in (("duration_s", "time"), ("distance_m", "distance")):
        places = at_places(many, ["analysis_id"], c, {"median": "(n - 1) / 2", "p90": "ceil(0.9 * n) - 1"})
        large = _meet(large, places.select("analysis_id", *(F.round(x, 3).alias(f"{name}_{x}") for x in ("median", "p90"))), ["analysis_id"], "merge", "left")
    return found.unionByName(large.select(*names))


def band_migration(published: DataFrame) -> DataFrame:
    """Counts from the spatial ring to the published one, per analysis."""
    return published.groupBy("analysis_id", F.coalesce("spatial_ring", F.lit("none")).alias("from_ring"), F.col("ring_id").alias("to_ring")).agg(F.count("*").alias("n"))


def conservation(acc: DataFrame) -> DataFrame:
    """within + out of range + null + invalid = requested, and the bands sum to ok; with both sides of each."""
    bands = [F.count_if(F.col("band") == name).alias(name.replace("-", "_")) for _, name in BANDS]
    by = with_status(acc).groupBy("analysis_id").agg(*bands)
    s = accessibility_summary(acc).join(by.hint("merge"), "analysis_id")
    parts = F.col("within") + F.col("out_of_range") + F.col("null_count") + F.col("invalid")
    in_bands = F.col("out_of_range") + sum((F.col(name.replace("-", "_")) for _, name in BANDS), F.lit(0))
    return s.select("analysis_id", "requested", parts.alias("parts"), "ok", in_bands.alias("in_bands"), (parts == F.col("requested")).alias("total_ok"), (in_bands == F.col("ok")).alias("bands_ok"))


def band_members(published: DataFrame, rings: DataFrame) -> DataFrame:
    """Per (analysis_id, ring_id) of rings: count and the ordered list of poi ids, empty rings included. The ids of one ring of one analysis have to fit a row."""
    m = published.groupBy("analysis_id", "ring_id").agg(F.array_sort(F.collect_list("poi_id")).alias("poi_ids"))
    d = rings.join(m.hint("merge"), ["analysis_id", "ring_id"], "left").withColumn("poi_ids", F.coalesce("poi_ids", F.array().cast("array<string>")))
    return d.withColumn("n", F.size("poi_ids"))


def normalization_summary(published: DataFrame) -> DataFrame:
    """Status and band counts, zero bands included, and whether every ok row has time, distance and its own band."""
    ok = F.col("matrix_status") == "ok"
    bands = [F.count_if(F.col("ring_id") == b).alias(b.replace("-", "_")) for b in (*(n for _, n in BANDS), OUT_OF_RANGE)]
    sound = ~ok | (F.col("travel_time_s").isNotNull() & F.col("distance_m").isNotNull() & (time_band(F.col("travel_time_s")) == F.col("ring_id")))
    return published.groupBy("analysis_id").agg(F.count_if(ok).alias("ok"), F.count_if(F.col("matrix_status") == "null").alias("null_count"), F.count_if(F.col("matrix_status") == "invalid").alias("invalid"), *bands, F.every(sound).alias("sound"))


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: ids only in a, only in b, and whether the sets are equal. Ids are made distinct before they meet."""
    j = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)).hint("merge"), key, "full_outer")
    return j.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b")).withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def data_audit(poi: DataFrame) -> DataFrame:
    """Per analysis: rows, duplicate ids, ids with conflicting coordinates, missing names, invalid coordinates."""
    valid = F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)
    by = poi.groupBy("analysis_id", "poi_id").agg(
        F.count("*").alias("n"), ((F.min("lon") != F.max("lon")) | (F.min("lat") != F.max("lat"))).alias("conflict"),
        F.count_if(F.coalesce(F.trim("name"), F.lit("")) == "").alias("unnamed"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("bad"),
    )
    return by.groupBy("analysis_id").agg(F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 1).alias("duplicate_ids"), F.count_if("conflict").alias("conflicting_ids"), F.sum("unnamed").alias("missing_names"), F.sum("bad").alias("invalid_coordinates"))


def join_integrity(poi: DataFrame, acc: DataFrame) -> DataFrame:
    """Per analysis: unique ids on both sides, equal id sets, and ok rows with a time."""
    p = poi.groupBy("analysis_id", "poi_id").agg(F.count("*").alias("np"))
    a = with_status(acc).groupBy("analysis_id", "poi_id").agg(F.count("*").alias("na"), F.every((F.col("status") != "ok") | F.col("duration_s").isNotNull()).alias("timed"))
    j = p.join(a.hint("merge"), ["analysis_id", "poi_id"], "full_outer")
    return j.groupBy("analysis_id").agg(F.every(F.coalesce(F.col("np"), F.lit(1)) == 1).alias("poi_unique"), F.every(F.coalesce(F.col("na"), F.lit(1)) == 1).alias("acc_unique"), F.every(F.col("np").isNotNull() & F.col("na").isNotNull()).alias("same_ids"), F.every(F.coalesce("timed", F.lit(True))).alias("ok_timed"))


def row_text(df: DataFrame, columns: list[str]) -> Column:
    """A row's columns joined by bars, null empty, doubles at seven decimals, so other engines can write the same text."""
    real = [c for c, kind in df.dtypes if kind in ("double", "float")]
    return F.concat_ws("|", *(F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.7f", c)) if c in real else F.col(c).cast("string"), F.lit("")) for c in columns))


def set_hashes(text: Column) -> list[Column]:
    """Two aggregates over row texts, as text: sums of two 60-bit parts of each row's SHA-256. Order-free, and repeated rows count."""
    part = lambda at: F.conv(F.substring(F.sha2(text, 256), at, 15), 16, 10).cast("decimal(20,0)")
    return [F.coalesce(F.sum(part(at)), F.lit(0)).cast("decimal(38,0)").cast("string").alias(name) for at, name in ((1, "fp_a"), (16, "fp_b"))]


def result_fingerprint(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Order-free fingerprint of each key's rows: their number and two sums of hashes."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), *set_hashes(row_text(rows, columns)))


def latest_by_key(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The row with the greatest (at, tie) of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r")).select(*keys, "r.*")
