"""A query for each operator over the driver's tables, with the SQL that DuckDB runs beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import categories, layout, ledger, pieces, publish, requests, selection, spatial, tiles
from ..sources import datasets, features
from .fixtures import run_sql, view
from .registry import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES"]


def isochrones(s: SparkSession, d: str) -> DataFrame:
    return spatial.edges_to_polygons(view(s, d, "v_edge"), ["analysis_id", "range_minutes"])


def isochrone_polygons(s: SparkSession, d: str) -> DataFrame:
    v = view(s, d, "v_ring_vertex").groupBy("analysis_id", "range_minutes").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("r"))
    return v.select("analysis_id", "range_minutes", F.array(F.array("r")).alias("polygon"))


def rings_of(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "v_edge").select("analysis_id", F.col("range_minutes").alias("outer_minutes")).distinct()


def assigned(s: SparkSession, d: str) -> DataFrame:
    return spatial.assign_rings(view(s, d, "v_poi"), isochrones(s, d))


# ---- spatial joins ----


@query("SELECT r.analysis_id, r.outer_minutes, COALESCE(n, 0) AS poi_count FROM (SELECT DISTINCT analysis_id, range_minutes AS outer_minutes FROM v_edge) r LEFT JOIN (SELECT analysis_id, outer_minutes, COUNT(*) AS n FROM v_ring_poi GROUP BY 1, 2) c ON c.analysis_id = r.analysis_id AND c.outer_minutes = r.outer_minutes")
def flagship_ring_counts(s, d):
    return spatial.ring_counts(rings_of(s, d), assigned(s, d)).select("analysis_id", "outer_minutes", "poi_count")


@query("""SELECT analysis_id, range_minutes, COUNT(*) AS n FROM (SELECT c.analysis_id, c.range_minutes, c.poi_id,
 SUM(CASE WHEN (e.y1 > c.lat) <> (e.y2 > c.lat) AND c.lon < (e.x2-e.x1)*(c.lat-e.y1)/(e.y2-e.y1)+e.x1 THEN 1 ELSE 0 END) AS crossings,
 MAX(CASE WHEN (e.x2-e.x1)*(c.lat-e.y1) = (e.y2-e.y1)*(c.lon-e.x1) AND c.lon BETWEEN LEAST(e.x1,e.x2) AND GREATEST(e.x1,e.x2) AND c.lat BETWEEN LEAST(e.y1,e.y2) AND GREATEST(e.y1,e.y2) THEN 1 ELSE 0 END) AS on_edge
 FROM (SELECT b.*, p.poi_id, p.lon, p.lat FROM (SELECT analysis_id, range_minutes, MIN(x1) x0, MAX(x1) xm, MIN(y1) y0, MAX(y1) ym FROM v_edge GROUP BY 1,2) b JOIN v_poi p ON p.lon BETWEEN x0 AND xm AND p.lat BETWEEN y0 AND ym) c
 JOIN v_edge e ON e.analysis_id=c.analysis_id AND e.range_minutes=c.range_minutes GROUP BY 1,2,3) h WHERE crossings % 2 = 1 OR on_edge = 1 GROUP BY 1, 2""")
def c1_points_in_polygons(s, d):
    return spatial.points_in_polygons(view(s, d, "v_poi"), isochrones(s, d)).groupBy("analysis_id", "range_minutes").agg(F.count("*").alias("n"))


@query("SELECT analysis_id, poi_id, outer_minutes FROM v_ring_poi")
def c2_assign_rings(s, d):
    return assigned(s, d)


@query("SELECT b.analysis_id, COUNT(*) AS n, MIN(p.k) AS first_k, MAX(p.k) AS last_k FROM (SELECT analysis_id, MIN(x1) w, MAX(x1) e, MIN(y1) s, MAX(y1) n FROM v_edge GROUP BY 1) b JOIN v_poi p ON p.lon BETWEEN w AND e AND p.lat BETWEEN s AND n GROUP BY 1")
def c3_bbox_candidates(s, d):
    box = view(s, d, "v_edge").groupBy("analysis_id").agg(F.min("x1").alias("west"), F.max("x1").alias("east"), F.min("y1").alias("south"), F.max("y1").alias("north"))
    return spatial.bbox_candidates(view(s, d, "v_poi"), box).groupBy("analysis_id").agg(F.count("*").alias("n"), F.min("k").alias("first_k"), F.max("k").alias("last_k"))


@query("""SELECT analysis_id, ring_id, COUNT(*) AS n, ROUND(MAX(m), 3) AS farthest FROM (SELECT *, CASE WHEN m <= 500 THEN 'ring-preview-500' WHEN m <= 1000 THEN 'ring-preview-1000' ELSE 'ring-preview-2000' END AS ring_id FROM
 (SELECT a.analysis_id, 2*6371008.8*ASIN(LEAST(1, SQRT(POWER(SIN(RADIANS(p.lat-a.lat)/2),2)+COS(RADIANS(a.lat))*COS(RADIANS(p.lat))*POWER(SIN(RADIANS(p.lon-a.lon)/2),2)))) AS m FROM v_analysis a JOIN v_poi p ON p.lat BETWEEN a.lat - 0.02 AND a.lat + 0.02 AND p.lon BETWEEN a.lon - 0.03 AND a.lon + 0.03) x WHERE m <= 2000) y GROUP BY 1, 2""")
def c11_within_radius(s, d):
    c = view(s, d, "v_analysis").select("analysis_id", F.col("lon").alias("clon"), F.col("lat").alias("clat"))
    return spatial.within_radius(view(s, d, "v_poi"), c).groupBy("analysis_id", "ring_id").agg(F.count("*").alias("n"), F.round(F.max("distance_m"), 3).alias("farthest"))


@query("SELECT analysis_id, range_minutes, COALESCE(LAG(range_minutes) OVER (PARTITION BY analysis_id ORDER BY range_minutes), 0) AS inner_minutes, CONCAT('ring-', COALESCE(LAG(range_minutes) OVER (PARTITION BY analysis_id ORDER BY range_minutes), 0), '-', range_minutes) AS ring_id FROM (SELECT DISTINCT analysis_id, range_minutes FROM v_edge) t")
def e5_ring_bounds(s, d):
    return spatial.ring_bounds(view(s, d, "v_edge").select("analysis_id", "range_minutes").distinct())


@query("SELECT analysis_id, CASE WHEN COUNT(*) > 1500 THEN 'candidate-limit' ELSE 'ok' END AS status, COUNT(*) AS n FROM v_ring_poi GROUP BY 1")
def f3_candidate_guard(s, d):
    return spatial.candidate_guard(assigned(s, d), 1500).groupBy("analysis_id", "status").agg(F.count("*").alias("n"))


@query("SELECT analysis_id, MIN(x1) AS west, MIN(y1) AS south, MAX(x1) AS east, MAX(y1) AS north FROM v_edge GROUP BY 1")
def d19_envelopes(s, d):
    p = isochrone_polygons(s, d).withColumn("b", geo.bbox(F.col("polygon")))
    return p.groupBy("analysis_id").agg(F.min("b.west").alias("west"), F.min("b.south").alias("south"), F.max("b.east").alias("east"), F.max("b.north").alias("north"))


# ---- exact times ----

_STATUS = "CASE WHEN duration_s IS NULL OR distance_m IS NULL THEN 'unreachable' WHEN duration_s <= 0 OR distance_m < 0 THEN 'invalid' ELSE 'ok' END"
_BAND = "CASE WHEN duration_s <= 600 THEN 'ring-0-10' WHEN duration_s <= 1200 THEN 'ring-10-20' WHEN duration_s <= 1800 THEN 'ring-20-30' ELSE 'matrix-out-of-range' END"
_ACC = f"(SELECT *, {_STATUS} AS status, CASE WHEN {_STATUS} = 'ok' THEN {_BAND} END AS band FROM v_accessibility)"


@query(f"SELECT analysis_id, status, COALESCE(band, '-') AS band, COUNT(*) AS n FROM {_ACC} a GROUP BY 1, 2, 3")
def h20_status_and_band(s, d):
    return publish.with_status(view(s, d, "v_accessibility")).groupBy("analysis_id", "status", F.coalesce("band", F.lit("-")).alias("band")).agg(F.count("*").alias("n"))


@query(f"SELECT analysis_id, COUNT(*) AS requested, COUNT(*) FILTER (status = 'ok') AS ok, COUNT(*) FILTER (status = 'unreachable') AS null_count, COUNT(*) FILTER (status = 'invalid') AS invalid, COUNT(*) FILTER (band = 'matrix-out-of-range') AS out_of_range, COUNT(*) FILTER (status = 'ok' AND band <> 'matrix-out-of-range') AS within, COUNT(*) FILTER (status = 'ok' AND band <> CASE k % 3 WHEN 0 THEN 'ring-0-10' WHEN 1 THEN 'ring-10-20' ELSE 'ring-20-30' END) AS mismatch FROM (SELECT c.*, p.k FROM {_ACC} c JOIN v_poi p ON p.poi_id = c.poi_id) a GROUP BY 1")
def d7_accessibility_summary(s, d):
    acc = run_sql(s, d, "SELECT a.*, CASE p.k % 3 WHEN 0 THEN 'ring-0-10' WHEN 1 THEN 'ring-10-20' ELSE 'ring-20-30' END AS spatial_ring FROM v_accessibility a JOIN v_poi p ON p.poi_id = a.poi_id")
    return publish.accessibility_summary(acc)


@query(f"SELECT analysis_id, COUNT(*) AS n, MIN(duration_s) AS time_min, MEDIAN(duration_s) AS time_median, quantile_disc(duration_s, 0.9) AS time_p90, MAX(duration_s) AS time_max, MIN(distance_m) AS distance_min, MEDIAN(distance_m) AS distance_median, quantile_disc(distance_m, 0.9) AS distance_p90, MAX(distance_m) AS distance_max FROM {_ACC} a WHERE status = 'ok' GROUP BY 1")
def d8_distribution(s, d):
    return publish.distribution(view(s, d, "v_accessibility"))


@query(f"""SELECT *, parts = requested AS total_ok, in_bands = ok AS bands_ok FROM (SELECT analysis_id, COUNT(*) AS requested, COUNT(*) FILTER (status = 'ok' AND duration_s <= 1800) + COUNT(*) FILTER (status = 'ok' AND duration_s > 1800) + COUNT(*) FILTER (status = 'unreachable') + COUNT(*) FILTER (status = 'invalid') AS parts,
 COUNT(*) FILTER (status = 'ok') AS ok, COUNT(*) FILTER (status = 'ok' AND duration_s <= 600) + COUNT(*) FILTER (status = 'ok' AND duration_s > 600 AND duration_s <= 1200) + COUNT(*) FILTER (status = 'ok' AND duration_s > 1200 AND duration_s <= 1800) + COUNT(*) FILTER (status = 'ok' AND duration_s > 1800) AS in_bands FROM {_ACC} a GROUP BY 1) t""")
def d10_conservation(s, d):
    return publish.conservation(view(s, d, "v_accessibility"))


#: Rows for the strict join: every point of an accessibility row, with repeats, gaps and extras in six analyses.
_STRICT_POI = "SELECT analysis_id, poi_id, CASE WHEN k % 3 = 0 THEN 'ring-0-10' WHEN k % 3 = 1 THEN 'ring-10-20' ELSE 'ring-20-30' END AS spatial_ring FROM (SELECT a.analysis_id, a.poi_id, p.k FROM v_accessibility a JOIN v_poi p ON p.poi_id = a.poi_id) t WHERE NOT (analysis_id = 4 AND k % 50 = 0) UNION ALL SELECT 7, 'poi:none', 'ring-0-10' UNION ALL SELECT analysis_id, poi_id, 'ring-0-10' FROM v_accessibility WHERE analysis_id = 9 AND distance_m < 1000"
_STRICT_ACC = "SELECT analysis_id, poi_id, duration_s, distance_m FROM v_accessibility UNION ALL SELECT analysis_id, poi_id, duration_s, distance_m FROM v_accessibility WHERE analysis_id = 12 AND distance_m < 500 UNION ALL SELECT 13, 'poi:extra', 5.5, 1.0"
_VIOLATIONS = f"""WITH p AS (SELECT analysis_id, poi_id, COUNT(*) AS np, MIN(spatial_ring) AS spatial_ring FROM ({_STRICT_POI}) x GROUP BY 1, 2), a AS (SELECT analysis_id, poi_id, COUNT(*) AS na, MAX(duration_s) AS duration_s, MAX(distance_m) AS distance_m FROM ({_STRICT_ACC}) y GROUP BY 1, 2),
 j AS (SELECT COALESCE(p.analysis_id, a.analysis_id) AS analysis_id, COALESCE(p.poi_id, a.poi_id) AS poi_id, np, na, spatial_ring, duration_s, distance_m, {_STATUS} AS status, {_BAND} AS band0 FROM p FULL OUTER JOIN a ON a.analysis_id = p.analysis_id AND a.poi_id = p.poi_id),
 v AS (SELECT analysis_id, poi_id, 'duplicate-poi' AS violation FROM j WHERE np > 1 UNION ALL SELECT analysis_id, poi_id, 'duplicate-accessibility' FROM j WHERE na > 1 UNION ALL SELECT analysis_id, poi_id, 'missing-accessibility' FROM j WHERE na IS NULL UNION ALL SELECT analysis_id, poi_id, 'extra-accessibility' FROM j WHERE np IS NULL),
 pub AS (SELECT analysis_id, poi_id, spatial_ring, CASE status WHEN 'unreachable' THEN 'null' ELSE status END AS matrix_status, CASE WHEN status = 'ok' THEN band0 WHEN status = 'unreachable' THEN 'matrix-null' ELSE 'matrix-invalid' END AS ring_id, CASE WHEN status = 'ok' THEN duration_s END AS travel_time_s, CASE WHEN status = 'ok' THEN distance_m END AS distance_m FROM j WHERE analysis_id NOT IN (SELECT analysis_id FROM v))"""


def published(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return publish.publish_accessibility(run_sql(s, d, _STRICT_POI), run_sql(s, d, _STRICT_ACC))


@query(f"{_VIOLATIONS} SELECT * FROM pub")
def c5_publish(s, d):
    return published(s, d)[0]


@query(f"{_VIOLATIONS} SELECT * FROM v")
def c5_violations(s, d):
    return published(s, d)[1]


@query(f"{_VIOLATIONS} SELECT pub.analysis_id, pub.poi_id, CASE WHEN r.outer_minutes IS NULL THEN ring_id ELSE CONCAT('ring-', r.outer_minutes - 10, '-', r.outer_minutes) END AS ring_id FROM pub LEFT JOIN v_ring_poi r ON r.analysis_id = pub.analysis_id AND r.poi_id = pub.poi_id")
def c6_restore_spatial_band(s, d):
    r = assigned(s, d).select("analysis_id", "poi_id", F.concat(F.lit("ring-"), (F.col("outer_minutes") - 10).cast("string"), F.lit("-"), F.col("outer_minutes").cast("string")).alias("ring_id"))
    return publish.restore_spatial_band(published(s, d)[0], r).select("analysis_id", "poi_id", "ring_id")


@query(f"{_VIOLATIONS} SELECT analysis_id, spatial_ring AS from_ring, ring_id AS to_ring, COUNT(*) AS n FROM pub GROUP BY 1, 2, 3")
def d9_band_migration(s, d):
    return publish.band_migration(published(s, d)[0])


@query(f"""{_VIOLATIONS}, moved AS (SELECT *, CASE WHEN analysis_id % 5 = 3 AND travel_time_s < 100 THEN 'ring-20-30' ELSE ring_id END AS ring, CASE WHEN analysis_id % 7 = 2 AND travel_time_s > 1700 THEN NULL ELSE distance_m END AS dist FROM pub)
SELECT analysis_id, COUNT(*) FILTER (matrix_status = 'ok') AS ok, COUNT(*) FILTER (matrix_status = 'null') AS null_count, COUNT(*) FILTER (matrix_status = 'invalid') AS invalid,
 COUNT(*) FILTER (ring = 'ring-0-10') AS ring_0_10, COUNT(*) FILTER (ring = 'ring-10-20') AS ring_10_20, COUNT(*) FILTER (ring = 'ring-20-30') AS ring_20_30, COUNT(*) FILTER (ring = 'matrix-out-of-range') AS matrix_out_of_range,
 COUNT(*) FILTER (matrix_status = 'ok' AND (travel_time_s IS NULL OR dist IS NULL OR ring <> CASE WHEN travel_time_s <= 600 THEN 'ring-0-10' WHEN travel_time_s <= 1200 THEN 'ring-10-20' WHEN travel_time_s <= 1800 THEN 'ring-20-30' ELSE 'matrix-out-of-range' END)) = 0 AS sound FROM moved GROUP BY 1""")
def d11_normalization_summary(s, d):
    """Some analyses have a row in a wrong ring, others an ok row without a distance."""
    a, t = F.col("analysis_id"), F.col("travel_time_s")
    moved = F.when((a % 5 == 3) & (t < 100), "ring-20-30").otherwise(F.col("ring_id"))
    return publish.normalization_summary(published(s, d)[0].withColumns({"ring_id": moved, "distance_m": F.when(~F.coalesce((a % 7 == 2) & (t > 1700), F.lit(False)), F.col("distance_m"))}))


@query(f"{_VIOLATIONS}, r AS (SELECT DISTINCT a.analysis_id, t.ring_id FROM v_analysis a CROSS JOIN (VALUES ('ring-0-10'), ('ring-10-20'), ('ring-20-30')) t(ring_id)) SELECT r.analysis_id, r.ring_id, COUNT(poi_id) AS n, COALESCE(STRING_AGG(poi_id, ',' ORDER BY poi_id), '') AS ids FROM r LEFT JOIN pub ON pub.analysis_id = r.analysis_id AND pub.ring_id = r.ring_id GROUP BY 1, 2")
def d30_band_members(s, d):
    rings = spatial.ring_bounds(view(s, d, "v_edge").select("analysis_id", "range_minutes").distinct()).select("analysis_id", "ring_id")
    return publish.band_members(published(s, d)[0], rings).select("analysis_id", "ring_id", F.col("n").cast("bigint").alias("n"), F.array_join("poi_ids", ",").alias("ids"))


@query(f"SELECT analysis_id, band, COUNT(*) AS n, MIN(k) AS first_k FROM {_ACC} a JOIN v_poi p ON p.poi_id = a.poi_id WHERE status = 'ok' AND duration_s <= 1800 GROUP BY 1, 2")
def c7_build_eligible(s, d):
    poi = view(s, d, "v_poi").withColumn("name", F.col("poi_id"))
    return publish.build_eligible(view(s, d, "v_accessibility"), poi).groupBy("analysis_id", "band").agg(F.count("*").alias("n"), F.min("k").alias("first_k"))


@query("""WITH t AS (SELECT plan_id AS analysis_id, source_id AS poi_id, CASE WHEN pos % 13 = 0 THEN lon + 200 WHEN pos % 19 = 0 THEN NULL ELSE lon END AS lon, lat, CASE WHEN pos % 9 = 0 THEN ' ' WHEN pos % 10 = 0 THEN NULL ELSE name END AS name FROM v_piece_result),
 b AS (SELECT analysis_id, poi_id, COUNT(*) AS n, MIN(lon) <> MAX(lon) OR MIN(lat) <> MAX(lat) AS conflict, COUNT(*) FILTER (COALESCE(TRIM(name), '') = '') AS unnamed, COUNT(*) FILTER (NOT COALESCE(lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90, FALSE)) AS bad FROM t GROUP BY 1, 2)
SELECT analysis_id, CAST(SUM(n) AS BIGINT) AS n_rows, COUNT(*) FILTER (n > 1) AS duplicate_ids, COUNT(*) FILTER (conflict) AS conflicting_ids, CAST(SUM(unnamed) AS BIGINT) AS missing_names, CAST(SUM(bad) AS BIGINT) AS invalid_coordinates FROM b GROUP BY 1""")
def d12_data_audit(s, d):
    """Rows without an id are one id of their own; some names are blank or null, some coordinates wrong or null."""
    p = F.col("pos")
    lon = F.when(p % 13 == 0, F.col("lon") + 200).when(p % 19 != 0, F.col("lon"))
    t = view(s, d, "v_piece_result").select(F.col("plan_id").alias("analysis_id"), F.col("source_id").alias("poi_id"), lon.alias("lon"), "lat", F.when(p % 9 == 0, " ").when(p % 10 != 0, F.col("name")).alias("name"))
    return publish.data_audit(t)


@query(f"WITH p AS (SELECT analysis_id, poi_id, COUNT(*) AS np FROM ({_STRICT_POI}) x GROUP BY 1, 2), a AS (SELECT analysis_id, poi_id, COUNT(*) AS na FROM ({_STRICT_ACC}) y GROUP BY 1, 2) SELECT COALESCE(p.analysis_id, a.analysis_id) AS analysis_id, BOOL_AND(COALESCE(np, 1) = 1) AS poi_unique, BOOL_AND(COALESCE(na, 1) = 1) AS acc_unique, BOOL_AND(np IS NOT NULL AND na IS NOT NULL) AS same_ids, TRUE AS ok_timed FROM p FULL OUTER JOIN a ON a.analysis_id = p.analysis_id AND a.poi_id = p.poi_id GROUP BY 1")
def d13_join_integrity(s, d):
    return publish.join_integrity(run_sql(s, d, _STRICT_POI), run_sql(s, d, _STRICT_ACC))


@query("SELECT (SELECT COUNT(*) FROM (SELECT poi_id FROM v_poi EXCEPT SELECT poi_id FROM v_ring_poi) a) AS only_a, (SELECT COUNT(*) FROM (SELECT poi_id FROM v_ring_poi EXCEPT SELECT poi_id FROM v_poi) b) AS only_b, (SELECT COUNT(*) FROM (SELECT poi_id FROM v_poi EXCEPT SELECT poi_id FROM v_ring_poi) c) = 0 AS equal")
def g3_same_ids(s, d):
    return publish.same_ids(view(s, d, "v_poi"), assigned(s, d), "poi_id")


@query(r"""WITH r AS (SELECT analysis_id, sha256(concat_ws('|', poi_id, COALESCE(printf('%.7f', duration_s), ''), COALESCE(printf('%.7f', distance_m), ''))) AS h FROM v_accessibility)
SELECT analysis_id, COUNT(*) AS n, CAST(SUM(CAST(CONCAT('0x', SUBSTRING(h, 1, 15)) AS BIGINT)) AS VARCHAR) AS fp_a, CAST(SUM(CAST(CONCAT('0x', SUBSTRING(h, 16, 15)) AS BIGINT)) AS VARCHAR) AS fp_b FROM r GROUP BY 1""")
def d26_result_fingerprint(s, d):
    return publish.result_fingerprint(view(s, d, "v_accessibility"), "analysis_id", ["poi_id", "duration_s", "distance_m"])


@query("SELECT analysis_id, CAST(batch AS BIGINT) AS batch, COUNT(*) AS n, MIN(poi_id) AS first_id, MAX(poi_id) AS last_id, sha256(STRING_AGG(poi_id, '|' ORDER BY poi_id)) AS fingerprint FROM (SELECT analysis_id, poi_id, FLOOR((ROW_NUMBER() OVER (PARTITION BY analysis_id ORDER BY poi_id) - 1) / 500) AS batch FROM v_accessibility) t GROUP BY 1, 2")
def e6_matrix_batches(s, d):
    return selection.matrix_batches(view(s, d, "v_accessibility")).select("analysis_id", "batch", F.col("n").cast("bigint").alias("n"), F.get("poi_ids", F.lit(0)).alias("first_id"), F.element_at("poi_ids", -1).alias("last_id"), "fingerprint")


@query("SELECT analysis_id, poi_id, CAST((ROW_NUMBER() OVER (PARTITION BY analysis_id ORDER BY poi_id) - 1) % 500 AS BIGINT) AS position, duration_s, distance_m FROM v_accessibility")
def a11_explode_matrix(s, d):
    acc = view(s, d, "v_accessibility")
    b = selection.matrix_batches(acc).select("analysis_id", "batch", "poi_ids")
    m = acc.join(b.select("analysis_id", "batch", F.explode("poi_ids").alias("poi_id")).hint("merge"), ["analysis_id", "poi_id"]).groupBy("analysis_id", "batch").agg(F.array_sort(F.collect_list(F.struct("poi_id", "duration_s", "distance_m"))).alias("r"))
    resp = b.join(m.hint("merge"), ["analysis_id", "batch"]).select("analysis_id", "poi_ids", F.array(F.transform("r", lambda x: x["duration_s"])).alias("durations"), F.array(F.transform("r", lambda x: x["distance_m"])).alias("distances"))
    return publish.explode_matrix(resp)[0].select("analysis_id", "poi_id", F.col("position").cast("bigint").alias("position"), "duration_s", "distance_m")


@query("""WITH b AS (SELECT DISTINCT analysis_id, CAST(FLOOR((ROW_NUMBER() OVER (PARTITION BY analysis_id ORDER BY poi_id) - 1) / 500) AS BIGINT) AS batch, COUNT(*) OVER (PARTITION BY analysis_id) AS n FROM v_accessibility)
SELECT analysis_id, CASE WHEN (analysis_id + batch) % 5 = 0 THEN 'missing' WHEN (analysis_id + batch) % 5 = 1 THEN 'wrong-profile' WHEN (analysis_id + batch) % 5 = 2 AND n - batch * 500 > 1 THEN 'wrong-order' ELSE 'ok' END AS verdict, COUNT(*) AS n FROM b GROUP BY 1, 2""")
def c18_validate_batches(s, d):
    """Of every five batches one is missing, one of another profile, one in another order (if it has two ids)."""
    k = (F.col("analysis_id") + F.col("batch")) % 5
    b = selection.matrix_batches(view(s, d, "v_accessibility")).withColumn("k", k).select("analysis_id", "k", F.concat_ws("-", "analysis_id", "batch").alias("batch_id"), F.lit("foot").alias("profile"), "poi_ids")
    back = b.where("k <> 0").withColumns({"profile": F.when(F.col("k") == 1, "car").otherwise("foot"), "poi_ids": F.when(F.col("k") == 2, F.reverse("poi_ids")).otherwise(F.col("poi_ids"))})
    v = selection.validate_batches(b.select("batch_id", "profile", "poi_ids"), back.select("batch_id", "profile", "poi_ids"))
    return v.groupBy(F.split("batch_id", "-")[0].cast("int").alias("analysis_id"), "verdict").agg(F.count("*").alias("n"))


# ---- selection ----

_SCORE = "ROW_NUMBER() OVER (PARTITION BY analysis_id, ring_id ORDER BY COALESCE(rating, importance) DESC NULLS LAST, travel_time_s, poi_id)"
QUOTAS = {"ring-0-10": 20, "ring-10-20": 15, "ring-20-30": 10}
_QUOTA = "CASE ring_id WHEN 'ring-0-10' THEN 20 WHEN 'ring-10-20' THEN 15 ELSE 10 END"


@query(f"SELECT analysis_id, ring_id, poi_id, COALESCE(rating, importance) AS score, {_SCORE} AS rank, {_SCORE} <= {_QUOTA} AS is_selected FROM v_score")
def e2_select_by_quota(s, d):
    return selection.select_by_quota(view(s, d, "v_score"), QUOTAS).select("analysis_id", "ring_id", "poi_id", "score", F.col("rank").cast("bigint").alias("rank"), "is_selected")


@query(f"SELECT analysis_id, COUNT(*) AS matched, COUNT(*) FILTER (rn <= q) AS returned, COUNT(*) FILTER (rn <= q) < COUNT(*) AS truncated FROM (SELECT analysis_id, {_SCORE} AS rn, {_QUOTA} AS q FROM v_score) t GROUP BY 1")
def f4_selection_stats(s, d):
    return selection.selection_stats(selection.select_by_quota(view(s, d, "v_score"), QUOTAS))


@query(f"SELECT missing, missing = 0 AS nested FROM (SELECT COUNT(*) FILTER (rn <= CASE ring_id WHEN 'ring-0-10' THEN 10 WHEN 'ring-10-20' THEN 25 ELSE 5 END AND rn > {_QUOTA}) AS missing FROM (SELECT ring_id, {_SCORE} AS rn FROM v_score) t) u UNION ALL SELECT 0, TRUE")
def g4_nested_presets(s, d):
    """A preset with a larger quota in one ring is not nested; one of half the quotas is."""
    v = view(s, d, "v_score")
    large = selection.select_by_quota(v, QUOTAS)
    wide = selection.nested_presets(selection.select_by_quota(v, {"ring-0-10": 10, "ring-10-20": 25, "ring-20-30": 5}), large)
    return wide.union(selection.nested_presets(selection.select_by_quota(v, {k: n // 2 for k, n in QUOTAS.items()}), large))


_MATCH = "SELECT s.analysis_id, s.ring_id, c.top_id, c.basic_id, c.primary_id, s.poi_id FROM v_score s JOIN v_poi_category c ON c.poi_id = s.poi_id"


def matches(s: SparkSession, d: str) -> DataFrame:
    return run_sql(s, d, _MATCH)


@query(f"SELECT analysis_id, poi_id, position FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY analysis_id ORDER BY rn, ring_id, top_id) AS position FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY analysis_id, ring_id, top_id ORDER BY poi_id) AS rn FROM ({_MATCH}) m) t) u WHERE position <= 100")
def e3_round_robin_fair(s, d):
    return selection.round_robin_limit(matches(s, d), 100).select("analysis_id", "poi_id", F.col("position").cast("bigint").alias("position"))


@query()
def e3_round_robin_exact(s, d):
    return selection.round_robin_limit(matches(s, d), 100, exact=True).select("analysis_id", "poi_id", "position")


@query("""SELECT analysis_id, poi_id, ROUND(12 + 14 * POWER(1 - i / CAST(GREATEST(n - 1, 1) AS DOUBLE), 0.75), 6) AS font_size, ROUND(1 - CAST(0.45 AS DOUBLE) * j / CAST(GREATEST(m - 1, 1) AS DOUBLE), 6) AS opacity FROM (SELECT analysis_id, poi_id,
 ROW_NUMBER() OVER (PARTITION BY analysis_id ORDER BY travel_time_s, poi_id) - 1 AS i, COUNT(*) OVER (PARTITION BY analysis_id) AS n, ROW_NUMBER() OVER (PARTITION BY analysis_id, ring_id ORDER BY travel_time_s, poi_id) - 1 AS j, COUNT(*) OVER (PARTITION BY analysis_id, ring_id) AS m FROM v_score) t""")
def e4_time_visual_model(s, d):
    return selection.time_visual_model(view(s, d, "v_score")).select("analysis_id", "poi_id", "font_size", "opacity")


@query("SELECT analysis_id, poi_id, position FROM (SELECT analysis_id, poi_id, ROW_NUMBER() OVER (PARTITION BY analysis_id ORDER BY travel_time_s, poi_id) AS position FROM v_score) t WHERE position <= 50")
def f2_limit_per_analysis(s, d):
    return selection.limit_per_analysis(view(s, d, "v_score"), 50, "travel_time_s", "poi_id").select("analysis_id", "poi_id", F.col("position").cast("bigint").alias("position"))


@query("SELECT source_key, k, poi_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_key ORDER BY k) AS i FROM v_poi) t WHERE i = 1")
def e1_dedupe_first(s, d):
    return selection.dedupe_first(view(s, d, "v_poi").select("source_key", "k", "poi_id"), ["source_key"], "k")


# ---- categories ----


def paths(s: SparkSession, d: str) -> DataFrame:
    return categories.with_hierarchy(view(s, d, "v_poi_category"), "top_id", "basic_id", "primary_id")


@query("SELECT 'top' AS level, top_id AS category_id, COUNT(*) AS n FROM v_poi_category GROUP BY 2 UNION ALL SELECT 'basic', basic_id, COUNT(*) FROM v_poi_category GROUP BY 2 UNION ALL SELECT 'primary', primary_id, COUNT(*) FROM v_poi_category GROUP BY 2")
def d2_category_distributions(s, d):
    return categories.category_distributions(view(s, d, "v_poi_category"))


@query("SELECT category_id, COUNT(*) AS n FROM (SELECT top_id AS category_id FROM v_poi_category UNION ALL SELECT basic_id FROM v_poi_category UNION ALL SELECT primary_id FROM v_poi_category) t GROUP BY 1")
def d3_category_stats(s, d):
    return categories.category_stats(paths(s, d))


_NODES = "(SELECT DISTINCT top_id AS category_id, CAST(NULL AS VARCHAR(99)) AS parent_id, top_id, 0 AS depth FROM v_poi_category UNION SELECT DISTINCT basic_id, top_id, top_id, 1 FROM v_poi_category UNION SELECT DISTINCT primary_id, basic_id, top_id, 2 FROM v_poi_category)"


@query(f"SELECT * FROM {_NODES} n")
def d4_category_nodes(s, d):
    return categories.category_nodes(paths(s, d))[0]


@query("SELECT mktsegment AS category_id, COUNT(DISTINCT n_name) AS n_parents FROM (SELECT c_mktsegment AS mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey) t GROUP BY 1 HAVING COUNT(DISTINCT n_name) > 1")
def d4_parent_conflicts(s, d):
    """The same segment under several nations: a node with two parents."""
    p = run_sql(s, d, "SELECT r_name, n_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
    return categories.category_nodes(categories.with_hierarchy(p, "r_name", "n_name", "c_mktsegment"))[1]


@query(f"""WITH m AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY analysis_id ORDER BY poi_id) <= 200 AS is_selected FROM ({_MATCH}) t), e AS (SELECT analysis_id, ring_id, is_selected, top_id AS category_id, 0 AS depth, basic_id AS child FROM m UNION ALL SELECT analysis_id, ring_id, is_selected, basic_id, 1, primary_id FROM m UNION ALL SELECT analysis_id, ring_id, is_selected, primary_id, 2, NULL FROM m)
SELECT analysis_id, category_id, COUNT(*) AS matched, COUNT(*) FILTER (is_selected) AS returned, CAST(MIN(depth) AS BIGINT) AS depth, COUNT(*) FILTER (ring_id = 'ring-0-10') AS ring_0_10, COUNT(*) FILTER (ring_id = 'ring-20-30') AS ring_20_30, COUNT(DISTINCT child) AS n_children, COUNT(DISTINCT child) = 0 AS is_leaf FROM e GROUP BY 1, 2""")
def d5_category_rollup(s, d):
    m = run_sql(s, d, f"SELECT *, ROW_NUMBER() OVER (PARTITION BY analysis_id ORDER BY poi_id) <= 200 AS is_selected FROM ({_MATCH}) t")
    r = categories.category_rollup(categories.with_hierarchy(m, "top_id", "basic_id", "primary_id"))
    of = lambda x: F.coalesce(F.try_element_at("ring_counts", F.lit(x)), F.lit(0))
    return r.select("analysis_id", "category_id", "matched", "returned", F.col("depth").cast("bigint").alias("depth"), of("ring-0-10").alias("ring_0_10"), of("ring-20-30").alias("ring_20_30"), F.size("children").cast("bigint").alias("n_children"), "is_leaf")


@query(f"SELECT analysis_id, top_id, COUNT(*) FILTER (ring_id = 'ring-0-10') AS \"ring-0-10\", COUNT(*) FILTER (ring_id = 'ring-10-20') AS \"ring-10-20\", COUNT(*) FILTER (ring_id = 'ring-20-30') AS \"ring-20-30\" FROM ({_MATCH}) m GROUP BY 1, 2")
def d6_ring_category_counts(s, d):
    return categories.ring_category_counts(matches(s, d), list(QUOTAS))


@query("SELECT a.analysis_id, COUNT(*) AS n FROM v_analysis a JOIN v_ring_poi r ON r.analysis_id = a.analysis_id JOIN v_poi_category c ON c.poi_id = r.poi_id WHERE a.profile = 'foot-walking' OR c.top_id IN ('ASIA', 'EUROPE') OR c.basic_id = 'KENYA' GROUP BY 1")
def b7_filter_categories(s, d):
    a = view(s, d, "v_analysis").select("analysis_id", F.when(F.col("profile") == "foot-walking", F.array().cast("array<string>")).otherwise(F.array(F.lit("ASIA"), F.lit("EUROPE"), F.lit("KENYA"))).alias("requested"))
    j = assigned(s, d).join(a.hint("broadcast"), "analysis_id").join(paths(s, d).hint("merge"), "poi_id")
    return categories.filter_categories(j, F.col("requested")).groupBy("analysis_id").agg(F.count("*").alias("n"))


@query("SELECT a.analysis_id, t.id AS category_id FROM v_analysis a CROSS JOIN (VALUES ('ASIA'), ('ATLANTIS'), ('LEMURIA')) t(id) WHERE t.id NOT IN (SELECT top_id FROM v_poi_category)")
def c9_unknown_categories(s, d):
    req = view(s, d, "v_analysis").select("analysis_id", F.array(F.lit("ASIA"), F.lit("ATLANTIS"), F.lit("LEMURIA")).alias("requested"))
    return categories.unknown_categories(req, categories.category_nodes(paths(s, d))[0])


@query(f"SELECT n.category_id, COUNT(k.category_id) AS n_children, COALESCE(STRING_AGG(k.category_id, ',' ORDER BY k.category_id), '') AS children FROM {_NODES} n LEFT JOIN {_NODES} k ON k.parent_id = n.category_id GROUP BY 1")
def c15_category_children(s, d):
    c = categories.category_children(categories.category_nodes(paths(s, d))[0])
    return c.select("category_id", F.size("children").cast("bigint").alias("n_children"), F.array_join("children", ",").alias("children"))


@query(f"SELECT parent_id, category_id, n, rank FROM (SELECT k.parent_id, k.category_id, c.n, ROW_NUMBER() OVER (PARTITION BY k.parent_id ORDER BY c.n DESC, k.category_id) AS rank FROM {_NODES} k JOIN (SELECT basic_id AS id, COUNT(*) AS n FROM v_poi_category GROUP BY 1 UNION ALL SELECT primary_id, COUNT(*) FROM v_poi_category GROUP BY 1) c ON c.id = k.category_id WHERE k.parent_id IS NOT NULL) t WHERE rank <= 8")
def f5_top_children(s, d):
    p = paths(s, d)
    return categories.top_children(categories.category_nodes(p)[0], categories.category_stats(p)).select("parent_id", "category_id", "n", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT DISTINCT top_id AS category_id, CASE top_id WHEN 'ASIA' THEN 'Far East' ELSE array_to_string(list_transform(string_split(top_id, ' '), lambda x: UPPER(x[1]) || LOWER(x[2:])), ' ') END AS label FROM v_poi_category")
def c20_label_categories(s, d):
    labels = s.createDataFrame([("ASIA", "Far East")], "category_id string, label string")
    return categories.label_categories(view(s, d, "v_poi_category").select(F.col("top_id").alias("category_id")).distinct(), labels)


@query("SELECT p.poi_id, array_to_string([c.top_id, c.basic_id, c.primary_id], '/') AS path, CASE WHEN p.k % 3 = 0 THEN array_to_string(list_sort([c.basic_id, 'alt ' || c.top_id]), '/') ELSE '' END AS alternates FROM v_poi p JOIN v_category c ON c.c_custkey = p.source_key")
def c4_assemble_paths(s, d):
    """Path rows come depth by depth, alternates for a third of the points, repeats among them."""
    p = view(s, d, "v_poi_category")
    path = p.select("poi_id", F.explode(F.array(*(F.struct(F.lit(i).alias("depth"), F.col(c).alias("category_id")) for i, c in ((2, "primary_id"), (0, "top_id"), (1, "basic_id"))))).alias("x")).select("poi_id", "x.*")
    alt = p.where("k % 3 = 0").select("poi_id", F.explode(F.array(F.concat(F.lit("alt "), F.col("top_id")), "basic_id", "basic_id")).alias("category_id"))
    return categories.assemble_poi(p.select("poi_id"), path, alt).select("poi_id", *(F.array_join(c, "/").alias(a) for c, a in (("hierarchy", "path"), ("alternates", "alternates"))))


@query("SELECT c_custkey AS row_id, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS valid_depth FROM v_category")
def h18_deepest_ancestor(s, d):
    """Paths whose last place is wrong, or whose second is."""
    wrong = F.lit("NOWHERE")
    p = view(s, d, "v_category").select(F.col("c_custkey").alias("row_id"), F.when(F.col("c_custkey") % 2 == 0, F.array("top_id", "basic_id", wrong)).otherwise(F.array("top_id", wrong, "primary_id")).alias("hierarchy"))
    nodes = categories.category_nodes(categories.with_hierarchy(view(s, d, "v_category"), "top_id", "basic_id", "primary_id"))[0]
    return categories.deepest_valid_ancestor(p, nodes).select("row_id", "valid_depth")


# ---- import ----

BBOX = (114.2, 30.2, 114.9, 30.9)


def classified(s: SparkSession, d: str) -> DataFrame:
    flat = features.flatten_features(features.parse_features(view(s, d, "v_feature_json")).drop("line"))
    return features.classify_features(flat, BBOX, ["pos"], min_confidence=0.2)


_REASON = """(SELECT pos, CASE WHEN pos % 10 = 9 THEN 'duplicate-id' WHEN pos % 53 = 0 THEN 'invalid-geometry' WHEN NOT (x BETWEEN 114.2 AND 114.9 AND y BETWEEN 30.2 AND 30.9) THEN 'outside-bbox' WHEN pos % 29 = 0 THEN 'missing-name'
 WHEN pos % 31 = 0 THEN 'invalid-taxonomy' WHEN pos % 23 = 0 THEN 'closed' WHEN pos % 19 <> 0 AND (10 + pos % 90) < 20 THEN 'low-confidence' END AS reject_reason FROM (SELECT event_id AS pos, CAST('114.' || (1000 + (event_id * 7919) % 9000) AS DOUBLE) AS x, CAST('30.' || (1000 + (event_id * 104729) % 8999) AS DOUBLE) AS y FROM events) e)"""


@query(f"SELECT pos, reject_reason FROM {_REASON} r")
def b3_classify_features(s, d):
    return classified(s, d).select("pos", "reject_reason")


@query(f"SELECT COALESCE(reject_reason, 'accepted') AS reason, COUNT(*) AS n FROM {_REASON} r GROUP BY 1")
def d1_reject_counts(s, d):
    return classified(s, d).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""SELECT n_read, accepted, missing_id, duplicate_id, invalid_geometry, outside_bbox, missing_name, invalid_taxonomy, closed, low_confidence, with_basic, with_confidence, taxonomy_valid, CAST(taxonomy_valid AS DOUBLE) / n_read AS taxonomy_rate, CAST(taxonomy_valid AS DOUBLE) / n_read >= 0.3 AS ready FROM (SELECT COUNT(*) AS n_read, COUNT(*) FILTER (reject_reason IS NULL) AS accepted, CAST(0 AS BIGINT) AS missing_id,
 COUNT(*) FILTER (reject_reason = 'duplicate-id') AS duplicate_id, COUNT(*) FILTER (reject_reason = 'invalid-geometry') AS invalid_geometry, COUNT(*) FILTER (reject_reason = 'outside-bbox') AS outside_bbox, COUNT(*) FILTER (reject_reason = 'missing-name') AS missing_name, COUNT(*) FILTER (reject_reason = 'invalid-taxonomy') AS invalid_taxonomy,
 COUNT(*) FILTER (reject_reason = 'closed') AS closed, COUNT(*) FILTER (reject_reason = 'low-confidence') AS low_confidence, COUNT(*) FILTER (pos % 7 <> 0) AS with_basic, COUNT(*) FILTER (pos % 19 <> 0) AS with_confidence, COUNT(*) FILTER (reject_reason IS NULL OR reject_reason IN ('closed', 'low-confidence')) AS taxonomy_valid FROM {_REASON} r) t""")
def d1_import_report(s, d):
    return features.import_report(classified(s, d), threshold=0.3)


@query("SELECT event_id AS pos, 'overture:' || (CASE WHEN event_id % 10 = 9 THEN event_id - 1 ELSE event_id END) AS poi_id, CASE WHEN event_id % 29 = 0 THEN NULL ELSE 'Name ' || user_id END AS name, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'shopping' END AS basic_id, CASE WHEN event_id % 19 = 0 THEN NULL ELSE (10 + event_id % 90) / 100.0 END AS confidence FROM events")
def b1_flatten_features(s, d):
    flat = features.flatten_features(features.parse_features(view(s, d, "v_feature_json")).drop("line"))
    return flat.select("pos", "poi_id", "name", "basic_id", "confidence")


@query("""WITH r AS (SELECT sha256(CAST(json_object('pos', pos, 'line', line) AS VARCHAR)) AS h FROM v_feature_json)
SELECT COUNT(*) AS n, CAST(SUM(CAST(CONCAT('0x', SUBSTRING(h, 1, 15)) AS BIGINT)) AS VARCHAR) AS fp_a, CAST(SUM(CAST(CONCAT('0x', SUBSTRING(h, 16, 15)) AS BIGINT)) AS VARCHAR) AS fp_b FROM r""")
def a6_content_fingerprint(s, d):
    return datasets.content_fingerprint(view(s, d, "v_feature_json"))


@query("SELECT analysis_id, COUNT(*) AS poi_count, COUNT(DISTINCT ring_id) AS n_rings, STRING_AGG(ring_id || ':' || poi_id || ':' || CAST(CAST(FLOOR(travel_time_s) AS BIGINT) AS VARCHAR), ',' ORDER BY ring_id, poi_id) AS pois FROM v_score GROUP BY 1")
def a10_nested_results(s, d):
    v = view(s, d, "v_score").withColumn("distance_m", F.lit(0.0))
    flat = F.flatten(F.transform("rings", lambda r: F.transform(r["pois"], lambda p: F.concat_ws(":", r["ring_id"], p["poi_id"], F.floor(p["travel_time_s"]).cast("string")))))
    return datasets.nested_results(v).select("analysis_id", F.col("poi_count").cast("bigint").alias("poi_count"), F.size("rings").cast("bigint").alias("n_rings"), F.array_join(flat, ",").alias("pois"))


@query("SELECT poi_id, CASE WHEN k % 17 <> 0 THEN 'Feature Point' END AS kinds, CASE WHEN k % 17 <> 0 THEN lon END AS lon, CASE WHEN k % 17 <> 0 THEN lat END AS lat, CASE WHEN k % 17 = 0 THEN 'invalid-coordinates' END AS reason FROM v_poi")
def a9_geojson_lines(s, d):
    """Every 17th point lies outside the world and is rejected."""
    p = view(s, d, "v_poi").withColumn("lat", F.when(F.col("k") % 17 == 0, F.col("lat") + 90).otherwise(F.col("lat")))
    lines, rejected = datasets.geojson_lines(p, ["poi_id"])
    of = lambda path: F.get_json_object("value", path)
    good = lines.select(of("$.properties.poi_id").alias("poi_id"), F.concat_ws(" ", of("$.type"), of("$.geometry.type")).alias("kinds"), *(of(f"$.geometry.coordinates[{i}]").cast("double").alias(c) for i, c in enumerate(("lon", "lat"))), F.lit(None).cast("string").alias("reason"))
    return good.union(rejected.select("poi_id", F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("double"), "reason"))


# ---- requests ----


@query("""SELECT analysis_id, CASE analysis_id % 4 WHEN 0 THEN '10,20,30' WHEN 1 THEN '10,20' WHEN 2 THEN '-5,10' ELSE '' END AS ranges, analysis_id % 4 = 0 AS strict FROM v_analysis""")
def b12_ranges(s, d):
    a = view(s, d, "v_analysis")
    r = F.when(a["analysis_id"] % 4 == 0, F.array(*map(F.lit, (10, 20, 30)))).when(a["analysis_id"] % 4 == 1, F.array(*map(F.lit, (20, 10, 20)))).when(a["analysis_id"] % 4 == 2, F.array(*map(F.lit, (-5, 10)))).otherwise(F.array().cast("array<int>"))
    return a.select("analysis_id", F.array_join(requests.normal_ranges(r).cast("array<string>"), ",").alias("ranges"), requests.strict_ranges(r).alias("strict"))


@query("SELECT analysis_id, CASE WHEN analysis_id % 5 = 0 THEN '45' ELSE '' END AS missing, CASE WHEN analysis_id % 5 = 0 THEN '30' ELSE '' END AS extra, analysis_id % 5 <> 0 AS valid FROM v_analysis")
def b14_validate_isochrones(s, d):
    a = view(s, d, "v_analysis").select("analysis_id", F.array(F.lit(10), F.lit(20), F.when(F.col("analysis_id") % 5 == 0, 45).otherwise(30)).alias("ranges"))
    iso = view(s, d, "v_edge").select("analysis_id", "range_minutes").distinct()
    return requests.validate_isochrones(iso, a).select("analysis_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("missing", "extra")), "valid")


@query("SELECT analysis_id, range_minutes, CASE WHEN range_minutes = 10 THEN 'open-ring' END AS reason FROM (SELECT DISTINCT analysis_id, range_minutes FROM v_edge) t")
def b15_validate_polygons(s, d):
    p = isochrone_polygons(s, d)
    closed = F.transform("polygon", lambda part: F.transform(part, lambda r: F.concat(r, F.slice(r, 1, 1))))
    p = p.withColumn("polygon", F.when(F.col("range_minutes") == 10, F.col("polygon")).otherwise(closed))
    return requests.validate_polygons(p).select("analysis_id", "range_minutes", "reason")


@query("SELECT analysis_id, CAST(CEIL(COUNT(*) / 350.0) AS BIGINT) AS matrix_batches, CAST(3 + CEIL(COUNT(*) / 350.0) AS BIGINT) AS least, CAST(CEIL((3 + CEIL(COUNT(*) / 350.0)) * 0.2) AS BIGINT) AS reserve, CASE WHEN 3 + CEIL(COUNT(*) / 350.0) + CEIL((3 + CEIL(COUNT(*) / 350.0)) * 0.2) <= 6 THEN 'within-budget' ELSE 'approval-required' END AS verdict FROM v_accessibility GROUP BY 1")
def b18_estimate_requests(s, d):
    p = view(s, d, "v_accessibility").groupBy("analysis_id").agg(F.count("*").alias("n_pois")).withColumns({"n_pieces": F.lit(3), "n_sources": F.lit(10), "budget": F.lit(6)})
    return requests.estimate_requests(p).select("analysis_id", "matrix_batches", "least", "reserve", "verdict")


@query("SELECT poi_id, lon, lat FROM v_poi")
def b17_coordinate_text(s, d):
    t = view(s, d, "v_poi").select("poi_id", F.concat(F.lit(" "), F.col("lon").cast("string"), F.lit(" , "), F.col("lat").cast("string")).alias("q"))
    return requests.with_coordinate_text(t, "q").select("poi_id", "point.lon", "point.lat")


# ---- provider merge ----


@query("""WITH r AS (SELECT *, COALESCE(source_id, 'row:' || piece || ':' || pos) AS key FROM v_piece_result WHERE plan_id % 7 <> 3), f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY plan_id, source, key ORDER BY piece, pos) AS i FROM r)
SELECT plan_id, COUNT(*) AS raw, COUNT(*) FILTER (i = 1) AS merged, COUNT(*) FILTER (i > 1) AS duplicate FROM f GROUP BY 1""")
def g1_merge_counts(s, d):
    return _merge(s, d)[1]


def _merge(s: SparkSession, d: str):
    r = view(s, d, "v_piece_result")
    pieces = r.select("plan_id", "piece").distinct().withColumns({"complete": ~((F.col("plan_id") % 7 == 3) & (F.col("piece") == 1)), "truncated": F.lit(False)})
    return selection.merge_pieces(r, pieces)


@query("""WITH r AS (SELECT *, COALESCE(source_id, 'row:' || piece || ':' || pos) AS key FROM v_piece_result WHERE plan_id % 7 <> 3) SELECT plan_id, source_id, piece, pos FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY plan_id, source, key ORDER BY piece, pos) AS i FROM r) f WHERE i = 1""")
def g1_merge_pieces(s, d):
    return _merge(s, d)[0].select("plan_id", "source_id", "piece", "pos")


_NAMED = "SELECT DISTINCT pos, name, 114 + (lon - 114) / 2048 AS lon, 30.5 + (lat - 30.5) / 2048 AS lat FROM v_piece_result WHERE source_id IS NULL"


@query(f"""WITH n AS ({_NAMED}), p AS (SELECT a.pos AS first, b.pos AS second FROM n a JOIN n b ON a.name = b.name AND a.pos < b.pos AND SQRT(POWER((a.lon - b.lon) * 96000, 2) + POWER((a.lat - b.lat) * 111000, 2)) <= 5)
SELECT first, second FROM p""")
def c10_near_pairs(s, d):
    n = run_sql(s, d, _NAMED).withColumn("key", text.name_key(F.col("name")))
    return spatial.near_pairs(n, "key", "pos").select("first", "second")


@query()
def c10_dedupe_near(s, d):
    return spatial.dedupe_near(run_sql(s, d, _NAMED)).select("pos", "name")


# ---- layouts ----


def angled(s: SparkSession, d: str) -> DataFrame:
    return layout.with_angles(view(s, d, "v_layout_node"), F.lit(114.0), F.lit(30.5), F.lit(0.0), F.lit(0.0))


_ANGLED = "(SELECT *, (lon - 114) * 111320.0 * COS(RADIANS(30.5)) AS sx, (lat - 30.5) * 111320.0 AS sy, x AS tx, 0 - y AS ty, DEGREES(ATAN2((lat - 30.5) * 111320.0, (lon - 114) * 111320.0 * COS(RADIANS(30.5)))) AS sa, DEGREES(ATAN2(0 - y, x)) AS ta FROM v_layout_node)"
#: A sector's number (the first is centred on east), and whether an angle lies on a sector's edge.
_SECTOR = "CAST(FLOOR((({0} + 180.0 / {1}) - FLOOR(({0} + 180.0 / {1}) / 360) * 360) / (360.0 / {1})) AS BIGINT) % {1}"
_EDGE = "(LEAST((sa + 180.0 / {0}) - FLOOR((sa + 180.0 / {0}) / (360.0 / {0})) * (360.0 / {0}), 360.0 / {0} - ((sa + 180.0 / {0}) - FLOOR((sa + 180.0 / {0}) / (360.0 / {0})) * (360.0 / {0}))) <= 1e-9)"


@query(f"""WITH a AS (SELECT *, (ABS(sx) <= 1e-9 AND ABS(sy) <= 1e-9) OR (ABS(tx) <= 1e-9 AND ABS(ty) <= 1e-9) AS skip, ABS(sa - ta) AS raw FROM {_ANGLED} q), e AS (SELECT *, CASE WHEN NOT skip THEN LEAST(raw, 360 - raw) END AS err FROM a), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY layout_id ORDER BY err NULLS LAST, node_id) - 1 AS i, COUNT(err) OVER (PARTITION BY layout_id) AS m FROM e)
SELECT layout_id, COUNT(*) AS n, COUNT(*) FILTER (skip) AS excluded, ROUND(AVG(err), 6) AS err_mean, ROUND(MAX(err) FILTER (i = FLOOR((m - 1) * 0.5)), 6) AS err_median, ROUND(MAX(err) FILTER (i = FLOOR((m - 1) * 0.95)), 6) AS err_p95, ROUND(MAX(err), 6) AS err_max,
 COUNT(*) FILTER (ABS(sx) > 1e-9 AND ABS(tx) > 1e-9) AS ew_base, COUNT(*) FILTER (ABS(sx) > 1e-9 AND ABS(tx) > 1e-9 AND (sx > 0) <> (tx > 0)) AS ew_flips, COUNT(*) FILTER (ABS(sy) > 1e-9 AND ABS(ty) > 1e-9) AS ns_base, COUNT(*) FILTER (ABS(sy) > 1e-9 AND ABS(ty) > 1e-9 AND (sy > 0) <> (ty > 0)) AS ns_flips,
 {", ".join(f"COUNT(*) FILTER (NOT skip AND NOT {_EDGE.format(k)}) AS sector{k}_base, COUNT(*) FILTER (NOT skip AND NOT {_EDGE.format(k)} AND {_SECTOR.format('sa', k)} = {_SECTOR.format('ta', k)}) AS sector{k}_kept" for k in (4, 8, 12))} FROM r GROUP BY 1""")
def d15_direction_metrics(s, d):
    m = layout.direction_metrics(angled(s, d))
    return m.withColumns({c: F.round(c, 6) for c in ("err_mean", "err_median", "err_p95", "err_max")})


_SIGN = "CASE WHEN {0} > 1e-6 THEN 1 WHEN {0} < -1e-6 THEN -1 ELSE 0 END"


@query(f"""WITH a AS (SELECT * FROM {_ANGLED} q), p AS (SELECT a.layout_id, {_SIGN.format('(b.sx - a.sx)')} AS s1, {_SIGN.format('(b.tx - a.tx)')} AS t1, {_SIGN.format('(b.sy - a.sy)')} AS s2, {_SIGN.format('(b.ty - a.ty)')} AS t2 FROM a JOIN a b ON b.layout_id = a.layout_id AND a.node_id < b.node_id)
SELECT layout_id, COUNT(*) FILTER (s1 = 0) AS lr_source_excluded, COUNT(*) FILTER (s1 <> 0 AND t1 = 0) AS lr_layout_excluded, COUNT(*) FILTER (s1 <> 0 AND t1 <> 0) AS lr_base, COUNT(*) FILTER (s1 <> 0 AND s1 = t1) AS lr_kept,
 COUNT(*) FILTER (s2 = 0) AS ud_source_excluded, COUNT(*) FILTER (s2 <> 0 AND t2 = 0) AS ud_layout_excluded, COUNT(*) FILTER (s2 <> 0 AND t2 <> 0) AS ud_base, COUNT(*) FILTER (s2 <> 0 AND s2 = t2) AS ud_kept FROM p GROUP BY 1""")
def c12_pairwise_retention(s, d):
    return layout.pairwise_retention(angled(s, d))


@query("SELECT a.layout_id, a.node_id AS a, b.node_id AS b FROM v_layout_node a JOIN v_layout_node b ON b.layout_id = a.layout_id AND a.node_id < b.node_id AND ABS(a.x - b.x) < (a.width + b.width) / CAST(2 AS DOUBLE) AND ABS(a.y - b.y) < (a.height + b.height) / CAST(2 AS DOUBLE)")
def c13_rect_overlaps(s, d):
    return spatial.rect_overlaps(view(s, d, "v_layout_node"))


@query("SELECT a.layout_id, a.node_id, ROUND(MIN(SQRT(POWER(GREATEST(0, ABS(a.x - b.x) - (a.width + b.width) / CAST(2 AS DOUBLE)), 2) + POWER(GREATEST(0, ABS(a.y - b.y) - (a.height + b.height) / CAST(2 AS DOUBLE)), 2))), 6) AS gap FROM v_layout_node a JOIN v_layout_node b ON b.layout_id = a.layout_id AND a.node_id <> b.node_id GROUP BY 1, 2")
def c14_nearest_gap(s, d):
    return spatial.nearest_gap(view(s, d, "v_layout_node")).select("layout_id", "node_id", F.round("gap", 6).alias("gap"))


@query("""WITH o AS (SELECT a.layout_id, COUNT(*) AS hits FROM v_layout_node a JOIN v_layout_node b ON b.layout_id = a.layout_id AND a.node_id < b.node_id AND ABS(a.x - b.x) < (a.width + b.width) / CAST(2 AS DOUBLE) AND ABS(a.y - b.y) < (a.height + b.height) / CAST(2 AS DOUBLE) GROUP BY 1), n AS (SELECT layout_id, COUNT(*) AS placed, COUNT(*) FILTER (SQRT(POWER(GREATEST(0, ABS(x) - width / CAST(2 AS DOUBLE)), 2) + POWER(GREATEST(0, ABS(y) - 9), 2)) < CASE ring_id WHEN 'inner' THEN 0 ELSE 350 END OR SQRT(POWER(ABS(x) + width / CAST(2 AS DOUBLE), 2) + POWER(ABS(y) + 9, 2)) > CASE ring_id WHEN 'inner' THEN 350 ELSE 1100 END) AS outside_ring FROM (SELECT *, CASE WHEN SQRT(x * x + y * y) <= 350 THEN 'inner' ELSE 'outer' END AS ring_id FROM v_layout_node) r GROUP BY 1)
SELECT n.layout_id, placed + 10 AS eligible, placed, COALESCE(hits, 0) AS overlapping, ROUND(placed / CAST(placed + 10 AS DOUBLE), 6) AS placement_rate, ROUND(COALESCE(hits, 0) / (placed * (placed - 1) / CAST(2 AS DOUBLE)), 6) AS overlap_rate, outside_ring, ROUND(outside_ring / CAST(placed AS DOUBLE), 6) AS outside_rate FROM n LEFT JOIN o ON o.layout_id = n.layout_id""")
def d17_layout_completeness(s, d):
    n, bands = ringed(s, d)
    m = layout.layout_completeness(n, n.groupBy("layout_id").agg((F.count("*") + 10).alias("eligible")), bands)
    return m.select("layout_id", "eligible", "placed", F.col("overlaps").alias("overlapping"), F.round("placement_rate", 6).alias("placement_rate"), F.round("overlap_rate", 6).alias("overlap_rate"), "outside_ring", F.round("outside_rate", 6).alias("outside_rate"))


BANDS = [("inner", 0.0, 350.0), ("outer", 350.0, 1100.0)]
_RINGED = "(SELECT *, CASE WHEN SQRT(x * x + y * y) <= 350 THEN 'inner' ELSE 'outer' END AS ring_id FROM v_layout_node)"


def ringed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = angled(s, d).withColumn("ring_id", F.when(F.hypot("x", "y") <= 350, "inner").otherwise("outer"))
    return n, s.createDataFrame(BANDS, "ring_id string, inner double, outer double")


@query(f"""WITH r AS (SELECT *, SQRT(POWER(GREATEST(0, ABS(x) - width / CAST(2 AS DOUBLE)), 2) + POWER(GREATEST(0, ABS(y) - 9), 2)) AS near, SQRT(POWER(ABS(x) + width / CAST(2 AS DOUBLE), 2) + POWER(ABS(y) + 9, 2)) AS far FROM {_RINGED} q),
 g AS (SELECT a.layout_id, a.ring_id, a.node_id, MIN(CASE WHEN b.node_id IS NOT NULL THEN SQRT(POWER(GREATEST(0, ABS(a.x - b.x) - (a.width + b.width) / CAST(2 AS DOUBLE)), 2) + POWER(GREATEST(0, ABS(a.y - b.y) - (a.height + b.height) / CAST(2 AS DOUBLE)), 2)) END) AS gap FROM r a LEFT JOIN r b ON b.layout_id = a.layout_id AND b.ring_id = a.ring_id AND b.node_id <> a.node_id GROUP BY 1, 2, 3),
 k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY layout_id, ring_id ORDER BY gap NULLS LAST, node_id) - 1 AS i, COUNT(gap) OVER (PARTITION BY layout_id, ring_id) AS m FROM g),
 q AS (SELECT layout_id, ring_id, MIN(gap) AS gap_min, MAX(gap) FILTER (i = FLOOR((m - 1) * 0.5)) AS gap_median, MAX(gap) FILTER (i = FLOOR((m - 1) * 0.95)) AS gap_p95 FROM k GROUP BY 1, 2),
 t AS (SELECT layout_id, ring_id, COUNT(*) AS n, CAST(SUM(width * height) AS BIGINT) AS label_area, MIN(near) AS near, MAX(far) AS far, CASE ring_id WHEN 'inner' THEN 0 ELSE 350 END AS lo, CASE ring_id WHEN 'inner' THEN 350 ELSE 1100 END AS hi FROM r GROUP BY 1, 2)
SELECT t.layout_id, t.ring_id, n, label_area, ROUND(label_area / (PI() * (hi * hi - lo * lo)), 6) AS fill_ratio, ROUND(1 - label_area / (PI() * (hi * hi - lo * lo)), 6) AS void_ratio, ROUND(gap_min, 6) AS gap_min, ROUND(gap_median, 6) AS gap_median, ROUND(gap_p95, 6) AS gap_p95,
 CAST(hi - lo AS DOUBLE) AS band_width, ROUND(near - lo, 6) AS unused_inner, ROUND(hi - far, 6) AS outer_slack, CAST(CASE t.ring_id WHEN 'inner' THEN -20 ELSE 0 END AS DOUBLE) AS gap_from_previous FROM t JOIN q ON q.layout_id = t.layout_id AND q.ring_id = t.ring_id""")
def d20_ring_metrics(s, d):
    m = layout.ring_metrics(*ringed(s, d), centre_radius=20.0)
    return m.select("layout_id", "ring_id", "n", "label_area", "band_width", "gap_from_previous", *(F.round(c, 6).alias(c) for c in ("fill_ratio", "void_ratio", "gap_min", "gap_median", "gap_p95", "unused_inner", "outer_slack")))


@query(f"""SELECT layout_id, COUNT(*) FILTER (SQRT(POWER(GREATEST(0, ABS(x) - width / CAST(2 AS DOUBLE)), 2) + POWER(GREATEST(0, ABS(y) - 9), 2)) < CASE ring_id WHEN 'inner' THEN 0 ELSE 350 END OR SQRT(POWER(ABS(x) + width / CAST(2 AS DOUBLE), 2) + POWER(ABS(y) + 9, 2)) > CASE ring_id WHEN 'inner' THEN 350 ELSE 1100 END) AS outside_ring,
 COUNT(*) FILTER (ABS(x) < width / CAST(2 AS DOUBLE) + 20 AND ABS(y) < 29) AS on_centre, COUNT(*) FILTER ((lon - 114) * x < 0) AS ew_violations, COUNT(*) FILTER ((lat - 30.5) * (0 - y) < 0) AS ns_violations FROM {_RINGED} r GROUP BY 1""")
def d31_layout_constraints(s, d):
    return layout.layout_constraints(*ringed(s, d))


@query("SELECT layout_id, COUNT(*) AS placed, CASE WHEN layout_id % 4 = 0 THEN 'sum' ELSE '' END AS errors FROM v_layout_node GROUP BY 1")
def d18_validate_metrics(s, d):
    m = view(s, d, "v_layout_node").groupBy("layout_id").agg(F.count("*").alias("placed")).withColumns({"unplaced": F.when(F.col("layout_id") % 4 == 0, 1).otherwise(0), "eligible": F.col("placed"), "rate": F.lit(0.5)})
    return layout.validate_metrics(m, ["rate"]).select("layout_id", "placed", F.array_join("errors", ",").alias("errors"))


_BINS = "(SELECT DISTINCT layout_id, CAST(node_id * 7919 % 720 AS INT) AS bin FROM v_layout_node)"


@query(f"WITH b AS (SELECT * FROM {_BINS} t UNION SELECT layout_id, bin + 720 FROM {_BINS} u), g AS (SELECT layout_id, bin - LAG(bin) OVER (PARTITION BY layout_id ORDER BY bin) - 1 AS gap FROM b) SELECT layout_id, CAST(LEAST(719, MAX(gap)) AS BIGINT) AS max_empty FROM g GROUP BY 1")
def e11_max_empty_arc(s, d):
    b = view(s, d, "v_layout_node").select("layout_id", (F.col("node_id") * 7919 % 720).cast("int").alias("bin"))
    return layout.max_empty_arc(b).select("layout_id", F.col("max_empty").cast("bigint").alias("max_empty"))


@query("""WITH p AS (SELECT layout_id AS analysis_id, CAST(node_id * 37 % 360 AS INT) AS bin, CAST(MAX(node_id % 1000) AS DOUBLE) AS v FROM v_layout_node GROUP BY 1, 2), k AS (SELECT DISTINCT analysis_id, b.bin FROM p CROSS JOIN (SELECT CAST(i AS INT) AS bin FROM range(0, 360) r(i)) b),
 w AS (SELECT * FROM (VALUES (-2, 1), (-1, 2), (0, 3), (1, 2), (2, 1)) t(off, w)) SELECT k.analysis_id, k.bin, ROUND(SUM(w.w * COALESCE(p.v, 0)) / 9, 6) AS smooth FROM k CROSS JOIN w LEFT JOIN p ON p.analysis_id = k.analysis_id AND p.bin = (k.bin + w.off + 360) % 360 GROUP BY 1, 2""")
def e10_circular_smooth(s, d):
    p = view(s, d, "v_layout_node").groupBy(F.col("layout_id").alias("analysis_id"), (F.col("node_id") * 37 % 360).cast("int").alias("bin")).agg(F.max(F.col("node_id") % 1000).cast("double").alias("reach_m"))
    return layout.circular_smooth(p).select("analysis_id", "bin", F.round("smooth", 6).alias("smooth"))


@query("""WITH p AS (SELECT layout_id AS analysis_id, CAST(node_id * 37 % 360 AS INT) AS bin, CAST(MAX(node_id % 1000) AS DOUBLE) AS v FROM v_layout_node GROUP BY 1, 2)
SELECT analysis_id, (bin + off + 360) % 360 AS bin, ROUND(MAX(v * (1 - ABS(off) / CAST(4 AS DOUBLE))), 6) AS reach_m FROM p CROSS JOIN (SELECT CAST(i AS INT) AS off FROM range(-3, 4) r(i)) o GROUP BY 1, 2""")
def d28_reach_profile(s, d):
    p = view(s, d, "v_layout_node").select(F.col("layout_id").alias("analysis_id"), (F.col("node_id") * 37 % 360).cast("int").alias("bin"), (F.col("node_id") % 1000).cast("double").alias("radius_m"))
    return layout.reach_profile(p).select("analysis_id", "bin", F.round("reach_m", 6).alias("reach_m"))


@query("""WITH g AS (SELECT a.layout_id AS analysis_id, i * 8 + j AS gid, CAST(i * 200 - 700 AS DOUBLE) AS x, CAST(j * 200 - 700 AS DOUBLE) AS y FROM (SELECT DISTINCT layout_id FROM v_layout_node) a CROSS JOIN range(0, 8) u(i) CROSS JOIN range(0, 8) w(j))
SELECT g.analysis_id, gid, ROUND(SUM(EXP(-(POWER(g.x - n.x, 2) + POWER(g.y - n.y, 2)) / 3200)), 6) AS density FROM g JOIN v_layout_node n ON n.layout_id = g.analysis_id AND POWER(g.x - n.x, 2) + POWER(g.y - n.y, 2) <= 25600 GROUP BY 1, 2""")
def d29_kernel_density(s, d):
    v = view(s, d, "v_layout_node")
    g = v.select(F.col("layout_id").alias("analysis_id")).distinct().withColumn("gid", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(63).cast("bigint"))))
    g = g.withColumns({"x": (F.floor(F.col("gid") / 8) * 200 - 700).cast("double"), "y": (F.col("gid") % 8 * 200 - 700).cast("double")})
    p = v.select(F.col("layout_id").alias("analysis_id"), "x", "y", F.lit(1.0).alias("w"))
    return layout.kernel_density(p, g, 40.0).select("analysis_id", "gid", F.round("density", 6).alias("density"))


# ---- geometry and tiles ----


@query("SELECT analysis_id, range_minutes, ROUND(ABS(SUM(x1 * y2 - x2 * y1)) / 2, 9) AS area, ROUND(SUM(SQRT(POWER(x2 - x1, 2) + POWER(y2 - y1, 2))), 9) AS around, COUNT(*) AS n_vertices FROM (SELECT e.analysis_id, e.range_minutes, x1 - a.lon AS x1, y1 - a.lat AS y1, x2 - a.lon AS x2, y2 - a.lat AS y2 FROM v_edge e JOIN v_analysis a ON a.analysis_id = e.analysis_id) t GROUP BY 1, 2")
def h11_area_perimeter(s, d):
    r = F.col("polygon")[0][0]
    return isochrone_polygons(s, d).select("analysis_id", "range_minutes", F.round(geo.polygon_area(F.col("polygon")), 9).alias("area"), F.round(geo.perimeter(r), 9).alias("around"), F.size(r).cast("bigint").alias("n_vertices"))


#: Of a vertex v and the edges e of a polygon: 1 inside, 0 on an edge, -1 outside.
_INSIDE = """CASE WHEN MAX(CASE WHEN (e.x2-e.x1)*(v.y1-e.y1) = (e.y2-e.y1)*(v.x1-e.x1) AND v.x1 BETWEEN LEAST(e.x1,e.x2) AND GREATEST(e.x1,e.x2) AND v.y1 BETWEEN LEAST(e.y1,e.y2) AND GREATEST(e.y1,e.y2) THEN 1 ELSE 0 END) = 1 THEN 0
 WHEN SUM(CASE WHEN (e.y1 > v.y1) <> (e.y2 > v.y1) AND v.x1 < (e.x2-e.x1)*(v.y1-e.y1)/(e.y2-e.y1)+e.x1 THEN 1 ELSE 0 END) % 2 = 1 THEN 1 ELSE -1 END"""


@query(f"""WITH p AS (SELECT analysis_id, range_minutes, ABS(SUM(x1 * y2 - x2 * y1)) / 2 AS area FROM (SELECT e.analysis_id, e.range_minutes, x1 - a.lon AS x1, y1 - a.lat AS y1, x2 - a.lon AS x2, y2 - a.lat AS y2 FROM v_edge e JOIN v_analysis a ON a.analysis_id = e.analysis_id) t GROUP BY 1, 2),
 c AS (SELECT v.analysis_id, v.range_minutes AS rv, e.range_minutes AS re, v.seq, {_INSIDE} AS inside FROM v_edge v JOIN v_edge e ON e.analysis_id = v.analysis_id AND ABS(e.range_minutes - v.range_minutes) = 10 GROUP BY 1, 2, 3, 4),
 n AS (SELECT analysis_id, GREATEST(rv, re) AS range_minutes, COUNT(*) FILTER ((rv < re AND inside < 0) OR (rv > re AND inside > 0)) = 0 AS nested FROM c GROUP BY 1, 2),
 d AS (SELECT p.*, area - COALESCE(LAG(area) OVER (PARTITION BY analysis_id ORDER BY range_minutes), 0) AS ring_area FROM p)
SELECT d.analysis_id, d.range_minutes, ROUND(ring_area, 9) AS ring_area, COALESCE(nested, TRUE) AS nested, CASE WHEN COALESCE(nested, TRUE) THEN ROUND(ring_area, 9) END AS exclusive_if_nested FROM d LEFT JOIN n ON n.analysis_id = d.analysis_id AND n.range_minutes = d.range_minutes""")
def k1_build_rings(s, d):
    """Even analyses nest; the notch of the odd ones' polygons cuts into the polygon before (tests hold the exclusive area there against samples)."""
    p = spatial.with_edges(isochrone_polygons(s, d)).select("analysis_id", "range_minutes", "edges", geo.polygon_area(F.col("polygon")).alias("area"))
    r = tiles.build_rings(p)
    return r.select("analysis_id", "range_minutes", F.round("ring_area", 9).alias("ring_area"), "nested", F.when(F.col("nested"), F.round("exclusive_area", 9)).alias("exclusive_if_nested"))


@query("""WITH c AS (SELECT 6378137.0 AS a, 1 / 298.257223563 AS f), n AS (SELECT a, f / (2 - f) AS n FROM c), q AS (SELECT n.n, a / (1 + n) * (1 + n * n / 4 + POWER(n, 4) / 64) AS big, n / 2 - 2 * n * n / 3 + 5 * POWER(n, 3) / 16 AS a1, 13 * n * n / 48 - 3 * POWER(n, 3) / 5 AS a2, 61 * POWER(n, 3) / 240 AS a3 FROM n),
 p AS (SELECT poi_id, RADIANS(lat) AS phi, RADIANS(lon - ((FLOOR((lon + 180) / 6) + 1) * 6 - 183)) AS lam FROM v_poi),
 t AS (SELECT p.*, q.*, SINH(ATANH(SIN(phi)) - 2 * SQRT(n) / (1 + n) * ATANH(2 * SQRT(n) / (1 + n) * SIN(phi))) AS t FROM p CROSS JOIN q),
 x AS (SELECT *, ATAN2(t, COS(lam)) AS xi, ATANH(SIN(lam) / SQRT(1 + t * t)) AS eta FROM t)
SELECT poi_id, ROUND((500000 + 0.9996 * big * (eta + a1 * COS(2 * xi) * SINH(2 * eta) + a2 * COS(4 * xi) * SINH(4 * eta) + a3 * COS(6 * xi) * SINH(6 * eta))) / 5000, 0) AS x,
 ROUND((0.9996 * big * (xi + a1 * SIN(2 * xi) * COSH(2 * eta) + a2 * SIN(4 * xi) * COSH(4 * eta) + a3 * SIN(6 * xi) * COSH(6 * eta))) / 5000, 0) AS y, TRUE AS back FROM x""")
def h7_utm_round_trip(s, d):
    """Forward against another series (by the third flattening) in steps of 5 km, at whose edges the two may not lie apart by a millimetre, and back to the point."""
    zone = geo.utm_zone(F.col("lon"))
    p = view(s, d, "v_poi").withColumn("p", geo.utm_forward(F.col("lon"), F.col("lat"), zone)).withColumn("q", geo.utm_inverse(F.col("p.x"), F.col("p.y"), zone))
    near = (F.abs(F.col("q.lon") - F.col("lon")) < 1e-7) & (F.abs(F.col("q.lat") - F.col("lat")) < 1e-7)
    return p.select("poi_id", F.round(F.col("p.x") / 5000, 0).alias("x"), F.round(F.col("p.y") / 5000, 0).alias("y"), near.alias("back"))


def _slanted(x0: str, x1: str, y0: str, y1: str) -> str:
    """SQL for the polygon of a block's part, slanted by a quarter of its height: areas stay as they are."""
    corner = lambda x, y: f"named_struct('x', x0 + ({x}) + ({y}) / 4, 'y', y0 + ({y}))"
    return f"array(array(array({corner(x0, y0)}, {corner(x1, y0)}, {corner(x1, y1)}, {corner(x0, y1)})))"


@query("""WITH b AS (SELECT block_id, mode, h, w * h / 1000000 AS a FROM v_block),
 p AS (SELECT block_id, mode, a, CASE mode WHEN 1 THEN a - a / 6 WHEN 2 THEN a + a / 6 ELSE a END AS planned, CASE mode WHEN 1 THEN a / 6 WHEN 3 THEN a / 30 WHEN 4 THEN a / 6 WHEN 5 THEN h / 2000000 ELSE 0 END AS uncovered,
  CASE mode WHEN 3 THEN a / 30 WHEN 5 THEN h / 2000000 ELSE 0 END AS outside, CASE WHEN mode IN (2, 4) THEN a / 6 ELSE 0 END AS overlap FROM b)
SELECT block_id, ROUND(planned, 6) AS planned, ROUND(a, 6) AS outer_area, ROUND(planned - a, 6) AS difference, ROUND(uncovered, 6) AS uncovered, ROUND(outside, 6) AS outside, ROUND(overlap, 6) AS overlap, mode IN (0, 5) AS covered FROM p""")
def d24_coverage_audit(s, d):
    """Blocks of six slanted pieces: as they should be, one missing, one twice, all moved by a tenth of a piece, one missing and another twice (sums agree), moved by half a metre."""
    v = view(s, d, "v_block")
    outer = v.select("block_id", F.expr(_slanted("0D", "w", "0D", "h")).alias("polygon"))
    moved = v.withColumns({"x0": F.col("x0") + F.when(F.col("mode") == 3, F.col("w") / 30).when(F.col("mode") == 5, 0.5).otherwise(0.0), "i": F.explode(F.sequence(F.lit(0), F.lit(2)))}).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(1))))
    parts = moved.withColumn("times", F.expr("CASE WHEN mode IN (1, 4) AND i = 0 AND j = 0 THEN 0 WHEN mode = 2 AND i = 1 AND j = 1 OR mode = 4 AND i = 2 AND j = 1 THEN 2 ELSE 1 END"))
    parts = parts.withColumn("_n", F.explode(F.expr("array_repeat(0, times)"))).select("block_id", F.expr(_slanted("i * w / 3", "(i + 1) * w / 3", "j * h / 2", "(j + 1) * h / 2")).alias("polygon"))
    a = tiles.coverage_audit(parts, ["block_id"], outer)
    return a.select("block_id", *(F.round(c, 6).alias(c) for c in ("planned", "outer_area", "difference", "uncovered", "outside", "overlap")), "covered")


def _block_plan(s: SparkSession, d: str) -> DataFrame:
    box = "array(array(array(named_struct('x', x0, 'y', y0), named_struct('x', x0 + 3 * w, 'y', y0), named_struct('x', x0 + 3 * w, 'y', y0 + 2 * h), named_struct('x', x0, 'y', y0 + 2 * h))))"
    return pieces.plan_pieces(view(s, d, "v_block").selectExpr("block_id", f"{box} AS polygon"), ["block_id"], 5000.0, cap=8e6, whole=8e6)


@query("SELECT block_id, CAST(level AS BIGINT) AS level, COUNT(*) AS pieces, ROUND(SUM((x1 - x0) * (y1 - y0)), 4) AS area_m2, ROUND(MAX((x1 - x0) * (y1 - y0)), 4) AS largest_m2 FROM v_block_leaf GROUP BY 1, 2")
def k2_plan_pieces(s, d):
    """Clipped and quartered pieces of all blocks, by level."""
    p = _block_plan(s, d).groupBy("block_id", F.col("level").cast("bigint").alias("level"))
    return p.agg(F.count("*").alias("pieces"), F.round(F.sum("area"), 4).alias("area_m2"), F.round(F.max("area"), 4).alias("largest_m2"))


@query("""WITH p AS (SELECT a.block_id, CASE WHEN ABS(a.x1 - b.x0) < 0.000001 OR ABS(b.x1 - a.x0) < 0.000001 THEN LEAST(a.y1, b.y1) - GREATEST(a.y0, b.y0) ELSE 0 END + CASE WHEN ABS(a.y1 - b.y0) < 0.000001 OR ABS(b.y1 - a.y0) < 0.000001 THEN LEAST(a.x1, b.x1) - GREATEST(a.x0, b.x0) ELSE 0 END AS shared,
  (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS two FROM v_block_leaf a JOIN v_block_leaf b ON a.block_id = b.block_id AND (a.id < b.id OR (a.id = b.id AND (a.p < b.p OR (a.p = b.p AND a.q < b.q))))
  WHERE (ABS(a.x1 - b.x0) < 0.000001 OR ABS(b.x1 - a.x0) < 0.000001 OR ABS(a.y1 - b.y0) < 0.000001 OR ABS(b.y1 - a.y0) < 0.000001) AND LEAST(a.y1, b.y1) - GREATEST(a.y0, b.y0) > -0.000001 AND LEAST(a.x1, b.x1) - GREATEST(a.x0, b.x0) > -0.000001)
SELECT block_id, COUNT(*) AS pairs, ROUND(SUM(shared), 2) AS shared_m, COUNT(*) FILTER (two <= 9000001) AS mergeable FROM p WHERE shared > 0.01 GROUP BY 1""")
def k7_piece_adjacency(s, d):
    """Pieces of the plan that share a side or part of one, across levels."""
    a = pieces.piece_adjacency(_block_plan(s, d), ["block_id"], cap=9e6)
    return a.groupBy("block_id").agg(F.count("*").alias("pairs"), F.round(F.sum("shared"), 2).alias("shared_m"), F.count_if("merge_allowed").alias("mergeable"))


@query()
def k2_tile_polygons(s, d):
    return tiles.tile_polygons(isochrone_polygons(s, d), 1 / 16, whole_below=0.01).select("analysis_id", "range_minutes", "tile_id", F.round("area", 9).alias("area"))


@query()
def k7_tile_adjacency(s, d):
    t = tiles.tile_polygons(isochrone_polygons(s, d), 1 / 16)
    return tiles.tile_adjacency(t, ["analysis_id", "range_minutes"], 1 / 16)


@query()
def d23_area_stats(s, d):
    t = tiles.tile_polygons(isochrone_polygons(s, d), 1 / 16).withColumn("area", F.col("area") * 10000)
    return tiles.area_stats(t, "analysis_id").select("analysis_id", "n", "below_1", "above_40", *(F.round(c, 6).alias(c) for c in ("median", "p10", "p90")))


@query("SELECT CAST(k % 25 AS INT) AS plan_id, COUNT(*) AS n FROM v_poi GROUP BY 1")
def k5_adaptive_conserves(s, d):
    p = view(s, d, "v_poi").withColumn("plan_id", (F.col("k") % 25).cast("int"))
    return tiles.adaptive_tiles(p, 40, 5).groupBy("plan_id").agg(F.sum("n").alias("n"))


_LEVELS = "SELECT CAST(k % 25 AS INT) AS plan_id, l, CAST(FLOOR(lon * POWER(2, l)) AS BIGINT) AS x, CAST(FLOOR(lat * POWER(2, l)) AS BIGINT) AS y, COUNT(*) AS n FROM v_poi CROSS JOIN (SELECT CAST(i AS INT) AS l FROM range(0, 6) r(i)) z GROUP BY 1, 2, 3, 4"


@query(f"WITH c AS ({_LEVELS}) SELECT c.plan_id, CAST(c.l AS BIGINT) AS level, COUNT(*) AS leaves, CAST(SUM(c.n) AS BIGINT) AS n, COUNT(*) FILTER (c.n >= 40) AS incomplete FROM c LEFT JOIN c u ON u.plan_id = c.plan_id AND u.l = c.l - 1 AND u.x = FLOOR(c.x / CAST(2 AS DOUBLE)) AND u.y = FLOOR(c.y / CAST(2 AS DOUBLE)) WHERE (c.n < 40 OR c.l = 5) AND (u.n IS NULL OR u.n >= 40) GROUP BY 1, 2")
def k5_adaptive_tiles(s, d):
    p = view(s, d, "v_poi").withColumn("plan_id", (F.col("k") % 25).cast("int"))
    return tiles.adaptive_tiles(p, 40, 5).groupBy("plan_id", F.col("level").cast("bigint").alias("level")).agg(F.count("*").alias("leaves"), F.sum("n").alias("n"), F.count_if("incomplete").alias("incomplete"))


# ---- ledgers ----


@query("SELECT service, job_id, CAST(GROUPING(service) * 2 + GROUPING(job_id) AS BIGINT) AS level, COUNT(*) AS n, CAST(SUM(attempted) AS BIGINT) AS attempted, CAST(SUM(upstream) AS BIGINT) AS upstream FROM v_service_event GROUP BY ROLLUP (service, job_id)")
def d21_ledger_totals(s, d):
    return ledger.ledger_totals(view(s, d, "v_service_event"))


@query("SELECT job_id, COUNT(*) AS n, COUNT(*) FILTER (state_idx < top AND prev <> 9) AS regressions FROM (SELECT job_id, state_idx, MAX(state_idx) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, LAG(state_idx) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS prev FROM v_service_event) t GROUP BY 1")
def e8_audit_transitions(s, d):
    return ledger.audit_transitions(view(s, d, "v_service_event")).groupBy("job_id").agg(F.count("*").alias("n"), F.count_if("regression").alias("regressions"))


@query("SELECT p AS from_state, state_idx AS to_state, COUNT(*) AS n FROM (SELECT state_idx, LAG(state_idx) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS p FROM v_service_event) t WHERE p IS NOT NULL AND p <> state_idx AND state_idx <> p + 1 GROUP BY 1, 2")
def e8_illegal_edges(s, d):
    edges = s.createDataFrame([(i, i + 1) for i in range(9)], "from_state int, to_state int")
    return ledger.illegal_edges(view(s, d, "v_service_event"), edges)


@query("SELECT service, event_id, running FROM (SELECT service, event_id, CAST(running AS BIGINT) AS running, ROW_NUMBER() OVER (PARTITION BY service ORDER BY ts, event_id) AS i FROM (SELECT service, event_id, ts, SUM(upstream) OVER (PARTITION BY service ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM v_service_event) t WHERE running > 100) u WHERE i = 1")
def e9_audit_budget(s, d):
    ev = view(s, d, "v_service_event")
    return ledger.audit_budget(ev, ev.select("service").distinct().withColumn("budget", F.lit(100)))


@query("SELECT service, observed_at, event_id, remaining, status_code FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY service ORDER BY observed_at DESC, event_id DESC) AS i FROM v_quota_obs) t WHERE i = 1")
def d27_latest_by_key(s, d):
    return publish.latest_by_key(view(s, d, "v_quota_obs"), ["service"], "observed_at", "event_id").select("service", "observed_at", "event_id", "remaining", "status_code")


@query("SELECT service, event_id, remaining FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY service ORDER BY observed_at DESC, event_id DESC) AS i FROM v_quota_obs WHERE remaining IS NOT NULL AND NOT (event_id % 2 = 0 AND event_id % 3 = 0)) t WHERE i = 1")
def g6_merge_quota(s, d):
    q = view(s, d, "v_quota_obs").withColumn("remaining", F.when((F.col("event_id") % 2 == 0) & (F.col("event_id") % 3 == 0), None).otherwise(F.col("remaining")))
    return ledger.merge_quota(q.where("event_id % 2 = 0"), q.where("event_id % 2 = 1")).select("service", "event_id", "remaining")


@query("SELECT service, status, COUNT(*) AS n FROM (SELECT service, CASE WHEN status_code = 429 THEN 'rate-limited' WHEN status_code = 403 THEN 'forbidden' WHEN remaining IS NULL THEN 'unknown' WHEN remaining <= 0 THEN 'exhausted' ELSE 'ok' END AS status FROM v_quota_obs) t GROUP BY 1, 2")
def h16_quota_status(s, d):
    return view(s, d, "v_quota_obs").groupBy("service", text.quota_status(F.col("status_code"), F.col("remaining")).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT endpoint_type, COUNT(*) AS n, COUNT(*) FILTER (ttl_seconds > 0 AND epoch(TIMESTAMP '2024-02-01 00:00:00') - FLOOR(epoch(retrieved_at)) > ttl_seconds) AS n_stale FROM v_response_record GROUP BY 1")
def h17_stale_responses(s, d):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    r = view(s, d, "v_response_record").withColumn("retrieved_at", F.col("retrieved_at").cast("timestamp"))
    return r.groupBy("endpoint_type").agg(F.count("*").alias("n"), F.count_if(text.stale(F.col("retrieved_at"), F.col("ttl_seconds"), now)).alias("n_stale"))


@query("""WITH a AS (SELECT event_id AS fingerprint, CAST(job_id % 40 AS BIGINT) AS approved, ts AS created_at, service FROM v_service_event WHERE event_id % 3 = 0), q AS (SELECT service, remaining, status_code FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY service ORDER BY observed_at DESC, event_id DESC) AS i FROM v_quota_obs) t WHERE i = 1),
 p AS (SELECT event_id AS fingerprint, service, CAST(30 AS BIGINT) AS budget FROM v_service_event)
SELECT verdict, COUNT(*) AS n FROM (SELECT CASE WHEN approved IS NULL THEN 'no-approval' WHEN approved > budget THEN 'budget-exceeded' WHEN status_code = 429 THEN 'rate-limited' WHEN approved > FLOOR(remaining * 0.8) THEN 'quota-exceeded' ELSE 'allowed' END AS verdict
 FROM p LEFT JOIN a ON a.fingerprint = p.fingerprint AND a.created_at <= TIMESTAMP '2024-01-20 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' < a.created_at + INTERVAL 10 DAY LEFT JOIN q ON q.service = p.service) t GROUP BY 1""")
def c17_gate_plans(s, d):
    ev = view(s, d, "v_service_event")
    plans = ev.select(F.col("event_id").alias("fingerprint"), F.lit("foot").alias("profile"), "service", F.lit(30).cast("bigint").alias("budget"))
    ap = ev.where("event_id % 3 = 0").select(F.col("event_id").alias("fingerprint"), F.lit("foot").alias("profile"), (F.col("job_id") % 40).cast("bigint").alias("approved"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("interval 10 days")).alias("expires_at"))
    q = publish.latest_by_key(view(s, d, "v_quota_obs"), ["service"], "observed_at", "event_id")
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return ledger.gate_plans(plans, ap, q, now).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT p.position, p.profile, CAST(SUM(a.n) AS BIGINT) AS requests, COUNT(a.n) AS plans FROM (VALUES (0, 'foot-walking'), (1, 'cycling-regular'), (2, 'driving-car'), (3, 'wheelchair')) p(position, profile) LEFT JOIN (SELECT v.profile, COUNT(*) AS n FROM v_analysis v JOIN v_accessibility x ON x.analysis_id = v.analysis_id GROUP BY v.profile, v.analysis_id) a ON a.profile = p.profile GROUP BY 1, 2")
def d22_profile_totals(s, d):
    plans = view(s, d, "v_accessibility").groupBy("analysis_id").agg(F.count("*").alias("requests")).join(view(s, d, "v_analysis"), "analysis_id")
    order = s.createDataFrame(list(enumerate(["foot-walking", "cycling-regular", "driving-car", "wheelchair"])), "position int, profile string")
    return ledger.profile_totals(plans, order)


@query("SELECT endpoint_type, COUNT(*) FILTER (ttl_seconds = 0) AS cached, COUNT(*) FILTER (ttl_seconds <> 0) AS remaining FROM v_response_record GROUP BY 1")
def c8_split_cached(s, d):
    """Responses of the others are there too, but truncated."""
    r = view(s, d, "v_response_record").withColumn("geometry_hash", F.sha2(F.col("event_id").cast("string"), 256))
    cached, rest = requests.split_cached(r, r.select("geometry_hash", (F.col("ttl_seconds") != 0).alias("truncated")))
    a = cached.groupBy("endpoint_type").agg(F.count("*").alias("cached"))
    b = rest.groupBy("endpoint_type").agg(F.count("*").alias("remaining"))
    return a.join(b, "endpoint_type", "full_outer").na.fill(0)


# ---- text ----


@query("""WITH p AS (SELECT page_id, COALESCE(url, 'none') AS url FROM pages) SELECT page_id, CASE page_id % 8 WHEN 0 THEN NULL WHEN 1 THEN regexp_replace(trim(url), '\\s+', ' ', 'g') || ' shop' WHEN 2 THEN 'node/' || page_id WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN 'Cafe ' || page_id WHEN 6 THEN NULL ELSE CASE WHEN page_id < 1000000 THEN '(' || page_id || ')' END END AS name FROM p""")
def h3_clean_name_urls(s, d):
    """A URL alone, a URL and a word, a path with a number, an osm-marked number, a phone number, wide letters, a bare number, and short digits in marks."""
    k = F.col("page_id")
    url = F.coalesce("url", F.lit("none"))
    forms = [F.when(url.rlike(r"(?i)^https?://\S+$"), url).otherwise("www.x.org"), F.concat(url, F.lit("  shop ")), F.concat(F.lit("node/"), k.cast("string")), F.concat(F.lit("OSM-node:"), k.cast("string")), F.concat(F.lit("+1 (555) 01-"), F.lpad(k.cast("string"), 7, "0")), F.concat(F.lit(" \uff23afe\t"), k.cast("string")), k.cast("string"), F.concat(F.lit("("), k.cast("string"), F.lit(")"))]
    name = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        name = F.when(k % 8 == i, f).otherwise(name)
    return run_sql(s, d, "SELECT page_id, url FROM pages").select("page_id", text.clean_name(name).alias("name"))


@query("SELECT p_partkey, LOWER(p_name) AS name_key FROM part")
def h6_name_key(s, d):
    return run_sql(s, d, "SELECT p_partkey, p_name FROM part").select("p_partkey", text.name_key(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit(" "))).alias("name_key"))


@query("SELECT poi_id, CASE WHEN duration_s < 0 THEN NULL WHEN duration_s < 59.5 THEN CAST(CAST(ROUND(duration_s) AS BIGINT) AS VARCHAR) || ' 秒' ELSE CAST(CAST(FLOOR(ROUND(duration_s) / 60) AS BIGINT) AS VARCHAR) || ' 分 ' || CAST(CAST(ROUND(duration_s) AS BIGINT) % 60 AS VARCHAR) || ' 秒' END AS label, CASE WHEN distance_m < 1000 THEN CAST(CAST(distance_m AS BIGINT) AS VARCHAR) || ' m' ELSE printf('%.1f km', FLOOR(distance_m / 100 + 0.5) / 10) END AS distance FROM v_accessibility")
def h15_duration_text(s, d):
    return view(s, d, "v_accessibility").select("poi_id", text.duration_text(F.col("duration_s")).alias("label"), text.distance_text(F.col("distance_m")).alias("distance"))


@query("SELECT poi_id, sha256(poi_id || '|' || k || '|' || printf('%.7f', FLOOR(lon * 10000000 + 0.5) / 10000000) || '|' || printf('%.7f', FLOOR(lat * 10000000 + 0.5) / 10000000)) AS id FROM v_poi")
def h14_identity(s, d):
    return view(s, d, "v_poi").select("poi_id", text.identity(F.col("poi_id"), F.col("k"), *map(text.number_text, (F.col("lon"), F.col("lat")))).alias("id"))


@query("SELECT poi_id, lower(lpad(to_hex(list_reduce(list_transform(string_split(poi_id, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, c: (xor(a, c) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT))), 8, '0')) AS hash FROM v_poi")
def h13_fnv1a32(s, d):
    return view(s, d, "v_poi").select("poi_id", text.fnv1a32(F.col("poi_id")).alias("hash"))


@query("WITH p AS (SELECT p_partkey, CAST(10 + p_partkey % 9 AS DOUBLE) AS font, CASE p_partkey % 4 WHEN 0 THEN 'é ' || p_name WHEN 1 THEN p_name || ' 数据' WHEN 2 THEN 'Ω ж 🙂' ELSE 'a' END AS t, CASE p_partkey % 4 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS wide FROM part), n AS (SELECT *, LENGTH(t) - LENGTH(REPLACE(t, ' ', '')) AS sp FROM p) SELECT p_partkey, CAST(GREATEST(18, CEIL((wide * CAST(1 AS DOUBLE) + sp * CAST(0.36 AS DOUBLE) + (LENGTH(t) - wide - sp) * CAST(0.58 AS DOUBLE)) * font + 8)) AS BIGINT) AS width, CAST(CEIL(font * CAST(1.34 AS DOUBLE) + 4) AS BIGINT) AS height FROM n")
def h19_label_width(s, d):
    k = F.col("p_partkey") % 4
    t = F.when(k == 0, F.concat(F.lit("é "), "p_name")).when(k == 1, F.concat("p_name", F.lit(" 数据"))).when(k == 2, "Ω ж 🙂").otherwise("a")
    b = run_sql(s, d, "SELECT p_partkey, p_name FROM part").withColumn("b", text.label_box(t, (10 + F.col("p_partkey") % 9).cast("double")))
    return b.select("p_partkey", F.col("b.width").cast("bigint").alias("width"), F.col("b.height").cast("bigint").alias("height"))


# ---- provider rules, guards, previews ----


@query("SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'not-feature' WHEN event_id % 11 = 0 THEN 'point-missing' WHEN event_id % 7 = 0 THEN 'coordinates-invalid' WHEN event_id % 5 = 0 THEN 'stable-id-missing' WHEN event_id % 3 = 0 THEN 'name-missing' END AS reason FROM events")
def b9_provider_reasons(s, d):
    e = run_sql(s, d, "SELECT event_id FROM events")
    k = F.col("event_id")
    e = e.withColumns({"type": F.when(k % 13 == 0, "Other").otherwise("Feature"), "gtype": F.when(k % 11 != 0, "Point"), "lon": F.when(k % 7 == 0, "east").otherwise("114.5"), "lat": F.lit("30.5"), "ident": F.when(k % 5 != 0, k), "name": F.when(k % 3 == 0, " ").otherwise("n")})
    return features.normalize_provider_features(e).select("event_id", "reason")


@query("SELECT a.analysis_id, 'g' || (a.analysis_id % 4) || ',h' AS groups FROM v_analysis a")
def b8_expand_category_filter(s, d):
    mapping = s.createDataFrame([(f"c{i}", g) for i in range(4) for g in (f"g{i}", "h")], "category_id string, group_id string")
    req = view(s, d, "v_analysis").select("analysis_id", F.array(F.concat(F.lit("c"), (F.col("analysis_id") % 4).cast("string")), F.lit("unknown")).alias("requested"))
    return categories.expand_category_filter(req, mapping).select("analysis_id", F.array_join("groups", ",").alias("groups"))


@query("SELECT top_id, COUNT(*) AS n FROM v_poi_category WHERE top_id IN ('ASIA', 'EUROPE') GROUP BY 1")
def b11_filter_visible(s, d):
    return selection.filter_visible(view(s, d, "v_poi_category"), "top_id", ["ASIA", "EUROPE"]).groupBy("top_id").agg(F.count("*").alias("n"))


@query("SELECT poi_id, 'Place ' || k AS label, 'poi:' || k AS candidate_id FROM v_poi")
def b16_normalize_geocoder(s, d):
    p = view(s, d, "v_poi").select("poi_id", F.col("poi_id").alias("id"), F.lit(" ").alias("label"), F.concat(F.lit("Place "), F.col("k").cast("string")).alias("name"), "lon", "lat", F.array(F.lit("City"), F.lit(" City "), F.lit("")).alias("context"))
    return requests.normalize_geocoder(p).select("poi_id", "label", "candidate_id")


@query("SELECT k AS row_id, CASE WHEN k % 3 = 0 THEN 'g2' WHEN k % 3 = 1 THEN 'g1' END AS group_id FROM v_poi")
def c19_map_provider_category(s, d):
    catalog = s.createDataFrame([("c1", "g1"), ("c2", "g2")], "category_id string, group_id string")
    k = F.col("k")
    p = view(s, d, "v_poi").select(k.alias("row_id"), F.when(k % 3 == 0, F.array(F.lit("zz"), F.lit("c2"), F.lit("c1"))).otherwise(F.array(F.lit("zz"))).alias("category_ids"), F.when(k % 3 == 1, F.array(F.lit("q"), F.lit("g1"))).otherwise(F.array(F.lit("q"))).alias("group_ids"))
    return categories.map_provider_category(p, catalog).select("row_id", "group_id")


@query("""WITH t AS (SELECT plan_id AS analysis_id, source_id, pos, CASE WHEN source_id IS NULL THEN 'stable-id-missing' WHEN pos % 6 = 0 THEN 'name-missing' WHEN pos % 7 = 0 THEN 'coordinates-invalid' END AS reason, pos % 2 = 0 AS is_match, pos % 4 = 0 AS is_selected FROM v_piece_result)
SELECT analysis_id, COUNT(*) AS received, COUNT(DISTINCT source_id) AS deduplicated, COUNT(*) FILTER (reason = 'name-missing') AS unnamed, COUNT(*) FILTER (reason IN ('coordinates-invalid', 'stable-id-missing')) AS invalid, COUNT(DISTINCT source_id) FILTER (reason IS NULL AND is_match) AS matched, COUNT(DISTINCT source_id) FILTER (reason IS NULL AND is_selected) AS returned FROM t GROUP BY 1""")
def d14_provider_coverage(s, d):
    p = F.col("pos")
    reason = F.when(F.col("source_id").isNull(), "stable-id-missing").when(p % 6 == 0, "name-missing").when(p % 7 == 0, "coordinates-invalid")
    t = view(s, d, "v_piece_result").select(F.col("plan_id").alias("analysis_id"), "source_id", reason.alias("reason"), (p % 2 == 0).alias("is_match"), (p % 4 == 0).alias("is_selected"))
    return selection.provider_coverage(t)


@query("SELECT analysis_id, ring_id, poi_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY analysis_id, ring_id ORDER BY travel_time_s, poi_id) AS i FROM v_score) t WHERE i <= 5")
def f6_sample_rows(s, d):
    return selection.sample_rows(view(s, d, "v_score"), 5, ["analysis_id", "ring_id"], "travel_time_s", "poi_id").select("analysis_id", "ring_id", "poi_id")


@query("SELECT analysis_id, range_minutes, CASE WHEN range_minutes = 10 THEN 'ok' ELSE 'area-limit' END AS status FROM (SELECT DISTINCT analysis_id, range_minutes FROM v_edge) t")
def f7_guard_area(s, d):
    p = isochrone_polygons(s, d).withColumn("area_km2", geo.area_km2(F.col("polygon")))
    return selection.guard_area(p, 150.0).select("analysis_id", "range_minutes", "status")


@query("""WITH f AS (SELECT analysis_id FROM v_analysis WHERE profile = 'foot-walking'), r AS (SELECT analysis_id, ring_id, poi_id FROM v_score), p AS (SELECT analysis_id, CONCAT('ring-0-', outer_minutes) AS ring_id, poi_id FROM v_ring_poi WHERE analysis_id IN (SELECT analysis_id FROM f)), u AS (SELECT * FROM r WHERE analysis_id NOT IN (SELECT analysis_id FROM f) UNION ALL SELECT * FROM p)
SELECT u.analysis_id, ring_id, COUNT(*) AS n, CASE WHEN u.analysis_id IN (SELECT analysis_id FROM f) THEN 'old,preview' ELSE 'old' END AS warnings FROM u GROUP BY 1, 2""")
def g7_merge_preview(s, d):
    """The walking analyses have previews."""
    r = view(s, d, "v_score").select("analysis_id", "ring_id", "poi_id", F.lit("old").alias("warning"))
    walking = view(s, d, "v_analysis").where("profile = 'foot-walking'").select("analysis_id")
    p = assigned(s, d).join(walking.hint("broadcast"), "analysis_id").select("analysis_id", F.concat(F.lit("ring-0-"), F.col("outer_minutes").cast("string")).alias("ring_id"), "poi_id", F.lit("preview").alias("warning"))
    return selection.merge_preview(r, p)[1].select("analysis_id", "ring_id", "n", F.array_join("warnings", ",").alias("warnings"))


@query("SELECT e.analysis_id, e.range_minutes, CAST(COUNT(*) AS BIGINT) AS n_vertices, CAST(1 AS BIGINT) AS n_parts, CAST(1 AS BIGINT) AS n_rings, ROUND(4 * PI() * ABS(SUM((x1 - a.lon) * (y2 - a.lat) - (x2 - a.lon) * (y1 - a.lat))) / 2 / POWER(SUM(SQRT(POWER(x2 - x1, 2) + POWER(y2 - y1, 2))), 2), 9) AS compactness, CAST(5 + SUM(LENGTH(CAST(x1 AS VARCHAR)) + LENGTH(CAST(y1 AS VARCHAR)) + 12) AS BIGINT) AS json_bytes FROM v_edge e JOIN v_analysis a ON a.analysis_id = e.analysis_id GROUP BY 1, 2")
def k8_piece_report(s, d):
    return tiles.piece_report(isochrone_polygons(s, d)).select("analysis_id", "range_minutes", *(F.col(c).cast("bigint").alias(c) for c in ("n_vertices", "n_parts", "n_rings", "json_bytes")), F.round("compactness", 9).alias("compactness"))


@query("SELECT analysis_id, CAST(COUNT(*) AS BIGINT) AS n_parts, TRUE AS conserved FROM (SELECT DISTINCT analysis_id, range_minutes FROM v_edge) t GROUP BY 1")
def k6_split_parts(s, d):
    """The cumulative polygons of an analysis as parts of one; each part comes back with its area."""
    multi = isochrone_polygons(s, d).groupBy("analysis_id").agg(F.flatten(F.array_sort(F.collect_list("polygon"))).alias("polygon"))
    p = tiles.split_parts(multi)
    return p.groupBy("analysis_id").agg(F.count("*").alias("n_parts"), (F.abs(F.sum("area") - F.first("whole_area")) < 1e-9).alias("conserved"))


@query("SELECT poi_id, CAST(FLOOR(((deg + 22.5) - FLOOR((deg + 22.5) / 360) * 360) / 45) AS BIGINT) AS sector FROM (SELECT poi_id, DEGREES(ATAN2(lat - 30.5003, lon - 114.0007)) AS deg FROM v_poi) t")
def h10_sector(s, d):
    a = F.degrees(F.atan2(F.col("lat") - 30.5003, F.col("lon") - 114.0007))
    return view(s, d, "v_poi").select("poi_id", geo.sector(a, 8).cast("bigint").alias("sector"))


@query("SELECT poi_id, ROUND(b - FLOOR(b / 360) * 360, 6) AS bearing FROM (SELECT poi_id, DEGREES(ATAN2(SIN(RADIANS(lon - 114.3)) * COS(RADIANS(lat)), COS(RADIANS(30.6)) * SIN(RADIANS(lat)) - SIN(RADIANS(30.6)) * COS(RADIANS(lat)) * COS(RADIANS(lon - 114.3)))) AS b FROM v_poi) t")
def h9_bearing(s, d):
    return view(s, d, "v_poi").select("poi_id", F.round(geo.bearing(F.lit(114.3), F.lit(30.6), F.col("lon"), F.col("lat")), 6).alias("bearing"))


@query("""WITH v AS (SELECT analysis_id, range_minutes, seq, x, y, COUNT(*) OVER (PARTITION BY analysis_id, range_minutes) AS n, ROW_NUMBER() OVER (PARTITION BY analysis_id, range_minutes ORDER BY x, y) AS low FROM v_ring_vertex), f AS (SELECT analysis_id, range_minutes, seq AS first FROM v WHERE low = 1)
SELECT v.analysis_id, v.range_minutes, sha256(STRING_AGG(printf('%.7f %.7f', x, y), ',' ORDER BY (seq - first + n) % n)) AS hash, TRUE AS same FROM v JOIN f ON f.analysis_id = v.analysis_id AND f.range_minutes = v.range_minutes GROUP BY 1, 2""")
def h21_geometry_hash(s, d):
    """The hash of the canonical text, and the same one from rings that are turned round and start elsewhere."""
    p = isochrone_polygons(s, d)
    turned = F.transform("polygon", lambda part: F.transform(part, lambda r: F.concat(F.slice(F.reverse(r), 3, 99), F.slice(F.reverse(r), 1, 2))))
    h = geo.geometry_hash(F.col("polygon"))
    return p.select("analysis_id", "range_minutes", h.alias("hash"), (h == geo.geometry_hash(turned)).alias("same"))


from . import more  # noqa: E402, F401  further queries register themselves
