"""Geographic stand-in tables derived from the driver's tables, as SQL that Spark and DuckDB both accept."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_analysis": """SELECT n_nationkey AS analysis_id, CASE n_nationkey % 3 WHEN 0 THEN 'foot-walking' WHEN 1 THEN 'cycling-regular' ELSE 'driving-car' END AS profile,
 114 + CAST(n_nationkey % 5 AS DOUBLE)/8 AS lon, 30.5 + CAST(FLOOR(CAST(n_nationkey AS DOUBLE)/5) AS DOUBLE)/8 AS lat FROM nation""",
    "v_range": "SELECT * FROM (VALUES (10, 64), (20, 112), (30, 176)) AS t(range_minutes, r)",
    "v_vertex": "SELECT * FROM (VALUES (0,2,1),(1,1,2),(2,0,1),(3,-1,2),(4,-2,1),(5,-2,-1),(6,-1,-2),(7,1,-2),(8,2,-1)) AS t(i, fx, fy)",
    "v_ring_vertex": """SELECT a.analysis_id, g.range_minutes, ROW_NUMBER() OVER (PARTITION BY a.analysis_id, g.range_minutes ORDER BY v.i) AS seq,
 a.lon + CAST(v.fx * g.r AS DOUBLE)/2048 AS x, a.lat + CAST(v.fy * g.r AS DOUBLE)/2048 AS y
 FROM v_analysis a CROSS JOIN v_range g CROSS JOIN v_vertex v WHERE NOT (v.i = 2 AND (a.analysis_id % 2 = 0 OR g.range_minutes = 10))""",
    "v_edge": """SELECT analysis_id, range_minutes, seq, x AS x1, y AS y1,
 COALESCE(LEAD(x) OVER (PARTITION BY analysis_id, range_minutes ORDER BY seq), FIRST_VALUE(x) OVER (PARTITION BY analysis_id, range_minutes ORDER BY seq)) AS x2,
 COALESCE(LEAD(y) OVER (PARTITION BY analysis_id, range_minutes ORDER BY seq), FIRST_VALUE(y) OVER (PARTITION BY analysis_id, range_minutes ORDER BY seq)) AS y2 FROM v_ring_vertex""",
    "v_poi": """SELECT CONCAT('poi:', CAST(o_orderkey AS VARCHAR(20))) AS poi_id, o_orderkey AS k, o_custkey AS source_key,
 113.75 + CAST((o_orderkey * 7919) % 1024 AS DOUBLE)/1024 AS lon, 30.25 + CAST((o_orderkey * 104729) % 1021 AS DOUBLE)/1024 AS lat FROM orders""",
    "v_accessibility": """SELECT CAST(o_custkey % 25 AS INT) AS analysis_id, CONCAT('poi:', CAST(o_orderkey AS VARCHAR(20))) AS poi_id,
 CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN CAST(-1 AS DOUBLE) WHEN o_orderkey % 43 = 0 THEN CAST(600 AS DOUBLE)
  ELSE CAST((o_orderkey * 48271) % 2600 AS DOUBLE) + CAST(1 AS DOUBLE)/2 END AS duration_s,
 CAST((o_orderkey * 69621) % 9000 AS DOUBLE) AS distance_m FROM orders""",
    "v_category": """SELECT c.c_custkey, r.r_name AS top_id, n.n_name AS basic_id, CONCAT(c.c_mktsegment, ' ', n.n_name) AS primary_id
 FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "v_layout_node": """SELECT c_nationkey AS layout_id, c_custkey AS node_id, 114 + CAST((c_custkey*7919) % 1021 - 510 AS DOUBLE)/1024 AS lon, 30.5 + CAST((c_custkey*104729) % 1019 - 509 AS DOUBLE)/1024 AS lat,
 CAST((c_custkey*31337) % 1499 - 749 AS DOUBLE) AS x, CAST((c_custkey*27644437) % 1493 - 746 AS DOUBLE) AS y, 20 + c_custkey % 60 AS width, 18 AS height FROM customer""",
    "v_service_event": """SELECT event_id, ts, CAST(user_id % 200 AS INT) AS job_id, CASE event_type WHEN 'click' THEN 'isochrones' WHEN 'view' THEN 'pois' WHEN 'purchase' THEN 'matrix' WHEN 'signup' THEN 'geocoder' ELSE 'directions' END AS service,
 CAST(event_id % 10 AS INT) AS state_idx, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS upstream, 1 AS attempted, value FROM events""",
    "v_feature_json": """SELECT event_id AS pos, CONCAT('{"type":"Feature","id":"', CAST(CASE WHEN event_id % 10 = 9 THEN event_id - 1 ELSE event_id END AS VARCHAR(20)),
 '","geometry":{"type":"', CASE WHEN event_id % 53 = 0 THEN 'LineString' ELSE 'Point' END,
 '","coordinates":[114.', CAST(1000 + (event_id * 7919) % 9000 AS VARCHAR(8)), ',30.', CAST(1000 + (event_id * 104729) % 8999 AS VARCHAR(8)),
 ']},"properties":{"names":{"primary":"', CASE WHEN event_id % 29 = 0 THEN ' ' ELSE CONCAT('Name ', CAST(user_id AS VARCHAR(20))) END,
 '"},"taxonomy":{"hierarchy":["shopping","', event_type, '"],"primary":"', CASE WHEN event_id % 31 = 0 THEN 'shopping' ELSE event_type END,
 '","alternates":["gift_shop"]},"basic_category":', CASE WHEN event_id % 7 = 0 THEN 'null' ELSE '"shopping"' END,
 ',"operating_status":"', CASE WHEN event_id % 23 = 0 THEN 'permanently_closed' ELSE 'operating' END,
 '","confidence":', CASE WHEN event_id % 19 = 0 THEN 'null' ELSE CONCAT('0.', CAST(10 + event_id % 90 AS VARCHAR(4))) END, '}}') AS line FROM events""",
    "v_piece_result": """SELECT CAST(p.k % 25 AS INT) AS plan_id, g.piece, p.k AS pos, CASE WHEN p.k % 11 = 0 THEN NULL ELSE CONCAT('node-', CAST(p.k % 4000 AS VARCHAR(20))) END AS source_id,
 'osm' AS source, CONCAT('Shop  ', CAST(p.k % 50 AS VARCHAR(8))) AS name, p.lon, p.lat
 FROM v_poi p JOIN (SELECT * FROM (VALUES (0), (1)) AS t(piece)) g ON g.piece = p.k % 2 OR p.k % 17 = 0""",
    "v_quota_obs": """SELECT event_id, ts AS observed_at, service, CAST(SUBSTRING(props, 7, LENGTH(props) - 7) AS INT) AS remaining,
 CASE WHEN event_id % 97 = 0 THEN 429 WHEN event_id % 89 = 0 THEN 403 ELSE 200 END AS status_code
 FROM (SELECT e.*, x.service FROM events e JOIN v_service_event x ON x.event_id = e.event_id) q""",
    "v_response_record": """SELECT event_id, service AS endpoint_type, job_id, ts AS retrieved_at, CASE service WHEN 'pois' THEN 604800 WHEN 'matrix' THEN 86400 ELSE 0 END AS ttl_seconds FROM v_service_event""",
    "v_score": """SELECT a.analysis_id, a.poi_id, a.duration_s AS travel_time_s,
 CASE WHEN a.duration_s <= 600 THEN 'ring-0-10' WHEN a.duration_s <= 1200 THEN 'ring-10-20' ELSE 'ring-20-30' END AS ring_id,
 CASE WHEN p.k % 3 = 0 THEN NULL ELSE CAST(p.k % 6 AS DOUBLE) END AS rating, CASE WHEN p.k % 5 = 0 THEN NULL ELSE CAST(p.k % 9 AS DOUBLE) END AS importance
 FROM v_accessibility a JOIN v_poi p ON p.poi_id = a.poi_id WHERE a.duration_s > 0 AND a.duration_s <= 1800""",
    # A block of land for each customer, in metres: corner, width, height, and what is wrong with its pieces.
    "v_block": """SELECT c_custkey AS block_id, CAST(500000 + (c_custkey % 97) * 137 AS DOUBLE) AS x0, CAST(3300000 + (c_custkey % 89) * 211 AS DOUBLE) AS y0, CAST(700 * (2 + c_custkey % 5) AS DOUBLE) AS w, CAST(900 * (1 + c_custkey % 3) AS DOUBLE) AS h, CAST(c_custkey % 6 AS INT) AS mode FROM customer""",
    # Leaf boxes of the plan of blocks three times as wide and twice as high, by a grid of 5 km and up to two quarterings down to 8 square kilometres.
    "v_block_leaf": """SELECT block_id, id, level, bx0 + q * (bx1 - bx0) / k AS x0, bx0 + (q + 1) * (bx1 - bx0) / k AS x1, by0 + p * (by1 - by0) / k AS y0, by0 + (p + 1) * (by1 - by0) / k AS y1, q, p FROM
 (SELECT z.*, CASE WHEN (bx1 - bx0) * (by1 - by0) <= 8000001 THEN 0 WHEN (bx1 - bx0) * (by1 - by0) <= 32000004 THEN 1 ELSE 2 END AS level, CAST(CASE WHEN (bx1 - bx0) * (by1 - by0) <= 8000001 THEN 1 WHEN (bx1 - bx0) * (by1 - by0) <= 32000004 THEN 2 ELSE 4 END AS INT) AS k FROM
  (SELECT block_id, r.i * 100 + c.i AS id, GREATEST(x0, CASE WHEN whole THEN x0 ELSE 5000 * (FLOOR(x0 / 5000) + c.i) END) AS bx0, LEAST(x0 + 3 * w, CASE WHEN whole THEN x0 + 3 * w ELSE 5000 * (FLOOR(x0 / 5000) + c.i + 1) END) AS bx1,
    GREATEST(y0, CASE WHEN whole THEN y0 ELSE 5000 * (FLOOR(y0 / 5000) + r.i) END) AS by0, LEAST(y0 + 2 * h, CASE WHEN whole THEN y0 + 2 * h ELSE 5000 * (FLOOR(y0 / 5000) + r.i + 1) END) AS by1
   FROM (SELECT b.*, 6 * w * h <= 8000001 AS whole FROM v_block b) b CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3)) AS t(i)) r CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3), (4)) AS t(i)) c WHERE NOT whole OR (r.i = 0 AND c.i = 0)) z WHERE bx1 > bx0 AND by1 > by0) y
 JOIN (SELECT * FROM (VALUES (0), (1), (2), (3)) AS t(q)) qs ON q < k JOIN (SELECT * FROM (VALUES (0), (1), (2), (3)) AS t(p)) ps ON p < k""",
    # A point, its exclusive ring by brute force: the reference form for everything that builds on ring assignment.
    "v_ring_poi": """SELECT analysis_id, poi_id, MIN(range_minutes) AS outer_minutes FROM (SELECT c.analysis_id, c.range_minutes, c.poi_id,
 SUM(CASE WHEN (e.y1 > c.lat) <> (e.y2 > c.lat) AND c.lon < (e.x2-e.x1)*(c.lat-e.y1)/(e.y2-e.y1)+e.x1 THEN 1 ELSE 0 END) AS crossings,
 MAX(CASE WHEN (e.x2-e.x1)*(c.lat-e.y1) = (e.y2-e.y1)*(c.lon-e.x1) AND c.lon BETWEEN LEAST(e.x1,e.x2) AND GREATEST(e.x1,e.x2) AND c.lat BETWEEN LEAST(e.y1,e.y2) AND GREATEST(e.y1,e.y2) THEN 1 ELSE 0 END) AS on_edge
 FROM (SELECT b.analysis_id, b.range_minutes, p.poi_id, p.lon, p.lat FROM (SELECT analysis_id, range_minutes, MIN(x1) x0, MAX(x1) xm, MIN(y1) y0, MAX(y1) ym FROM v_edge GROUP BY 1,2) b JOIN v_poi p ON p.lon BETWEEN b.x0 AND b.xm AND p.lat BETWEEN b.y0 AND b.ym) c
 JOIN v_edge e ON e.analysis_id=c.analysis_id AND e.range_minutes=c.range_minutes GROUP BY 1,2,3) h WHERE crossings % 2 = 1 OR on_edge = 1 GROUP BY 1,2""",
    # Points with a category path, by the customer that owns the order.
    "v_poi_category": """SELECT p.poi_id, p.k, p.lon, p.lat, c.top_id, c.basic_id, c.primary_id FROM v_poi p JOIN v_category c ON c.c_custkey = p.source_key""",
}


def needs(sql: str) -> list[str]:
    """Views that a statement uses, each after those it needs itself."""
    out: list[str] = []

    def add(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_[a-z_]+\b", text)):
            if name in VIEWS and name not in out:
                add(VIEWS[name])
                if name not in out:
                    out.append(name)

    add(sql)
    return out


def with_views(sql: str) -> str:
    """The statement with its views as common table expressions."""
    names = needs(sql)
    if not names:
        return sql
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.strip()
    return f"WITH {head}, {body[4:].strip()}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Spark result of a statement over the driver's tables and the views above."""
    text = with_views(sql)
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"SELECT * FROM {name}")
