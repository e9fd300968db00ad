"""Further queries: readers, publishing, merges, gates, profiles, batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..lineage import scratch
from ..operators import layout, ledger, publish, requests, selection, spatial
from ..sources import datasets, features
from ..streaming import jobs
from . import queries as base
from .fixtures import run_sql, view
from .registry import query

# ---- readers: the feature lines as files of each kind ----

_FLAT = """SELECT 'overture:' || (CASE WHEN event_id % 10 = 9 THEN event_id - 1 ELSE event_id END) AS poi_id, CASE WHEN event_id % 29 = 0 THEN NULL ELSE 'Name ' || user_id END AS name,
 CASE WHEN event_id % 53 <> 0 THEN CAST('114.' || (1000 + (event_id * 7919) % 9000) AS DOUBLE) END AS lon, CASE WHEN event_id % 53 <> 0 THEN CAST('30.' || (1000 + (event_id * 104729) % 8999) AS DOUBLE) END AS lat,
 'shopping/' || event_type AS path, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'shopping' END AS basic_id, CASE WHEN event_id % 19 = 0 THEN NULL ELSE (10 + event_id % 90) / 100.0 END AS confidence FROM events"""


def flat(features_: DataFrame) -> DataFrame:
    return features.flatten_features(features_).select("poi_id", "name", "lon", "lat", F.array_join("hierarchy", "/").alias("path"), "basic_id", "confidence")


@query(_FLAT)
def a1_read_geojson(s, d):
    """One collection a hundredth event number and file."""
    lines = view(s, d, "v_feature_json").groupBy((F.col("pos") % 100).alias("g")).agg(F.array_join(F.collect_list("line"), ",").alias("all"))
    path = scratch(s, "geojson")
    lines.repartition(20, "g").select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "all", F.lit("]}"))).write.option("maxRecordsPerFile", 1).text(path)
    return flat(features.read_geojson(s, path))


def _lines(s: SparkSession, d: str, suffix: str) -> str:
    """The feature lines with a blank line and one that is no object for every 40th."""
    path = f"{scratch(s, 'features')}{suffix}"
    more = F.when(F.col("pos") % 40 == 0, F.array("line", F.lit(" "), F.lit("[1, 2]"))).otherwise(F.array("line"))
    view(s, d, "v_feature_json").select(F.explode(more)).write.text(path)
    return path


@query(_FLAT)
def a2_read_geojsonl(s, d):
    return flat(features.read_geojsonl(s, _lines(s, d, "")))


@query(_FLAT)
def a3_read_geoparquet(s, d):
    f = features.parse_features(view(s, d, "v_feature_json"))
    p = F.col("properties")
    rows = f.select("id", p["names"].alias("names"), p["taxonomy"].alias("taxonomy"), p["basic_category"].alias("basic_category"), p["confidence"].cast("double").alias("confidence"), *(F.when(F.col("geometry.type") == "Point", F.col("geometry.coordinates")[i]).alias(c) for i, c in enumerate(("lon", "lat"))))
    path = f"{scratch(s, 'features')}.parquet"
    features.write_geoparquet(rows, path)
    return flat(features.read_geoparquet(s, path))


@query(_FLAT)
def a4_read_features(s, d):
    return flat(features.read_features(s, _lines(s, d, ".geojsonl")))


@query("SELECT poi_id, k FROM v_poi WHERE lon > 114.25")
def a5_publish_dataset(s, d):
    """Published, sent again, refused, replaced by nothing and by the eastern points; what the registry then names."""
    path, poi = scratch(s, "datasets"), view(s, d, "v_poi").select("poi_id", "k", "lon")
    east = poi.where("lon > 114.25")
    done = [datasets.publish_dataset(poi, path, "poi", "r1"), datasets.publish_dataset(poi.repartition(3), path, "poi", "r1")]
    try:
        datasets.publish_dataset(east, path, "poi", "r1")
    except ValueError:
        done.append("refused")
    done += [datasets.publish_dataset(poi.where("false"), path, "poi", "r2", replace=True), str(datasets.read_dataset(s, path, "poi").count()), datasets.publish_dataset(east, path, "poi", "r3", replace=True)]
    if done != ["published", "unchanged", "refused", "published", "0", "published"]:
        raise AssertionError(done)
    return datasets.read_dataset(s, path, "poi").select("poi_id", "k")


@query("SELECT n_name AS dataset_id, 'r' || (n_nationkey % 4) AS release, n_regionkey AS region_id, CAST(ROW_NUMBER() OVER (ORDER BY 'r' || (n_nationkey % 4), n_regionkey, n_name) AS BIGINT) AS place FROM nation WHERE n_nationkey % 3 <> 0")
def a7_list_ready_datasets(s, d):
    registry = run_sql(s, d, "SELECT n_name AS dataset_id, CONCAT('r', CAST(n_nationkey % 4 AS VARCHAR(9))) AS release, n_regionkey AS region_id, n_nationkey % 3 <> 0 AS ready FROM nation")
    listed = datasets.list_ready_datasets(registry).select("dataset_id", "release", "region_id").coalesce(1)
    return listed.withColumn("place", F.monotonically_increasing_id() + 1)


@query("SELECT endpoint_type, job_id, COUNT(*) AS n, CAST(SUM(ttl_seconds) AS BIGINT) AS ttl FROM v_response_record GROUP BY 1, 2")
def a8_response_records(s, d):
    """One file a service and job in folders by service; every service has a file that is cut off."""
    root = scratch(s, "responses")
    r = view(s, d, "v_response_record").groupBy("endpoint_type", "job_id").agg(F.count("*").alias("n"), F.sum("ttl_seconds").alias("ttl"))
    whole = r.withColumn("value", F.to_json(F.struct("endpoint_type", "job_id", "n", "ttl")))
    broken = r.select("endpoint_type").distinct().withColumn("value", F.lit('{"endpoint_type": "x", "n": '))
    both = whole.select(F.col("endpoint_type").alias("folder"), "value").union(broken)
    both.repartition(4).write.partitionBy("folder").option("maxRecordsPerFile", 1).format("text").save(root)
    # Spark's text files have no suffix of their own, so all are read.
    return datasets.read_response_records(s, root, "endpoint_type string, job_id int, n bigint, ttl bigint", "*.txt")


# ---- import, names, requests ----


@query("SELECT poi_id FROM v_poi WHERE lon BETWEEN 114 AND 114.5 AND lat BETWEEN 30.5 AND 31")
def b4_bbox_filter(s, d):
    return features.bbox_filter(view(s, d, "v_poi"), 114.0, 30.5, 114.5, 31.0).select("poi_id")


@query(f"{base._VIOLATIONS} SELECT analysis_id, poi_id, ring_id FROM (SELECT *, CASE WHEN travel_time_s < 50 THEN 'ring-20-30' ELSE ring_id END AS ring, CAST(SUBSTRING(poi_id, 5) AS BIGINT) AS k FROM pub) p WHERE matrix_status = 'ok' AND travel_time_s <= 1800 AND ring = ring_id AND k % 11 <> 0")
def b10_eligible_pois(s, d):
    """Rows in another ring than their band, and points without a name, are not shown."""
    p = base.published(s, d)[0].withColumn("band", F.col("ring_id"))
    k = F.substring("poi_id", 5, 99).try_cast("bigint")
    p = p.withColumns({"ring_id": F.when(F.col("travel_time_s") < 50, "ring-20-30").otherwise(F.col("ring_id")), "name": F.when(k % 11 != 0, "n")})
    return publish.eligible_pois(p).select("analysis_id", "poi_id", "ring_id")


_TAGGED = """SELECT k, CASE k % 7 WHEN 0 THEN '名' || k WHEN 1 THEN 'Plain ' || k WHEN 2 THEN '汉 ' || k WHEN 3 THEN 'Over ' || k WHEN 4 THEN 'English ' || k WHEN 5 THEN 'Old ' || k END AS name,
 CASE k % 7 WHEN 0 THEN 'zh-CN' WHEN 1 THEN NULL WHEN 2 THEN 'zh' WHEN 3 THEN NULL WHEN 4 THEN 'en' END AS name_locale, CASE k % 7 WHEN 6 THEN NULL ELSE 'n' || k END AS ident, CASE WHEN k % 7 = 6 THEN 'stable-id-missing' END AS reason FROM v_poi"""


@query(_TAGGED)
def h4_provider_names(s, d):
    """Names by tag order, in nested language maps, from tags put over properties; the last form has neither name nor id."""
    k = F.col("k")
    t = lambda x: F.concat(F.lit(x), k.cast("string"))
    ident = (F.lit("osm_id"), t("n"))
    forms = [
        (F.create_map(F.lit("name"), t("Plain "), F.lit("name:zh"), t("名"), *ident), None),
        (F.create_map(F.lit("name"), t("Plain "), F.lit("name:zh"), F.lit("https://x.org/a"), *ident), None),
        (F.create_map(F.lit("name"), F.concat(F.lit('{"en":"E","zh":"汉 '), k.cast("string"), F.lit('"}')), *ident), None),
        (F.create_map(F.lit("name"), t("Under "), *ident), F.create_map(F.lit("name"), t("Over "))),
        (F.create_map(F.lit("name:en"), t("English "), F.lit("name"), F.lit("1234567")), F.create_map(*ident)),
        (F.create_map(F.lit("name"), t("Old "), F.lit("osmId"), t("n")), None),
        (F.create_map(F.lit("shop"), F.lit("x")), None),
    ]
    none = F.lit(None).cast("map<string,string>")
    properties, tags = none, none
    for i, (a, b) in enumerate(forms):
        properties, tags = F.when(k % 7 == i, a).otherwise(properties), tags if b is None else F.when(k % 7 == i, b).otherwise(tags)
    p = view(s, d, "v_poi").select("k", F.lit("Feature").alias("type"), F.lit("Point").alias("gtype"), "lon", "lat", properties.alias("properties"), tags.alias("osm_tags"))
    n = features.with_provider_names(p)
    return features.normalize_provider_features(n).select("k", "name", "name_locale", "ident", "reason")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN c_mktsegment || '|' || c_name ELSE c_mktsegment END AS categories FROM customer")
def b13_normal_categories(s, d):
    c = run_sql(s, d, "SELECT c_custkey, c_mktsegment, c_name FROM customer")
    k, spaced = F.col("c_custkey"), F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))
    lists = F.when(k % 5 == 0, F.array(F.lit(" "), F.lit(""))).when(k % 2 == 0, F.array(spaced, "c_name", "c_mktsegment")).otherwise(F.array(F.lit(""), "c_mktsegment", spaced))
    return c.select("c_custkey", F.array_join(requests.normal_categories(lists), "|").alias("categories"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '中 ' || s_name WHEN 1 THEN s_name WHEN 2 THEN 'de ' || s_name ELSE 'first' END AS name FROM supplier")
def h1_choose_name(s, d):
    """A preferred locale (with another spelling), the primary name, the second preferred one, the first of all."""
    k, one = F.col("s_suppkey") % 4, lambda v, locale, primary=False: F.struct(v.alias("value"), F.lit(locale).alias("locale"), F.lit(primary).alias("primary"))
    name = F.col("s_name")
    de, zh, top = one(F.concat(F.lit("de "), name), "de-AT"), one(F.concat(F.lit("中 "), name, F.lit(" ")), "ZH_cn"), one(name, "", True)
    names = F.when(k == 0, F.array(top, de, zh)).when(k == 1, F.array(one(F.lit(" "), "zh"), top)).when(k == 2, F.array(top, de)).otherwise(F.array(one(F.lit(""), "", True), one(F.lit("first"), "fr"), one(F.lit("second"), "it")))
    return run_sql(s, d, "SELECT s_suppkey, s_name FROM supplier").select("s_suppkey", text.choose_name(names, ["zh-CN", "de"]).alias("name"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN 'Town' WHEN 2 THEN '430000' END AS address FROM supplier")
def h2_address_text(s, d):
    k, none = F.col("s_suppkey") % 4, F.lit(None).cast("string")
    one = lambda **x: F.struct(*(x.get(f, none).alias(f) for f in ("freeform", "value", "locality", "street", "postcode")))
    a = F.when(k == 0, F.array(one(freeform=F.concat(F.lit(" "), "s_name"), locality=F.lit("Town")), one(value=F.lit("x")))).when(k == 1, F.array(one(freeform=F.lit(" "), locality=F.lit("Town"), street=F.lit("Road")))).when(k == 2, F.array(one(postcode=F.lit("430000"))))
    return run_sql(s, d, "SELECT s_suppkey, s_name FROM supplier").select("s_suppkey", text.address_text(a).alias("address"))


@query("SELECT k, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN 'ors-poi:way:' || k ELSE 'ors-poi:osm:' || k END AS id FROM v_poi")
def h5_stable_id(s, d):
    k = F.col("k")
    kind = F.when(k % 3 == 0, " way ").when(k % 3 == 1, " ")
    return view(s, d, "v_poi").select("k", text.stable_id(kind, F.when(k % 5 != 0, k)).alias("id"))


@query("SELECT plan_id, piece, pos, CAST(ROW_NUMBER() OVER (PARTITION BY plan_id ORDER BY lat, lon, pos, piece) AS BIGINT) AS number FROM v_piece_result")
def e7_number_rows(s, d):
    return selection.number_rows(view(s, d, "v_piece_result"), "plan_id", "lat", "lon", "pos", "piece").select("plan_id", "piece", "pos", F.col("number").cast("bigint").alias("number"))


@query(f"SELECT analysis_id, poi_id, CAST(ROW_NUMBER() OVER (PARTITION BY analysis_id ORDER BY ring_id, top_id, basic_id, primary_id, poi_id) AS BIGINT) AS position FROM ({base._MATCH}) m")
def f1_match_order(s, d):
    m = base.matches(s, d).withColumn("hierarchy", F.array("top_id", "basic_id", "primary_id"))
    return selection.match_order(m).select("analysis_id", "poi_id", F.col("position").cast("bigint").alias("position"))


@query(r"""WITH o AS (SELECT event_id, status_code, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'many' ELSE CAST(event_id % 500 AS VARCHAR) END AS lim, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(remaining AS VARCHAR) END AS rem FROM v_quota_obs), r AS (SELECT *, TRY_CAST(lim AS BIGINT) AS lim_n, CASE WHEN CAST(rem AS BIGINT) >= 0 THEN CAST(rem AS BIGINT) END AS rem_n FROM o)
SELECT event_id, CASE WHEN status_code = 429 THEN 'rate-limited' WHEN status_code = 403 THEN 'upstream-403' WHEN lim_n IS NOT NULL OR rem_n IS NOT NULL THEN 'known' ELSE 'unknown' END AS status, lim_n AS quota, rem_n AS remaining, CASE WHEN lim_n IS NOT NULL OR rem_n IS NOT NULL THEN 'live' ELSE 'unknown' END AS freshness, CASE WHEN status_code = 429 THEN event_id % 60 END AS retry_after_s FROM r""")
def h16_observe_quota(s, d):
    k = F.col("event_id")
    q = view(s, d, "v_quota_obs").withColumns({"observed_at": F.col("observed_at").cast("timestamp"), "limit_header": F.when(k % 4 == 0, None).when(k % 4 == 1, "many").otherwise((k % 500).cast("string")), "remaining_header": F.when(k % 3 != 0, F.concat(F.lit(" "), F.col("remaining").cast("string"))), "reset_header": F.lit(None).cast("string"), "retry_header": (k % 60).cast("string")}).drop("remaining")
    return ledger.observe_quota(q).select("event_id", "status", F.col("limit").alias("quota"), "remaining", "freshness", "retry_after_s")


# ---- merges ----


def _outer(s: SparkSession, d: str) -> DataFrame:
    """The 30-minute polygon of the analysis of a plan's number, as its outer polygon."""
    return base.isochrones(s, d).where("range_minutes = 30").select(F.col("analysis_id").alias("plan_id"), "edges", "box")


def _pieces(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows near their plan's centre, some without coordinates; plans of every seventh number have a piece that is not complete."""
    r = run_sql(s, d, """SELECT p.plan_id, p.piece, p.pos, p.source, p.source_id, p.name, CASE WHEN p.pos % 23 = 0 THEN NULL ELSE a.lon + (p.lon - 114.25) / CASE WHEN p.pos % 2 = 0 THEN 2 ELSE 4096 END END AS lon, a.lat + (p.lat - 30.75) / CASE WHEN p.pos % 2 = 0 THEN 2 ELSE 4096 END AS lat
 FROM v_piece_result p JOIN v_analysis a ON a.analysis_id = p.plan_id""")
    pieces = r.select("plan_id", "piece").distinct().withColumns({"complete": ~((F.col("plan_id") % 7 == 3) & (F.col("piece") == 1)), "truncated": F.lit(False)})
    return r, pieces


@query("""WITH r AS (SELECT p.plan_id, p.piece, p.pos, p.source, p.source_id, CASE WHEN p.pos % 23 = 0 THEN NULL ELSE a.lon + (p.lon - 114.25) / CASE WHEN p.pos % 2 = 0 THEN 2 ELSE 4096 END END AS lon, a.lat + (p.lat - 30.75) / CASE WHEN p.pos % 2 = 0 THEN 2 ELSE 4096 END AS lat FROM v_piece_result p JOIN v_analysis a ON a.analysis_id = p.plan_id WHERE plan_id % 7 <> 3),
 c AS (SELECT r.plan_id, r.piece, r.pos, r.source_id, r.lon, SUM(CASE WHEN (e.y1 > r.lat) <> (e.y2 > r.lat) AND r.lon < (e.x2-e.x1)*(r.lat-e.y1)/(e.y2-e.y1)+e.x1 THEN 1 ELSE 0 END) % 2 = 1 OR MAX(CASE WHEN (e.x2-e.x1)*(r.lat-e.y1) = (e.y2-e.y1)*(r.lon-e.x1) AND r.lon BETWEEN LEAST(e.x1,e.x2) AND GREATEST(e.x1,e.x2) AND r.lat BETWEEN LEAST(e.y1,e.y2) AND GREATEST(e.y1,e.y2) THEN 1 ELSE 0 END) = 1 AS inside FROM r JOIN v_edge e ON e.analysis_id = r.plan_id AND e.range_minutes = 30 GROUP BY 1, 2, 3, 4, 5)
SELECT plan_id, COUNT(*) AS raw, COUNT(*) FILTER (NOT COALESCE(inside, FALSE)) AS outside, COUNT(DISTINCT source_id) FILTER (inside) AS merged_with_id FROM c GROUP BY 1""")
def g1_merge_piece_results(s, d):
    """Counts of the whole chain; a test holds the rows against plain Python."""
    r, pieces = _pieces(s, d)
    rows, counts = selection.merge_piece_results(r, pieces, _outer(s, d))
    n = rows.groupBy("plan_id").agg(F.count("source_id").alias("merged_with_id"))
    return counts.join(n.hint("merge"), "plan_id", "left").select("plan_id", "raw", "outside", F.coalesce("merged_with_id", F.lit(0)).alias("merged_with_id"))


@query(f"""WITH b AS (SELECT analysis_id, poi_id, status, band, FLOOR((ROW_NUMBER() OVER (PARTITION BY analysis_id ORDER BY poi_id) - 1) / 20) AS batch FROM {base._ACC} a)
SELECT analysis_id AS plan_id, CASE analysis_id % 5 WHEN 1 THEN 'partial_matrix_batches' WHEN 2 THEN 'batch_result_order_mismatch' WHEN 3 THEN 'cross_profile_accessibility' END AS reason, analysis_id % 5 IN (0, 4) AS publishable, CASE WHEN analysis_id % 5 IN (0, 4) THEN COUNT(*) END AS destinations, CASE WHEN analysis_id % 5 IN (0, 4) THEN COUNT(*) FILTER (status = 'ok') END AS ok,
 CASE WHEN analysis_id % 5 IN (0, 4) THEN COUNT(*) FILTER (status = 'unreachable') END AS unreachable, CASE WHEN analysis_id % 5 IN (0, 4) THEN COUNT(*) FILTER (status = 'invalid') END AS invalid, CASE WHEN analysis_id % 5 IN (0, 4) THEN COUNT(*) FILTER (band = 'matrix-out-of-range') END AS out_of_range FROM b GROUP BY 1""")
def g2_merge_batches(s, d):
    """Plans with a batch that is missing, out of order or of another profile are not published."""
    acc = publish.with_status(view(s, d, "v_accessibility"))
    k = F.col("analysis_id") % 5
    b = selection.matrix_batches(acc, 20).withColumns({"batch_id": F.concat_ws("-", "analysis_id", "batch"), "profile": F.lit("foot"), "status": F.when((k == 1) & (F.col("batch") == 0), "failed").when(F.col("batch") % 2 == 0, "completed").otherwise("cache-hit")})
    back = b.withColumns({"poi_ids": F.when((k == 2) & (F.col("batch") == 0), F.reverse("poi_ids")).otherwise(F.col("poi_ids")), "profile": F.when((k == 3) & (F.col("batch") == 0), "car").otherwise("foot")})
    rows = acc.join(b.select("analysis_id", "batch_id", F.explode("poi_ids").alias("poi_id")).hint("merge"), ["analysis_id", "poi_id"]).select("batch_id", "poi_id", "status", "band")
    return selection.merge_batches(b.withColumnRenamed("analysis_id", "plan_id"), back, rows)[1]


# ---- gates, profiles, layouts ----

_METRICS = """(SELECT layout_id AS density, CASE node_id % 3 WHEN 0 THEN 'balanced' WHEN 1 THEN 'compact-first' ELSE 'geography-first' END AS algorithm, COUNT(*) FILTER (width > 78) AS overlap, COUNT(*) FILTER (ABS(x) > 745) AS outside, COUNT(*) FILTER (ABS(x) < 1) AS on_centre, COUNT(*) FILTER (ABS(y) < 1) AS on_label,
 MAX(node_id) % 2 = 0 AS mutated, MIN(node_id) % 4 <> 0 AS stable, CAST(MIN(ABS(x)) AS DOUBLE) AS err_mean, CAST(COUNT(*) FILTER (x < 0) AS DOUBLE) / COUNT(*) AS ew_rate, CAST(COUNT(*) FILTER (y < 0) AS DOUBLE) / COUNT(*) AS ns_rate, MAX(x) AS canvas_width, CAST(SUM(width) AS DOUBLE) AS utilization FROM v_layout_node GROUP BY 1, 2)"""


@query(f"""WITH m AS (SELECT * FROM {_METRICS} q), j AS (SELECT density, b.*, c.err_mean AS c_err, c.ew_rate + c.ns_rate AS c_flips, c.density IS NOT NULL AS has_c, g.canvas_width AS g_width, g.utilization AS g_util FROM (SELECT DISTINCT density FROM m) d LEFT JOIN (SELECT density AS bd, overlap, outside, on_centre, on_label, mutated, stable, err_mean, ew_rate + ns_rate AS flips, canvas_width, utilization FROM m WHERE algorithm = 'balanced') b ON b.bd = d.density
 LEFT JOIN (SELECT * FROM m WHERE algorithm = 'compact-first') c USING (density) LEFT JOIN (SELECT * FROM m WHERE algorithm = 'geography-first') g USING (density)),
 k AS (SELECT density, COALESCE(overlap = 0, FALSE) AS overlap0, COALESCE(outside = 0, FALSE) AS outside0, COALESCE(on_centre = 0, FALSE) AS on_centre0, COALESCE(on_label = 0, FALSE) AS on_label0, COALESCE(NOT mutated, FALSE) AS unchanged, COALESCE(stable, FALSE) AS stable, COALESCE(err_mean <= c_err * 0.85e0 OR COALESCE(flips, 0) <= COALESCE(c_flips, 0) * 0.85e0, FALSE) AS direction, COALESCE(canvas_width < g_width, FALSE) AS smaller, COALESCE(utilization >= g_util, FALSE) AS utilized FROM j)
SELECT *, overlap0 AND outside0 AND on_centre0 AND on_label0 AND unchanged AND stable AND direction AND smaller AND utilized AS passed FROM k""")
def d25_balanced_gate(s, d):
    """Metrics of three stand-in algorithms, each the layout's nodes of one remainder by three."""
    x, n = F.col("node_id"), F.count("*")
    m = view(s, d, "v_layout_node").withColumn("algorithm", F.when(x % 3 == 0, "balanced").when(x % 3 == 1, "compact-first").otherwise("geography-first"))
    m = m.groupBy(F.col("layout_id").alias("density"), "algorithm").agg(
        F.count_if(F.col("width") > 78).alias("overlap"), F.count_if(F.abs("x") > 745).alias("outside"), F.count_if(F.abs("x") < 1).alias("on_centre"), F.count_if(F.abs("y") < 1).alias("on_label"), (F.max("node_id") % 2 == 0).alias("mutated"), (F.min("node_id") % 4 != 0).alias("stable"),
        F.min(F.abs("x")).cast("double").alias("err_mean"), (F.count_if(F.col("x") < 0) / n).alias("ew_rate"), (F.count_if(F.col("y") < 0) / n).alias("ns_rate"), F.max("x").alias("canvas_width"), F.sum("width").cast("double").alias("utilization"),
    )
    return layout.balanced_gate(m)


_REACH = "(SELECT layout_id AS analysis_id, CAST(node_id * 37 % 360 AS INT) AS bin, CAST(MAX(node_id % 1000) AS DOUBLE) AS r FROM v_layout_node GROUP BY 1, 2)"


@query(f"""WITH p AS (SELECT k.analysis_id, b.bin, COALESCE(r, 0) AS r FROM (SELECT DISTINCT layout_id AS analysis_id FROM v_layout_node) k CROSS JOIN (SELECT CAST(i AS INT) AS bin FROM range(0, 360) t(i)) b LEFT JOIN {_REACH} q ON q.analysis_id = k.analysis_id AND q.bin = b.bin),
 v AS (SELECT p.*, n.r AS r2 FROM p JOIN p n ON n.analysis_id = p.analysis_id AND n.bin = (p.bin + 1) % 360), s AS (SELECT analysis_id, SUM(r * r2) * SIN(RADIANS(1)) / 2 AS area, SUM(SQRT(GREATEST(0, POWER(r2 * COS(RADIANS(1)) - r, 2) + POWER(r2 * SIN(RADIANS(1)), 2)))) AS perimeter FROM v GROUP BY 1)
SELECT analysis_id, ROUND(area, 3) AS area, ROUND(perimeter, 3) AS perimeter, ROUND(4 * PI() * area / (perimeter * perimeter), 6) AS compactness FROM s""")
def d28_profile_shape(s, d):
    p = view(s, d, "v_layout_node").groupBy(F.col("layout_id").alias("analysis_id"), (F.col("node_id") * 37 % 360).cast("int").alias("bin")).agg(F.max(F.col("node_id") % 1000).cast("double").alias("reach_m"))
    return layout.profile_shape(p).select("analysis_id", F.round("area", 3).alias("area"), F.round("perimeter", 3).alias("perimeter"), F.round("compactness", 6).alias("compactness"))


@query("""WITH g AS (SELECT a.layout_id AS analysis_id, i AS bin, 70 + 35 * j AS radius, COS(RADIANS(i * 15)) * (70 + 35 * j) AS x, SIN(RADIANS(i * 15)) * (70 + 35 * j) AS y FROM (SELECT DISTINCT layout_id FROM v_layout_node) a CROSS JOIN range(0, 24) u(i) CROSS JOIN range(0, 20) w(j)),
 f AS (SELECT g.analysis_id, bin, radius, SUM(CASE WHEN POWER(g.x - n.x, 2) + POWER(g.y - n.y, 2) <= 57600 THEN EXP(-(POWER(g.x - n.x, 2) + POWER(g.y - n.y, 2)) / 7200) ELSE 0 END) AS density FROM g JOIN v_layout_node n ON n.layout_id = g.analysis_id GROUP BY 1, 2, 3)
SELECT analysis_id, bin, CAST(GREATEST(70, COALESCE(MAX(radius) FILTER (density >= 1.05), 70)) AS DOUBLE) AS contour FROM f GROUP BY 1, 2""")
def d29_contour_radius(s, d):
    v = view(s, d, "v_layout_node")
    g = v.select(F.col("layout_id").alias("analysis_id")).distinct().withColumn("gid", F.explode(F.sequence(F.lit(0), F.lit(479)))).withColumns({"bin": F.floor(F.col("gid") / 20), "radius": (70 + 35 * (F.col("gid") % 20)).cast("double")})
    grid = g.withColumns({"x": F.cos(F.radians(F.col("bin") * 15)) * F.col("radius"), "y": F.sin(F.radians(F.col("bin") * 15)) * F.col("radius")})
    dense = layout.kernel_density(v.select(F.col("layout_id").alias("analysis_id"), "x", "y", F.lit(1.0).alias("w")), grid.select("analysis_id", "gid", "x", "y"), 60.0)
    all_ = g.join(dense.hint("merge"), ["analysis_id", "gid"], "left").na.fill(0.0, ["density"])
    return layout.contour_radius(all_).select("analysis_id", "bin", "contour")


@query("""SELECT layout_id, node_id, obstacle_id FROM v_layout_node n CROSS JOIN (SELECT * FROM (VALUES ('centre', 0, 0, 60, 60), ('10', 0, -200, 90, 30), ('20', 0, -400, 90, 30), ('30', 0, -700, 90, 30)) t(obstacle_id, ox, oy, ow, oh)) o WHERE ABS(x - ox) < (width + ow) / CAST(2 AS DOUBLE) AND ABS(y - oy) < (height + oh) / CAST(2 AS DOUBLE)""")
def d31_obstacle_collisions(s, d):
    """Labels on the centre's box or on a ring's time label."""
    o = s.createDataFrame([("centre", 0, 0, 60, 60), ("10", 0, -200, 90, 30), ("20", 0, -400, 90, 30), ("30", 0, -700, 90, 30)], "obstacle_id string, x int, y int, width int, height int")
    return layout.obstacle_collisions(view(s, d, "v_layout_node"), o)


@query("SELECT analysis_id, COUNT(*) AS n, ROUND(MIN(area), 6) AS area_min, ROUND(MAX(area), 6) AS area_max, ROUND(MEDIAN(area), 6) AS median, ROUND(quantile_cont(area, 0.1), 6) AS p10, ROUND(quantile_cont(area, 0.9), 6) AS p90, COUNT(*) FILTER (area < 0.1) AS below_0_1, COUNT(*) FILTER (area < 1) AS below_1, COUNT(*) FILTER (area < 5) AS below_5, COUNT(*) FILTER (area > 40) AS above_40 FROM (SELECT CAST(k % 25 AS INT) AS analysis_id, 50 * POWER((k * 7919 % 1000) / CAST(1000 AS DOUBLE), 3) AS area FROM v_poi) t GROUP BY 1")
def d23_piece_area_stats(s, d):
    """Statistics of areas that a cube spreads over all thresholds."""
    from ..operators import tiles

    p = view(s, d, "v_poi").select((F.col("k") % 25).cast("int").alias("analysis_id"), (50 * F.pow((F.col("k") * 7919 % 1000) / 1000.0, 3)).alias("area"))
    return tiles.area_stats(p, "analysis_id").withColumns({c: F.round(c, 6) for c in ("area_min", "area_max", "median", "p10", "p90")})


@query("SELECT verdict, COUNT(*) AS n FROM (SELECT CASE WHEN a.event_id IS NULL THEN 'no-approval' WHEN a.approved > 30 THEN 'budget-exceeded' WHEN p.service = 'matrix' THEN CASE WHEN p.job_id % 2 = 0 THEN 'quota-unknown' ELSE 'allowed' END WHEN a.approved > FLOOR(20 * 0.8e0) THEN 'quota-exceeded' ELSE 'allowed' END AS verdict FROM v_service_event p LEFT JOIN (SELECT event_id, CAST(job_id % 40 AS BIGINT) AS approved FROM v_service_event WHERE event_id % 3 = 0 AND event_id % 4 <> 0 AND event_id % 5 <> 0) a ON a.event_id = p.event_id) t GROUP BY 1")
def c17_gate_centres(s, d):
    """Approvals of another centre or other ranges do not fit; the matrix service's quota is unknown, and half of the plans run two profiles."""
    k = F.col("event_id")
    ev = view(s, d, "v_service_event")
    plan = ev.select(k.alias("fingerprint"), F.lit("foot").alias("profile"), F.lit("c").alias("center"), F.array(F.lit(600), F.lit(1200)).alias("ranges"), "service", F.lit(30).cast("bigint").alias("budget"), (2 - F.col("job_id") % 2).alias("profile_count"))
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    ap = ev.where(k % 3 == 0).select(k.alias("fingerprint"), F.lit("foot").alias("profile"), F.when(k % 4 == 0, "d").otherwise("c").alias("center"), F.when(k % 5 == 0, F.array(F.lit(600))).otherwise(F.array(F.lit(600), F.lit(1200))).alias("ranges"), (F.col("job_id") % 40).cast("bigint").alias("approved"), now.alias("created_at"), (now + F.expr("interval 1 hour")).alias("expires_at"))
    q = ev.select("service").distinct().where("service <> 'matrix'").select("service", F.lit(20).alias("remaining"), F.lit(200).alias("status_code"))
    return ledger.gate_plans(plan, ap, q, now).groupBy("verdict").agg(F.count("*").alias("n"))


# ---- batch twins of the streams ----


@query("SELECT service, observed_at, event_id, remaining, status_code FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY service ORDER BY observed_at DESC, event_id DESC) AS i FROM v_quota_obs) t WHERE i = 1")
def i1_latest_quota(s, d):
    return jobs.latest_quota(view(s, d, "v_quota_obs")).select("service", "observed_at", "event_id", "remaining", "status_code")


@query("""WITH e AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN 'other' ELSE 'same' END AS fp, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS i FROM v_service_event), f AS (SELECT e.*, e.fp = (SELECT g.fp FROM e g WHERE g.job_id = e.job_id AND g.i = 1) AS fits FROM e),
 l AS (SELECT *, MAX(CASE WHEN fits AND state_idx < 9 THEN state_idx END) OVER (PARTITION BY job_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM f),
 p AS (SELECT *, COALESCE(MAX(CASE WHEN fits AND state_idx = 9 AND low = 8 THEN 1 END) OVER (PARTITION BY job_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM l)
SELECT job_id, event_id, state_idx, CASE WHEN i = 1 THEN CASE WHEN state_idx = 9 THEN 'not-ready' ELSE 'created' END WHEN NOT fits THEN 'fingerprint-conflict' WHEN state_idx < CASE WHEN done = 1 THEN 9 ELSE COALESCE(low, -1) END THEN 'regression' WHEN state_idx = 9 AND done = 0 AND COALESCE(low, -1) <> 8 THEN 'not-ready' WHEN state_idx = CASE WHEN done = 1 THEN 9 ELSE COALESCE(low, -1) END THEN 'repeat' ELSE 'advanced' END AS verdict FROM p""")
def i2_job_verdicts(s, d):
    e = view(s, d, "v_service_event").withColumn("fingerprint", F.when(F.col("event_id") % 50 == 0, "other").otherwise("same"))
    return ledger.job_verdicts(e)


@query("SELECT plan_id, source, source_id, pos FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY plan_id, source, source_id ORDER BY piece, pos) AS i FROM v_piece_result WHERE source_id IS NOT NULL) t WHERE i = 1")
def i3_first_piece_results(s, d):
    r = view(s, d, "v_piece_result").where("source_id is not null")
    return selection.dedupe_first(r, ["plan_id", "source", "source_id"], "piece", "pos").select("plan_id", "source", "source_id", "pos")


@query("""WITH r AS (SELECT endpoint_type, job_id, MAX(retrieved_at) AS got_at, MAX(ttl_seconds) AS ttl FROM v_response_record WHERE job_id % 10 <> 0 GROUP BY 1, 2), q AS (SELECT event_id, service AS endpoint_type, job_id, ts + INTERVAL 5 DAY AS asked_at, event_id % 2 = 0 AS failed FROM v_service_event)
SELECT event_id, CASE WHEN got_at IS NULL THEN 'missing' WHEN ttl > 0 AND FLOOR(epoch(asked_at)) - FLOOR(epoch(got_at)) > ttl THEN CASE WHEN failed THEN 'stale-if-error' ELSE 'expired' END ELSE 'fresh' END AS state FROM q LEFT JOIN r ON r.endpoint_type = q.endpoint_type AND r.job_id = q.job_id""")
def i4_response_freshness(s, d):
    """Requests five days after their event; half of the upstream calls failed, and every tenth job has no record."""
    asked = view(s, d, "v_service_event").select("event_id", F.col("service").alias("endpoint_type"), "job_id", (F.col("ts").cast("timestamp") + F.expr("interval 5 days")).alias("asked_at"), (F.col("event_id") % 2 == 0).alias("failed"))
    records = view(s, d, "v_response_record").where("job_id % 10 <> 0").withColumn("retrieved_at", F.col("retrieved_at").cast("timestamp"))
    return jobs.response_freshness(asked, records).select("event_id", "state")


@query("SELECT analysis_id, poi_id, radius FROM (SELECT c.analysis_id, p.poi_id, 2*6371008.8*ASIN(LEAST(1, SQRT(POWER(SIN(RADIANS(p.lat-c.clat)/2),2)+COS(RADIANS(c.clat))*COS(RADIANS(p.lat))*POWER(SIN(RADIANS(p.lon-c.clon)/2),2)))) AS m, CASE WHEN m <= 500 THEN 500 WHEN m <= 1000 THEN 1000 WHEN m <= 2000 THEN 2000 END AS radius FROM (SELECT analysis_id, CASE WHEN analysis_id % 2 = 0 THEN 179.995 ELSE -179.995 END AS clon, lat AS clat FROM v_analysis) c CROSS JOIN (SELECT poi_id, lat, CASE WHEN x > 180 THEN x - 360 ELSE x END AS lon FROM (SELECT poi_id, lat, 179.5 + (lon - 113.75) AS x FROM v_poi) q) p) t WHERE radius IS NOT NULL")
def c11_radius_over_the_meridian(s, d):
    """Centres on either side of the 180th meridian, points on both."""
    c = view(s, d, "v_analysis").select("analysis_id", F.when(F.col("analysis_id") % 2 == 0, 179.995).otherwise(-179.995).alias("clon"), F.col("lat").alias("clat"))
    x = 179.5 + (F.col("lon") - 113.75)
    p = view(s, d, "v_poi").select("poi_id", F.when(x > 180, x - 360).otherwise(x).alias("lon"), "lat")
    return spatial.within_radius(p, c).select("analysis_id", "poi_id", F.col("radius_m").alias("radius"))


@query(f"WITH c AS (SELECT * FROM ({base._LEVELS}) a WHERE l BETWEEN 2 AND 4) SELECT c.plan_id, CAST(c.l AS BIGINT) AS level, COUNT(*) AS leaves, CAST(SUM(c.n) AS BIGINT) AS n, COUNT(*) FILTER (c.n >= 12) AS incomplete FROM c LEFT JOIN c u ON u.plan_id = c.plan_id AND u.l = c.l - 1 AND u.x = FLOOR(c.x / CAST(2 AS DOUBLE)) AND u.y = FLOOR(c.y / CAST(2 AS DOUBLE)) WHERE (c.n < 12 OR c.l = 4) AND (u.n IS NULL OR u.n >= 12) GROUP BY 1, 2")
def k5_tiles_by_area(s, d):
    """No tile above a 16th of a square degree, none below a 256th."""
    from ..operators import tiles

    p = view(s, d, "v_poi").withColumn("plan_id", (F.col("k") % 25).cast("int"))
    return tiles.adaptive_tiles(p, 12, 9, area_cap=1 / 16, min_area=1 / 256).groupBy("plan_id", F.col("level").cast("bigint").alias("level")).agg(F.count("*").alias("leaves"), F.sum("n").alias("n"), F.count_if("incomplete").alias("incomplete"))
