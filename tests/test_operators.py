"""Hand-made fixtures with known results."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from reachlake.functions import geo, text
from reachlake.operators import categories, layout, ledger, publish, requests, selection, spatial, tiles
from reachlake.sources import datasets, features
from reachlake.streaming import jobs

SQUARE = [[[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 1.0}]]]
POLYGON = "array<array<array<struct<x:double,y:double>>>>"


def squares(spark, *sides):
    poly = lambda k: [[[(0.0, 0.0), (k, 0.0), (k, k), (0.0, k), (0.0, 0.0)]]]
    d = spark.createDataFrame([(1, m, poly(float(k))) for m, k in sides], f"analysis_id int, range_minutes int, polygon {POLYGON}")
    return spatial.with_edges(d).drop("polygon")


def test_boundary_is_inside_and_the_smallest_ring_wins(spark):
    p = spark.createDataFrame([("corner", 1.0, 1.0), ("edge", 0.5, 0.0), ("in", 0.5, 0.5), ("out", 3.5, 1.0), ("big", 2.5, 1.0), ("bigedge", 3.0, 3.0)], "poi_id string, lon double, lat double")
    got = {r.poi_id: r.outer_minutes for r in spatial.assign_rings(p, squares(spark, (10, 1), (20, 3))).collect()}
    assert got == {"corner": 10, "edge": 10, "in": 10, "big": 20, "bigedge": 20}


def test_ring_assignment_with_holes_and_parts(spark):
    hole = [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]], [[(9.0, 9.0), (10.0, 9.0), (10.0, 10.0)]]]
    d = spatial.with_edges(spark.createDataFrame([(1, 10, hole)], f"analysis_id int, range_minutes int, polygon {POLYGON}")).drop("polygon")
    p = spark.createDataFrame([("hole", 2.0, 2.0), ("body", 0.5, 2.0), ("rim", 1.0, 2.0), ("part", 9.9, 9.5)], "poi_id string, lon double, lat double")
    assert {r.poi_id for r in spatial.assign_rings(p, d, cell=0.5).collect()} == {"body", "rim", "part"}
    area = spark.createDataFrame([(hole,)], f"polygon {POLYGON}").select(geo.polygon_area(F.col("polygon"))).first()[0]
    assert abs(area - 12.5) < 1e-12


def test_empty_rings_count_zero(spark):
    rings = spark.createDataFrame([(1, 10), (1, 20)], "analysis_id int, outer_minutes int")
    got = spatial.ring_counts(rings, spark.createDataFrame([(1, "a", 20)], "analysis_id int, poi_id string, outer_minutes int")).collect()
    assert sorted((r.outer_minutes, r.poi_count) for r in got) == [(10, 0), (20, 1)]


def test_status_and_band_boundaries(spark):
    rows = [(600.0, 1.0), (600.001, 1.0), (1200.0, 1.0), (1800.0, 1.0), (1800.5, 1.0), (None, 1.0), (1.0, None), (-1.0, 1.0), (0.0, 0.0), (float("nan"), 1.0), (float("inf"), 2.0)]
    d = publish.with_status(spark.createDataFrame(rows, "duration_s double, distance_m double"))
    assert [(r.status, r.band) for r in d.collect()] == [("ok", "ring-0-10"), ("ok", "ring-10-20"), ("ok", "ring-10-20"), ("ok", "ring-20-30"), ("ok", publish.OUT_OF_RANGE), *[("unreachable", None)] * 2, *[("invalid", None)] * 4]
    z = spark.createDataFrame([(0.0, 0.0)], "t double, m double").select(publish.matrix_status(F.col("t"), F.col("m"), F.lit(True))).first()[0]
    assert z == "ok"


def test_matrix_with_wrong_sizes_is_rejected(spark):
    rows = [(1, ["a", "b"], [[1.0, None]], [[2.0, 3.0]]), (2, ["a"], [[1.0, 2.0]], [[1.0]]), (3, ["a"], [[1.0], [2.0]], [[1.0]]), (4, ["a"], None, [[1.0]])]
    ok, bad = publish.explode_matrix(spark.createDataFrame(rows, "batch int, poi_ids array<string>, durations array<array<double>>, distances array<array<double>>"))
    assert [(r.batch, r.position, r.poi_id, r.duration_s) for r in ok.collect()] == [(1, 0, "a", 1.0), (1, 1, "b", None)]
    assert sorted(r.batch for r in bad.collect()) == [2, 3, 4]


def test_quota_tie_order_and_null_scores(spark):
    rows = [(1, "r", "a", 300.0, None, 5.0), (1, "r", "b", 200.0, 4.0, None), (1, "r", "c", 100.0, None, None), (1, "r", "d", 200.0, 5.0, None)]
    d = spark.createDataFrame(rows, "analysis_id int, ring_id string, poi_id string, travel_time_s double, rating double, importance double")
    got = selection.select_by_quota(d, {"r": 3}).orderBy("rank").collect()
    assert [r.poi_id for r in got] == ["d", "a", "b", "c"] and [r.is_selected for r in got] == [True, True, True, False]


def test_round_robin_cursor(spark):
    rows = [(1, "r", "A", "a1"), (1, "r", "B", "b1"), (1, "r", "B", "b2"), (1, "r", "C", "c1"), (1, "r", "C", "c2")]
    d = spark.createDataFrame(rows, "analysis_id int, ring_id string, top_id string, poi_id string")
    assert [r.poi_id for r in selection.round_robin_limit(d, 3, exact=True).orderBy("position").collect()] == ["a1", "c1", "b1"]
    assert [r.poi_id for r in selection.round_robin_limit(d, 4).orderBy("position").collect()] == ["a1", "b1", "c1", "b2"]


def test_near_duplicates_are_not_transitive(spark):
    step = 4 / 96000
    rows = [(1, "Cafe  X", 0.0, 0.0), (2, "cafe x", step, 0.0), (3, " CAFE X", 2 * step, 0.0), (4, "other", 0.0, 0.0), (5, "cafe x", 50 * step, 0.0)]
    d = spark.createDataFrame(rows, "pos int, name string, lon double, lat double")
    assert sorted(r.pos for r in spatial.dedupe_near(d).collect()) == [1, 3, 4, 5]


def test_near_duplicates_settle_whole_chains_or_fail(spark):
    d = spark.createDataFrame([(i, "cafe", i * 4 / 96000, 0.0) for i in range(7)], "pos int, name string, lon double, lat double")
    assert sorted(r.pos for r in spatial.dedupe_near(d).collect()) == [0, 2, 4, 6]
    with pytest.raises(ValueError):
        spatial.dedupe_near(d, rounds=1)


def test_provider_names_take_one_python_step(spark):
    """All candidates of a row go to Python at once; wide letters are normalised in tags and in nested maps."""
    rows = [({"name": "\uff21\uff22"},), ({"name:zh": "https://x.org", "name": '{"zh": "12345678", "en": "\uff23 d"}'},), ({"name": "{bad", "name:en": "E"},), ({"shop": "x"},), (None,), ({"name": None, "name:en": "\u2460 Caf\u00e9"},)]
    d = spark.createDataFrame(rows, "p map<string,string>").coalesce(1).select(text.provider_name(F.col("p")).alias("n"))
    assert d._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r.n and tuple(r.n) for r in d.collect()] == [("AB", None), ("C d", "en"), ("{bad", None), None, None, ("1 Caf\u00e9", "en")]


def test_candidate_guard_sorts_no_rows(spark):
    """Few analyses hold all rows, which are neither sorted nor hashed for their status."""
    d = spark.range(3000).select(F.when(F.col("id") % 10 == 0, 1).otherwise(2).alias("analysis_id"), F.col("id").alias("poi_id"))
    got = spatial.candidate_guard(d, 300)
    assert {tuple(r) for r in got.groupBy("analysis_id", "status").count().collect()} == {(1, "ok", 300), (2, "candidate-limit", 2700)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan.replace("SortAggregate", "") and "BuildRight" in plan


def test_merge_pieces(spark):
    rows = [(1, 0, 1, "n1", "osm"), (1, 1, 2, "n1", "osm"), (1, 1, 3, None, "osm"), (1, 1, 4, None, "osm"), (2, 0, 1, "n1", "osm")]
    r = spark.createDataFrame(rows, "plan_id int, piece int, pos int, source_id string, source string")
    pieces = spark.createDataFrame([(1, 0, True, False), (1, 1, True, False), (2, 0, True, True)], "plan_id int, piece int, complete boolean, truncated boolean")
    got, counts = selection.merge_pieces(r, pieces)
    assert sorted(x.pos for x in got.collect()) == [1, 3, 4] and tuple(counts.first()) == (1, 4, 3, 1)


def feature(i, **over):
    f = {"type": "Feature", "id": f"f{i}", "geometry": {"type": "Point", "coordinates": [1.0, 1.0]}, "properties": {"names": {"primary": f"N{i}", "common": {"zh_CN": f"名{i}", "de": "D"}}, "taxonomy": {"hierarchy": ["food", "cafe"], "primary": "cafe", "alternates": []}, "operating_status": "open", "confidence": 0.9, "addresses": [{"locality": "Town"}]}}
    f["properties"] |= over.pop("properties", {})
    return f | over


def test_import_end_to_end(spark, tmp_path):
    rows = [feature(1), feature(2), feature(3), feature(4, properties={"operating_status": "permanently_closed"}), feature(5, properties={"taxonomy": {"hierarchy": ["food", "food"], "primary": "food"}}), feature(6, geometry={"type": "Point", "coordinates": [9, 9]}), feature(1)]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": rows}, ensure_ascii=False))
    (tmp_path / "b.geojsonl").write_text("\n" + "\n".join(map(json.dumps, rows)) + "\n\n[1]\n")
    (tmp_path / "c.geojson").write_text(json.dumps(rows[:2]))
    (tmp_path / "d.geojson").write_text(json.dumps(rows[0]))
    lower = feature(1)
    del lower["id"]
    lower["properties"]["gers_id"] = "low"
    (tmp_path / "e.geojson").write_text(json.dumps([lower, {k: v for k, v in feature(2, properties={"GERS_ID": "up"}).items() if k != "id"}]))
    for name in ("a.geojson", "b.geojsonl"):
        flat = features.flatten_features(features.read_features(spark, str(tmp_path / name)), ["zh-CN"])
        c = features.classify_features(flat, (0, 0, 3, 3), ["_pos", "i"]).cache()
        assert sorted(str(r.reject_reason) for r in c.collect()) == sorted(["None"] * 3 + ["closed", "invalid-taxonomy", "outside-bbox", "duplicate-id"])
        first = c.where("source_id = 'f1'").orderBy("i", "_pos").first()
        assert (first.name, first.address, first.poi_id) == ("名1", "Town", "overture:f1")
        rep = features.import_report(c).first()
        assert (rep.n_read, rep.accepted, rep.taxonomy_valid, rep.ready) == (7, 3, 4, False)
    assert features.read_features(spark, str(tmp_path / "c.geojson")).count() == 2
    assert features.read_features(spark, str(tmp_path / "d.geojson")).count() == 1
    assert {r.source_id for r in features.flatten_features(features.read_features(spark, str(tmp_path / "e.geojson"))).collect()} == {"low", "up"}
    (tmp_path / "bad.jsonl").write_text('{"type": oops}\n')
    with pytest.raises(Exception):
        features.read_features(spark, str(tmp_path / "bad.jsonl")).collect()


def test_geoparquet(spark, tmp_path):
    import struct

    wkb = [struct.pack("<BIdd", 1, 1, 1.5, 2.5), struct.pack(">BIdd", 0, 1, 3.0, 4.0), b"junk", None, struct.pack("<BIIdd", 1, 0x20000001, 4326, 5.0, 6.0)]
    path = str(tmp_path / "x.parquet")
    spark.createDataFrame([(i, b) for i, b in enumerate(wkb)], "id int, geometry binary").coalesce(1).write.parquet(path)
    got = {r.id: r.geometry and r.geometry.coordinates for r in features.read_features(spark, path).collect()}
    assert got == {0: [1.5, 2.5], 1: [3.0, 4.0], 2: None, 3: None, 4: [5.0, 6.0]}


def test_publish_dataset_is_idempotent(spark, tmp_path):
    a, b = spark.range(5).withColumn("x", F.lit("a")), spark.range(6).withColumn("x", F.lit("a"))
    path = str(tmp_path / "ds")
    assert datasets.publish_dataset(a, path, "one", "r1") == "published"
    assert datasets.publish_dataset(a.repartition(3), path, "one", "r1") == "unchanged"
    with pytest.raises(ValueError):
        datasets.publish_dataset(b, path, "one", "r1")
    assert datasets.publish_dataset(b, path, "two", "r1") == "published"
    assert datasets.publish_dataset(b, path, "one", "r2", replace=True) == "published"
    got = spark.read.parquet(f"{path}/rows").groupBy("dataset_id").count().collect()
    assert {r.dataset_id: r["count"] for r in got} == {"one": 6, "two": 6}


def test_response_records_skip_unreadable(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "a.json").write_text('{"k": 1}')
    (tmp_path / "x" / "y" / "b.json").write_text('{"k": 2}')
    (tmp_path / "x" / "y" / "c.json").write_text('{"k": ')
    assert sorted(r.k for r in datasets.read_response_records(spark, str(tmp_path), "k int").collect()) == [1, 2]


def test_geojson_export(spark, tmp_path):
    p = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 2.0), ("c", 200.0, 0.0)], "poi_id string, lon double, lat double")
    datasets.write_geojson_features(p, ["poi_id"], str(tmp_path / "out"))
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert got == [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"poi_id": "a"}}]
    assert datasets.geojson_lines(p, ["poi_id"])[1].count() == 2


def test_names_and_units(spark):
    names = ["  A  b ", "http://x.org", "+1 (555) 123-4567", "node/123", "Ａｂ", "12 Main", ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in names], "n string").select(text.clean_name(F.col("n"))).collect()]
    assert got == ["A b", None, None, "node/123", "Ab", "12 Main", None]  # only bare and osm-marked numbers are no names
    d = spark.createDataFrame([(59.4, 999.0), (59.6, 1000.0), (125.0, 12345.0)], "s double, m double")
    assert [tuple(r) for r in d.select(text.duration_text(F.col("s")), text.distance_text(F.col("m"))).collect()] == [("59 秒", "999 m"), ("1 分 0 秒", "1.0 km"), ("2 分 5 秒", "12.3 km")]
    h = spark.createDataFrame([("foobar",), ("",)], "t string").select(text.fnv1a32(F.col("t"))).collect()
    assert [r[0] for r in h] == ["bf9cf968", "811c9dc5"]


def test_reset_headers(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    d = spark.createDataFrame([("1704070000",), ("30",), ("Mon, 01 Jan 2024 00:01:00 GMT",), ("soon",), ("-4",)], "h string")
    got = [r[0] and int(r[0]) for r in d.select(F.unix_timestamp(text.header_reset(F.col("h"), now))).collect()]
    assert got == [1704070000, 1704067230, 1704067260, None, None]


def test_cardinal_layout_keeps_everything(spark):
    nodes = [(1, 1, 0.1, 0.0, 10.0, 0.0), (1, 2, -0.1, 0.0, -10.0, 0.0), (1, 3, 0.0, 0.1, 0.0, -10.0), (1, 4, 0.0, -0.1, 0.0, 10.0)]
    d = spark.createDataFrame(nodes, "layout_id int, node_id int, lon double, lat double, x double, y double")
    a = layout.with_angles(d, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    m = layout.direction_metrics(a).first()
    assert (m.err_max, m.ew_flips, m.ns_flips, m.sector4_kept, m.sector8_kept) == (0.0, 0, 0, 4, 4)
    p = layout.pairwise_retention(a).first()
    assert p.lr_kept == p.lr_base and p.ud_kept == p.ud_base and p.lr_base + p.lr_source_excluded + p.lr_layout_excluded == 6


def test_pair_blocks_count_every_pair_once(spark):
    d = spark.range(1300).selectExpr("1 as layout_id", "id as node_id", "cast(id as double) as sx", "cast(id * 7 % 1301 as double) as sy", "cast(id as double) as tx", "cast(-id as double) as ty")
    r = layout.pairwise_retention(d).first()
    assert r.lr_base == r.lr_kept == 1300 * 1299 // 2 and r.ud_base == 1300 * 1299 // 2


def test_experiment_gate(spark):
    m = spark.createDataFrame([(60, "a", 1.0), (60, "b", 0.5), (120, "a", 2.0)], "density int, algorithm string, v double")
    got = {r.density: (r.best, r.complete) for r in layout.experiment_gate(m, ["a", "b"], "v").collect()}
    assert got == {60: ("b", True), 120: ("a", False)}


def test_geometry_hash_ignores_start_and_direction(spark):
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)]
    forms = [ring, ring[2:] + ring[:2], ring[::-1], [*ring, ring[0]]]
    d = spark.createDataFrame([([[r]],) for r in forms] + [([[[(0.0, 0.0), (2.0, 0.0), (2.0, 1.5), (0.0, 1.0)]]],)], f"p {POLYGON}")
    h = [r[0] for r in d.select(geo.geometry_hash(F.col("p"))).collect()]
    assert len(set(h[:4])) == 1 and h[4] != h[0]


def test_area_and_bearing(spark):
    d = spark.createDataFrame([([[[(114.0, 30.0), (114.1, 30.0), (114.1, 30.1), (114.0, 30.1)]]],)], f"p {POLYGON}")
    assert abs(d.select(geo.area_km2(F.col("p"))).first()[0] - 106.9) < 0.3
    b = spark.range(1).select(geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), geo.sector(F.lit(359.0), 4), geo.sector(F.lit(45.0), 4)).first()
    assert abs(b[0] - 90) < 1e-9 and abs(b[1] - 111195) < 10 and (b[2], b[3]) == (0, 1)


def test_clipped_tiles_conserve_area(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(12):
        angles = [(k + rnd.random() * 0.9) * 2 * math.pi / 9 for k in range(9)]
        rows.append((i, [[[(5 + (1 + 3 * rnd.random()) * math.cos(a), 5 + (1 + 3 * rnd.random()) * math.sin(a)) for a in angles]]]))
    d = spark.createDataFrame(rows, f"id int, polygon {POLYGON}")
    star = d.withColumn("n", geo.polygon_area(F.col("polygon")))
    got = tiles.coverage_audit(tiles.tile_polygons(d, 0.75), ["id"]).collect()
    assert len(got) == star.count() and all(r.covered and r.overlap == 0 for r in got)
    whole = tiles.tile_polygons(d, 0.75, whole_below=1e9).collect()
    assert {r.tile_id for r in whole} == {"whole"}


def test_validate_polygons_and_parts(spark):
    good = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    d = spark.createDataFrame([(1, [[good]]), (2, [[good[:3]]]), (3, []), (4, [[[(500.0, 0.0)]]]), (5, [[[(float("nan"), 0.0)]]]), (6, None)], f"id int, polygon {POLYGON}")
    assert {r.id: r.reason for r in requests.validate_polygons(d).collect()} == {1: None, 2: "open-ring", 3: "empty", 4: "out-of-range", 5: "not-finite", 6: "empty"}
    s = tiles.split_parts(spark.createDataFrame([(1, [[good], [good]])], f"id int, polygon {POLYGON}")).collect()
    assert [r.part for r in s] == [0, 1] and abs(sum(r.area for r in s) - s[0].whole_area) < 1e-12
    assert tiles.piece_report(d.where("id = 1")).first().n_vertices == 4


def test_provider_rules(spark):
    rows = [("Feature", "Point", "1", "2", "n1", "x"), ("X", "Point", "1", "2", "n", "x"), ("Feature", None, "1", "2", "n", "x"), ("Feature", "Point", None, "2", "n", "x"), ("Feature", "Point", "a", "2", "n", "x"), ("Feature", "Point", "181", "2", "n", "x"), ("Feature", "Point", "1", "2", None, "x"), ("Feature", "Point", "1", "2", "n", " ")]
    d = features.normalize_provider_features(spark.createDataFrame(rows, "type string, gtype string, lon string, lat string, ident string, name string"))
    assert [r.reason for r in d.collect()] == [None, "not-feature", "point-missing", "coordinates-missing", "coordinates-invalid", "coordinates-out-of-range", "stable-id-missing", "name-missing"]
    catalog = spark.createDataFrame([("c1", "g1"), ("c2", "g2")], "category_id string, group_id string")
    m = spark.createDataFrame([(1, ["zz", "c2", "c1"], ["g1"]), (2, ["zz"], ["q", "g1"]), (3, [], [])], "row_id int, category_ids array<string>, group_ids array<string>")
    assert {r.row_id: r.group_id for r in categories.map_provider_category(m, catalog).collect()} == {1: "g2", 2: "g1", 3: None}
    e = categories.expand_category_filter(spark.createDataFrame([(1, ["c1", "c2", "zz"]), (2, [])], "analysis_id int, requested array<string>"), catalog)
    assert {r.analysis_id: r.groups for r in e.collect()} == {1: ["g1", "g2"], 2: []}


def test_geocoder_rows(spark):
    d = spark.createDataFrame([("1", " ", "Name", 1.0, 2.0, ["a", " a", ""]), (None, None, None, 1.0, 2.0, [])], "id string, label string, name string, lon double, lat double, context array<string>")
    a, b = requests.normalize_geocoder(d).collect()
    assert (a.label, a.context, a.candidate_id) == ("Name", ["a"], "1") and b.label == "1.000000, 2.000000" and b.candidate_id == "1.000000,2.000000"
    q = spark.createDataFrame([("114.3, 30.5",), ("x",), ("200,1",), ("1,2,3",)], "q string")
    assert [r.point and tuple(r.point) for r in requests.with_coordinate_text(q, "q").collect()] == [(114.3, 30.5), None, None, None]
    c = spark.createDataFrame([([" a", "b", "a ", ""],)], "c array<string>").select(requests.normal_categories(F.col("c"))).first()[0]
    assert c == ["a", "b"]


def test_budget_slices_find_the_first_excess(spark):
    rows = [(i, "s", f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", 1) for i in range(600)]
    e = spark.createDataFrame(rows, "event_id int, service string, ts string, upstream int").withColumn("ts", F.col("ts").cast("timestamp"))
    r = ledger.audit_budget(e, spark.createDataFrame([("s", 123)], "service string, budget int")).collect()
    assert [(x.event_id, x.running) for x in r] == [(123, 124)]
    assert ledger.audit_budget(e, spark.createDataFrame([("s", 600)], "service string, budget int")).count() == 0


def test_streams_equal_their_batch_twins(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(i, i % 3, f"2024-01-01 00:00:{i:02d}", i % 5, "s" + str(i % 2), i, "f" if i != 17 else "g") for i in range(30)]
    d = spark.createDataFrame(rows, "event_id bigint, job_id int, ts string, state_idx int, service string, remaining int, fingerprint string").withColumn("ts", F.col("ts").cast("timestamp"))
    d.repartition(3).write.parquet(src)
    stream = lambda: spark.readStream.schema(d.schema).parquet(src)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name)

    obs = lambda x: x.select("service", F.col("ts").alias("observed_at"), "event_id", "remaining", F.lit(200).alias("status_code"))
    got = run(jobs.latest_quota(obs(stream())), "t_quota", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.latest_quota(obs(d)).collect()))
    first = run(jobs.first_piece_results(stream().select("ts", F.col("job_id").alias("plan_id"), F.lit("o").alias("source"), F.col("state_idx").cast("string").alias("source_id"))), "t_first", "append")
    assert first.count() == d.select("job_id", "state_idx").distinct().count()
    records = spark.createDataFrame([("a", 1, "2024-01-01 00:00:00", 10), ("b", 2, "2024-01-01 00:00:00", 0)], "endpoint_type string, job_id int, retrieved_at string, ttl_seconds int").withColumn("retrieved_at", F.col("retrieved_at").cast("timestamp"))
    ask = stream().select(F.when(F.col("job_id") == 1, "a").otherwise("b").alias("endpoint_type"), "job_id", F.col("ts").alias("asked_at"))
    fresh = {(r.job_id, r.state) for r in run(jobs.response_freshness(ask, records), "t_fresh", "append").collect()}
    assert fresh == {(0, "missing"), (1, "fresh"), (1, "stale"), (2, "fresh")}


def test_job_state_stream(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, jobs.ROCKSDB)
    try:
        src = str(tmp_path / "src")
        rows = [(1, 1, 0, 0, "f"), (2, 1, 1, 1, "f"), (3, 1, 2, 1, "f"), (4, 1, 3, 0, "f"), (5, 1, 4, 2, "g"), (6, 2, 0, 5, "h")]
        d = spark.createDataFrame(rows, "event_id bigint, job_id int, t int, state_idx int, fingerprint string").withColumn("ts", F.timestamp_seconds(F.col("t") + 1000)).drop("t")
        d.coalesce(1).write.parquet(src)
        q = jobs.job_states(spark.readStream.schema(d.schema).parquet(src)).writeStream.format("memory").queryName("t_jobs").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.awaitTermination(120)
        assert {r.event_id: r.verdict for r in spark.table("t_jobs").collect()} == {1: "created", 2: "advanced", 3: "repeat", 4: "regression", 5: "fingerprint-conflict", 6: "created"}
    finally:
        spark.conf.set(key, before)


def plain_round_robin(rows, n):
    """The rule restated: rows in match order, one a turn from the group that the turn's number modulo the groups left names."""
    if len(rows) <= n:
        return [r[3] for r in rows]
    groups = {}
    for r in rows:
        groups.setdefault((r[1], r[2]), []).append(r[3])
    names, out = sorted(groups), []
    while len(out) < n and names:
        name = names[len(out) % len(names)]
        out.append(groups[name].pop(0))
        if not groups[name]:
            names.remove(name)
    return out


def test_exact_round_robin_against_the_rule(spark):
    rnd = random.Random(4)
    rows, want = [], {}
    for a in range(150):
        own = sorted((a, f"r{rnd.randint(0, 2)}", f"t{rnd.randint(0, 3)}", [rnd.choice("xyz")], f"p{a}-{i:03d}") for i in range(rnd.randint(1, 40)))
        own.sort(key=lambda r: (r[1], r[2], r[3], r[4]))
        want[a] = plain_round_robin([(*r[:3], r[4]) for r in own], 12)
        rows += own
    rows += [(900, "r", t, ["x"], f"{t.lower()}{i}") for t, k in (("A", 2), ("B", 3), ("C", 3)) for i in range(k)]
    d = spark.createDataFrame(rows, "analysis_id int, ring_id string, top_id string, hierarchy array<string>, poi_id string")
    got = {}
    for r in selection.round_robin_limit(d, 12, exact=True).orderBy("position").collect():
        got.setdefault(r.analysis_id, []).append(r.poi_id)
    assert {a: got[a] for a in want} == want
    six = selection.round_robin_limit(d.where("analysis_id = 900"), 6, exact=True).orderBy("position").collect()
    assert [r.poi_id for r in six] == ["a0", "b0", "c0", "a1", "b1", "c1"]


def test_merge_piece_results_against_the_rule(spark):
    rnd = random.Random(7)
    rows = []
    for plan in range(4):
        for pos in range(120):
            lon, lat = (rnd.randint(0, 12) * 3 / 96000, rnd.randint(0, 3) * 3 / 111000)
            if rnd.random() < 0.1:
                lon = rnd.choice([None, 500.0, 2.0])
            rows.append((plan, rnd.randint(0, 2), pos, "osm", rnd.choice([None, "", f"n{rnd.randint(0, 30)}"]), rnd.choice(["Cafe  A", "cafe a", "B"]), lon, lat))
    pieces = [(p, i, True, p == 3) for p in range(4) for i in range(3)]
    d = spark.createDataFrame(rows, "plan_id int, piece int, pos int, source string, source_id string, name string, lon double, lat double")
    outer = squares(spark, (30, 1)).select(F.explode(F.array(*map(F.lit, range(4)))).alias("plan_id"), "edges", "box")
    got, counts = selection.merge_piece_results(d, spark.createDataFrame(pieces, "plan_id int, piece int, complete boolean, truncated boolean"), outer)
    want, sums = set(), {}
    for plan in range(3):
        kept, ids, n = [], set(), {"raw": 0, "outside": 0, "duplicate": 0}
        for r in sorted((r for r in rows if r[0] == plan), key=lambda r: (r[1], r[2])):
            n["raw"] += 1
            if r[6] is None or not (0 <= r[6] <= 1 and 0 <= r[7] <= 1):
                n["outside"] += 1
            elif r[4] and r[4] in ids:
                n["duplicate"] += 1
            elif not r[4] and any(" ".join(k[5].lower().split()) == " ".join(r[5].lower().split()) and math.hypot((k[6] - r[6]) * 96000, (k[7] - r[7]) * 111000) <= 5 for k in kept):
                n["duplicate"] += 1
            else:
                kept.append(r)
                ids.add(r[4] or None)
        want |= {(plan, r[1], r[2]) for r in kept}
        sums[plan] = (n["raw"], n["outside"], n["duplicate"], len(kept))
    assert {(r.plan_id, r.piece, r.pos) for r in got.collect()} == want
    assert {r.plan_id: (r.raw, r.outside, r.duplicate, r.merged) for r in counts.collect()} == sums


def test_exclusive_rings_of_polygons_that_do_not_nest(spark):
    """Against samples: a star that cuts into the square before it, and two squares side by side."""
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    star = [(-3.0, -1.0), (7.0, -1.0), (3.0, 2.0), (7.0, 6.0), (2.0, 3.0), (-3.0, 6.0)]
    far = [(10.0, 0.0), (11.0, 0.0), (11.0, 1.0), (10.0, 1.0)]
    rows = [(1, 10, [[square]]), (1, 20, [[star]]), (2, 10, [[square]]), (2, 20, [[far]])]
    p = spark.createDataFrame(rows, f"analysis_id int, range_minutes int, polygon {POLYGON}")
    d = spatial.with_edges(p).select("analysis_id", "range_minutes", "edges", geo.polygon_area(F.col("polygon")).alias("area"))
    got = {(r.analysis_id, r.range_minutes): r for r in tiles.build_rings(d).collect()}

    def inside(poly, x, y):
        return sum((poly[i - 1][1] > y) != (q[1] > y) and x < (q[0] - poly[i - 1][0]) * (y - poly[i - 1][1]) / (q[1] - poly[i - 1][1]) + poly[i - 1][0] for i, q in enumerate(poly)) % 2 == 1

    rnd = random.Random(1)
    hits = sum(inside(star, x, y) and not inside(square, x, y) for x, y in ((rnd.uniform(-3, 7), rnd.uniform(-1, 6)) for _ in range(40_000)))
    assert abs(got[1, 20].exclusive_area - hits / 40_000 * 70) < 0.6 and not got[1, 20].nested
    assert got[1, 10].exclusive_area == 16 and got[1, 10].nested
    assert abs(got[2, 20].exclusive_area - 1) < 1e-9 and not got[2, 20].nested


def test_points_meet_polygons_of_all_sizes(spark):
    """A tiny and a very large polygon with a hole, whole cells among theirs, against ray casting; points on edges and corners too."""
    rnd = random.Random(2)
    star = lambda cx, cy, r, n: [(cx + r * (1 if i % 2 else 0.5) * math.cos(i * 2 * math.pi / n), cy + r * (1 if i % 2 else 0.5) * math.sin(i * 2 * math.pi / n)) for i in range(n)]
    polys = {1: [[star(10, 10, 0.001, 10)]], 2: [[star(10, 10, 60, 40), star(10, 10, 5, 8)]], 3: [[[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)]]]}
    points = [(i, rnd.uniform(-60, 80), rnd.uniform(-60, 80)) for i in range(600)] + [(600 + i, 10 + rnd.uniform(-0.001, 0.001), 10 + rnd.uniform(-0.001, 0.001)) for i in range(200)] + [(900, 0.0, 0.0), (901, 8.0, 4.0), (902, 8.0, 8.0), (903, 4.0, 0.0), (904, 8.0000001, 4.0)]

    def covered(poly, x, y):
        odd = False
        for ring in (r for part in poly for r in part):
            for i, q in enumerate(ring):
                p = ring[i - 1]
                if (q[0] - p[0]) * (y - p[1]) == (q[1] - p[1]) * (x - p[0]) and min(p[0], q[0]) <= x <= max(p[0], q[0]) and min(p[1], q[1]) <= y <= max(p[1], q[1]):
                    return True
                if (p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0]:
                    odd = not odd
        return odd

    d = spatial.with_edges(spark.createDataFrame(list(polys.items()), f"id int, polygon {POLYGON}")).drop("polygon")
    p = spark.createDataFrame(points, "k int, lon double, lat double")
    got = sorted((r.k, r.id) for r in spatial.points_in_polygons(p, d).collect())
    assert got == sorted((k, i) for k, x, y in points for i, poly in polys.items() if covered(poly, x, y))


def test_gaps_of_lonely_and_crowded_nodes(spark):
    rnd = random.Random(3)
    nodes = [(1, i, rnd.gauss(0, 40) * (1 if i % 7 else 60), rnd.gauss(0, 40), 20 + i % 40, 18) for i in range(200)] + [(2, 1, 5.0, 5.0, 20, 18), (3, 1, -9000.0, 0.0, 20, 18), (3, 2, 9000.0, 1.0, 30, 18), (4, 1, 0.0, 0.0, 1, 1), (4, 2, 0.0, 0.0, 1, 1)]
    d = spark.createDataFrame(nodes, "layout_id int, node_id int, x double, y double, width int, height int")
    got = {(r.layout_id, r.node_id): r.gap for r in spatial.nearest_gap(d).collect()}
    assert len(got) == len(nodes)
    for a in nodes:
        gaps = [math.hypot(max(0, abs(a[2] - b[2]) - (a[4] + b[4]) / 2), max(0, abs(a[3] - b[3]) - (a[5] + b[5]) / 2)) for b in nodes if b[0] == a[0] and b[1] != a[1]]
        assert got[a[:2]] is None if not gaps else abs(got[a[:2]] - min(gaps)) < 1e-9


def test_fingerprints_tell_repeated_rows_apart(spark):
    a = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0)], "k int, t string, v double")
    b = spark.createDataFrame([(1, "b", 1.0), (1, "b", 1.0)], "k int, t string, v double")
    f = lambda d: tuple(publish.result_fingerprint(d, "k", ["t", "v"]).first())[1:]
    assert f(a) != f(b) and f(a.repartition(2)) == f(a) and f(a.limit(1)) != f(a)


def test_publishing_no_rows_and_interrupted_writers(spark, tmp_path):
    path, some = str(tmp_path / "ds"), spark.range(4).toDF("x")
    datasets.publish_dataset(some, path, "d", "r1")
    # A writer that died before its registry row: readers still get the old rows.
    some.union(some).write.parquet(f"{path}/rows/dataset_id=d/content=half")
    assert datasets.read_dataset(spark, path, "d").count() == 4
    datasets.publish_dataset(some.where("false"), path, "d", "r2", replace=True, region_id="east")
    assert datasets.read_dataset(spark, path, "d").count() == 0 and not (tmp_path / "ds/rows/dataset_id=d/content=half").exists()
    ready = datasets.list_ready_datasets(spark.read.parquet(f"{path}/registry")).first()
    assert (ready.dataset_id, ready.release, ready.region_id, ready.n_rows) == ("d", "r2", "east", 0)
    with pytest.raises(ValueError):
        datasets.read_dataset(spark, path, "e")


def test_job_verdicts_equal_the_stream(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, rnd.randint(0, 30), i, rnd.choice([0, 1, 2, 7, 8, 8, 9, 9]), rnd.choice("ffffg")) for i in range(300)]
    d = spark.createDataFrame(rows, "event_id bigint, job_id int, t int, state_idx int, fingerprint string").withColumn("ts", F.timestamp_seconds(F.col("t") + 1000)).drop("t")
    want = {r.event_id: r.verdict for r in ledger.job_verdicts(d).collect()}
    assert {"not-ready", "advanced", "regression", "repeat", "created", "fingerprint-conflict"} <= set(want.values())
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, jobs.ROCKSDB)
    try:
        d.coalesce(1).write.parquet(str(tmp_path / "src"))
        q = jobs.job_states(spark.readStream.schema(d.schema).parquet(str(tmp_path / "src"))).writeStream.format("memory").queryName("t_verdicts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.awaitTermination(120)
        assert {r.event_id: r.verdict for r in spark.table("t_verdicts").collect()} == want
    finally:
        spark.conf.set(key, before)


def test_file_hashes_and_results(spark, tmp_path):
    import hashlib

    (tmp_path / "a.txt").write_text("abc")
    assert [r.sha256 for r in datasets.file_hashes(spark, str(tmp_path / "a.txt")).collect()] == [hashlib.sha256(b"abc").hexdigest()]
    v = spark.createDataFrame([(1, "ring-0-10", "p1", 5.0, 7.0)], "analysis_id int, ring_id string, poi_id string, travel_time_s double, distance_m double")
    datasets.write_results(v, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().poi_count == 1


def test_centroid_with_holes(spark):
    hole = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(2.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 4.0)]]
    d = spark.createDataFrame([([hole],)], f"polygon {POLYGON}").select(geo.centroid(F.col("polygon")).alias("c")).first().c
    assert abs(d.x - 1) < 1e-12 and abs(d.y - 2) < 1e-12
