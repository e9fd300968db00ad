"""Case folding, UTF-16 hashes, southern UTM and GeoJSON of rings and centres."""

import json

from pyspark.sql import functions as F

from reachlake.functions import geo, text
from reachlake.sources import datasets

POLYGON = "array<array<array<struct<x:double,y:double>>>>"


def test_case_folding_of_every_letter(spark):
    """Against Python's full case folding, but for Cherokee, whose folding is upper case."""
    letters = [chr(i) for i in range(0x20, 0x1E944) if not 0xD800 <= i < 0xE001 and not 0x13A0 <= i <= 0x13FF and not 0xAB70 <= i <= 0xABBF and chr(i).isprintable()]
    got = spark.createDataFrame([(c,) for c in letters], "c string").select("c", text.case_fold(F.col("c")).alias("f")).collect()
    wrong = [(r.c, r.f, r.c.casefold()) for r in got if r.f != r.c.casefold()]
    # Letters newer than one side's Unicode tables may differ.
    assert len(wrong) <= 40, wrong[:60]
    names = [("STRASSE", "straße"), ("ΟΔΟΣ", "οδος"), ("ﬁsh", "FISH"), ("Café  X", " CAFÉ x "), ("K", "k")]
    for a, b in spark.createDataFrame(names, "a string, b string").select(text.name_key(F.col("a")), text.name_key(F.col("b"))).collect():
        assert a == b


def test_hash_over_utf16_units(spark):
    def plain(s):
        h = 2166136261
        data = s.encode("utf-16-be")
        for i in range(0, len(data), 2):
            h = (h ^ int.from_bytes(data[i : i + 2])) * 16777619 & 0xFFFFFFFF
        return f"{h:08x}"

    words = ["", "foobar", "咖啡", "a😀b", "𐍈"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.fnv1a32(F.col("w")).alias("h")).collect()
    assert {r.w: r.h for r in got} == {w: plain(w) for w in words}


def test_southern_utm(spark):
    d = spark.createDataFrame([(151.2, -33.9), (151.2, 33.9), (-70.0, -0.001)], "lon double, lat double")
    zone = geo.utm_zone(F.col("lon"))
    p = d.withColumn("p", geo.utm_forward(F.col("lon"), F.col("lat"), zone)).withColumn("q", geo.utm_inverse(F.col("p.x"), F.col("p.y"), zone, F.col("lat") < 0)).collect()
    assert all(abs(r.q.lon - r.lon) < 1e-7 and abs(r.q.lat - r.lat) < 1e-7 for r in p)
    assert abs(p[0].p.y + p[1].p.y - 10_000_000) < 1e-6 and 9_999_800 < p[2].p.y < 10_000_000
    box = spark.createDataFrame([([[[(20.0, -0.05), (20.1, -0.05), (20.1, 0.05), (20.0, 0.05)]]],)], f"p {POLYGON}")
    assert 120 < box.select(geo.area_km2(F.col("p"))).first()[0] < 125  # a polygon over the equator stays whole


def test_ring_and_centre_features(spark):
    one = [[[(114.0, 30.0), (114.1, 30.0), (114.1, 30.1)]]]
    two = [one[0], [[(115.0, 30.0), (115.1, 30.0), (115.1, 30.1), (115.0, 30.0)]]]
    rows = [(1, 'a"b', 0, 10, one), (1, None, 10, 20, two), (1, "x", 0, 5, None), (2, "bad", 0, 5, [[[(200.0, 0.0), (0.0, 0.0), (1.0, 1.0)]]])]
    good, bad = datasets.ring_features(spark.createDataFrame(rows, f"analysis_id int, ring_id string, inner_minutes int, outer_minutes int, polygon {POLYGON}"))
    a, b = sorted((json.loads(r.value) for r in good.collect()), key=lambda f: f["properties"]["outerRangeMinutes"])
    ring = [[114.0, 30.0], [114.1, 30.0], [114.1, 30.1], [114.0, 30.0]]
    assert a == {"type": "Feature", "id": 'a"b', "properties": {"ringId": 'a"b', "innerRangeMinutes": 0, "outerRangeMinutes": 10}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
    assert b["id"] == "ring-20" and b["geometry"]["type"] == "MultiPolygon" and b["geometry"]["coordinates"][0] == [ring] and len(b["geometry"]["coordinates"][1][0]) == 4
    assert [r.ring_id for r in bad.collect()] == ["bad"]
    good, bad = datasets.centre_features(spark.createDataFrame([(1, None, 114.0, 30.0), (2, "x", None, 30.0)], "analysis_id int, label string, lon double, lat double"))
    assert json.loads(good.first().value) == {"type": "Feature", "id": "analysis-center", "properties": {"label": ""}, "geometry": {"type": "Point", "coordinates": [114.0, 30.0]}} and bad.count() == 1


def test_boxes_open_only_files_that_reach_into_them(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = [(i, rng.uniform(113, 116), rng.uniform(29, 32)) for i in range(4000)] + [(-1, None, 30.0), (-2, 114.0, None)]
    d = spark.createDataFrame(rows, "id int, lon double, lat double").repartition(3)
    path = str(tmp_path / "ds")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert datasets.publish_dataset(d, path, "here", "r1", places=True) == "published"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    whole = datasets.read_dataset(spark, path, "here")
    assert whole.count() == 4002 and len(whole.inputFiles()) >= 24
    for box in ((114.1, 30.1, 114.3, 30.2), (113.0, 29.0, 116.0, 32.0), (10.0, 10.0, 11.0, 11.0), (rows[7][1], rows[7][2], rows[7][1], rows[7][2])):
        got = datasets.read_box(spark, path, "here", *box)
        want = {i for i, x, y in rows if x is not None and y is not None and box[0] <= x <= box[2] and box[1] <= y <= box[3]}
        assert {r.id for r in got.collect()} == want
    small = datasets.read_box(spark, path, "here", 114.1, 30.1, 114.3, 30.2)
    assert len(small.inputFiles()) <= 8 and "PushedFilters: [" in small._jdf.queryExecution().executedPlan().toString()
    assert datasets.publish_dataset(d, path, "plain", "r1") == "published" and datasets.read_box(spark, path, "plain", 113, 29, 114, 30).count() > 0
