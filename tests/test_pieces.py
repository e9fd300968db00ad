"""Overlays, clipped piece plans and adjacency against plain rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from reachlake.functions import geo
from reachlake.operators import overlay, pieces, spatial, tiles

POLYGON = "array<array<array<struct<x:double,y:double>>>>"


def star(rnd, cx, cy, r, n=9):
    out = []
    for k in range(n):
        a, q = (k + 0.8 * rnd.random()) * 2 * math.pi / n, r * (0.3 + rnd.random())
        out.append((cx + q * math.cos(a), cy + q * math.sin(a)))
    return out


def ring_edges(r):
    return [(*r[i - 1], *r[i]) for i in range(len(r))]


def plain_areas(pieces, outer):
    """planned, outer, union, uncovered, outside by strips over all edges at once; polygons are lists of rings (even-odd)."""
    edges = [(e, "o") for r in outer for e in ring_edges(r)] + [(e, i) for i, p in enumerate(pieces) for r in p for e in ring_edges(r)]
    heights = {y for e, _ in edges for y in (e[1], e[3])}
    for i, (a, _) in enumerate(edges):
        for b, _ in edges[:i]:
            den = (a[2] - a[0]) * (b[3] - b[1]) - (a[3] - a[1]) * (b[2] - b[0])
            if den:
                t = ((b[0] - a[0]) * (b[3] - b[1]) - (b[1] - a[1]) * (b[2] - b[0])) / den
                if 0 <= t <= 1:
                    heights.add(a[1] + t * (a[3] - a[1]))
    ys, total = sorted(heights), [0.0] * 5
    for lo, hi in zip(ys, ys[1:]):
        m = (lo + hi) / 2
        xs = sorted((e[0] + (m - e[1]) / (e[3] - e[1]) * (e[2] - e[0]), str(w)) for e, w in edges if (e[1] > m) != (e[3] > m))
        on = set()
        for (x, w), (after, _) in zip(xs, [*xs[1:], (0, 0)]):
            on ^= {w}
            c, q = len(on - {"o"}), "o" in on
            for j, v in enumerate((c, q, c > 0, q and not c, c > 0 and not q)):
                total[j] += v * (after - x) * (hi - lo) if on else 0
    return total


def frame(spark, rows):
    floats = lambda p: p and [[[(float(x), float(y)) for x, y in r] for r in q] for q in p]
    return spark.createDataFrame([(i, floats(p)) for i, p in rows], f"id int, polygon {POLYGON}")


@pytest.mark.parametrize("most", [3, 12])
def test_overlay_areas_against_strips(spark, most):
    """Pieces of either direction, with holes, that overlap each other and the outer polygon; a null key; identical pieces."""
    rnd = random.Random(3)
    inner, outer, want = [], [], {}
    for k in [*range(9), None]:
        o = [star(rnd, 5, 5, 4, rnd.choice([5, 9, 40]))]
        ps = [[star(rnd, rnd.uniform(1, 9), rnd.uniform(1, 9), rnd.uniform(0.5, 3))] for _ in range(rnd.choice([1, 2, 6]))]
        if k and k % 3 == 0:
            ps = [[r[::-1] for r in p] for p in ps] + [ps[0]]
        if k == 4:
            ps.append([[(2, 2), (8, 2), (8, 8), (2, 8)], [(3, 3), (3, 7), (7, 7), (7, 3)]])
        outer.append((k, [o]))
        inner += [(k, [p]) for p in ps]
        want[k] = plain_areas(ps, o)
    e = overlay.region_edges(frame(spark, inner), ["id"], "p").unionByName(overlay.region_edges(frame(spark, outer), ["id"], "q"))
    got = {r.id: [r[a] for a in overlay.AREAS] for r in overlay.overlay_areas(e, ["id"], most=most).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=1e-9), k


def test_overlay_of_many_vertices(spark):
    """Two polygons of 3,000 vertices, one moved: cells are split several times, and uncovered and outside areas are equal."""
    n = 3000
    a = [((3 + 0.5 * math.sin(40 * t)) * math.cos(t), (3 + 0.5 * math.sin(40 * t)) * math.sin(t)) for t in (2 * math.pi * i / n for i in range(n))]
    b = [(x + 1, y + 0.3) for x, y in a]
    r = overlay.overlay(frame(spark, [(1, [[a]])]), frame(spark, [(1, [[b]])]), ["id"]).first()
    area = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(a, [*a[1:], a[0]]))) / 2
    assert r.planned == pytest.approx(area, rel=1e-12) and r.outer_area == pytest.approx(area, rel=1e-12)
    assert r.uncovered == pytest.approx(r.outside, rel=1e-9) and 0 < r.uncovered < area


def test_coverage_audit_tells_each_fault(spark):
    """Shifted, doubled and missing pieces, a gap that an equal overhang hides in sums, holes, and keys on one side only."""
    square = lambda x, y, s=2000.0: [[(x, y), (x + s, y), (x + s, y + s), (x, y + s)]]
    four = [square(0, 0), square(2000, 0), square(0, 2000), square(2000, 2000)]
    outer = [(i, [square(0.0, 0.0, 4000.0)]) for i in range(1, 7)] + [(7, [square(0, 0)])]
    rows = [(1, [p]) for p in four] + [(2, [p]) for p in four[1:]] + [(3, [p]) for p in [*four, four[0]]] + [(4, [p]) for p in [*four[:3], square(4000, 2000)]]
    rows += [(5, [p]) for p in [*four[:3], four[0]]] + [(6, [square(0.001, 0, 4000.0)])] + [(8, [square(0, 0)])]
    got = {r.id: r for r in tiles.coverage_audit(frame(spark, rows), ["id"], frame(spark, outer)).collect()}
    tell = lambda r: tuple(round(v, 3) for v in (r.planned, r.outer_area, r.difference, r.uncovered, r.outside, r.overlap)) + (r.covered,)
    assert {k: tell(r) for k, r in got.items()} == {
        1: (16, 16, 0, 0, 0, 0, True), 2: (12, 16, -4, 4, 0, 0, False), 3: (20, 16, 4, 0, 0, 4, False), 4: (16, 16, 0, 4, 4, 0, False),
        5: (16, 16, 0, 4, 0, 4, False), 6: (16, 16, 0, 0, 0, 0, True), 7: (0, 4, -4, 4, 0, 0, False), 8: (4, 0, 4, 0, 4, 0, False),
    }
    assert got[1].tolerance == pytest.approx(0.016)


def test_coverage_audit_in_degrees(spark):
    """A lon-lat box and its halves, projected: covered; one half alone is not."""
    box = lambda w, e: [[[(w, 30.0), (e, 30.0), (e, 30.1), (w, 30.1)]]]
    outer = frame(spark, [(1, box(114.0, 114.1)), (2, box(114.0, 114.1))])
    inner = frame(spark, [(1, box(114.0, 114.05)), (1, box(114.05, 114.1)), (2, box(114.0, 114.05))])
    got = {r.id: r for r in tiles.coverage_audit(inner, ["id"], outer, lon_lat=True).collect()}
    assert got[1].covered and not got[2].covered and abs(got[1].outer_area - 106.9) < 0.3 and abs(got[2].uncovered - 53.4) < 0.3


def test_repeated_tiles_are_not_covered(spark):
    d = frame(spark, [(1, [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]])])
    t = tiles.tile_polygons(d, 0.75)
    assert tiles.coverage_audit(t, ["id"]).first().covered
    twice = tiles.coverage_audit(t.unionByName(t), ["id"]).first()
    assert not twice.covered and abs(twice.overlap - 16) < 1e-9


def plain_clip(ring, w, s, e, n):
    for axis, limit, sign in ((0, w, 1), (0, e, -1), (1, s, 1), (1, n, -1)):
        out = []
        for i, p in enumerate(ring):
            q = ring[i - 1]
            a, b = sign * (q[axis] - limit), sign * (p[axis] - limit)
            if (a < 0) != (b < 0):
                t = a / (a - b)
                out.append(tuple(limit if k == axis else q[k] + t * (p[k] - q[k]) for k in (0, 1)))
            if b >= 0:
                out.append(p)
        ring = out
    return ring


def plain_area(ring):
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, [*ring[1:], ring[0]]))) / 2 if len(ring) > 2 else 0.0


def plain_plan(ring, grid, cap, depth, pts=None, limit=None):
    """Plain recursion: {piece_id: (area, points, incomplete)}."""
    out = {}
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    r0, c0 = math.floor(min(ys) / grid), math.floor(min(xs) / grid)

    def visit(name, r, level, own):
        area = plain_area(r)
        if area <= 0:
            return
        over = area > cap + 1 or (limit is not None and len(own) >= limit)
        if not over or level == depth:
            out[name] = (area, len(own), over)
            return
        w, e, s, n = min(p[0] for p in r), max(p[0] for p in r), min(p[1] for p in r), max(p[1] for p in r)
        mx, my = (w + e) / 2, (s + n) / 2
        for i, (lo, hi) in enumerate(((s, my), (my, n))):
            for j, (a, b) in enumerate(((w, mx), (mx, e))):
                visit(f"{name}-{i}{j}", plain_clip(r, a, lo, b, hi), level + 1, [p for p in own if (p[1] >= my) == bool(i) and (p[0] >= mx) == bool(j)])

    for row in range(r0, math.floor(max(ys) / grid) + 1):
        for col in range(c0, math.floor(max(xs) / grid) + 1):
            own = [p for p in pts or [] if math.floor(p[1] / grid) == row and math.floor(p[0] / grid) == col and min(xs) <= p[0] <= max(xs) and min(ys) <= p[1] <= max(ys)]
            visit(f"cell-{row - r0:04d}-{col - c0:04d}", plain_clip(ring, col * grid, row * grid, (col + 1) * grid, (row + 1) * grid), 0, own)
    return out


def test_plan_equals_a_plain_recursion(spark):
    """Areas in pieces sum to the polygon's, the pieces pass the coverage audit, and leaves, areas, points and flags are those of the recursion."""
    rnd = random.Random(6)
    rings = {i: star(rnd, 500_000 + 3000 * i, 3_300_000, 9000) for i in range(5)}
    pts = [(i, 500_000 + 3000 * i + rnd.gauss(0, 1500), 3_300_000 + rnd.gauss(0, 1500)) for i in rings for _ in range(300)]
    d = frame(spark, [(i, [[r]]) for i, r in rings.items()])
    for points, limit in ((None, None), (spark.createDataFrame(pts, "id int, x double, y double"), 6)):
        got = pieces.plan_pieces(d, ["id"], 5000.0, cap=6e6, depth=3, points=points, limit=limit, whole=None).cache()
        want = {(i, k): v for i, r in rings.items() for k, v in plain_plan(r, 5000.0, 6e6, 3, [p[1:] for p in pts if p[0] == i] if limit else None, limit).items()}
        rows = {(r.id, r.piece_id): r for r in got.collect()}
        assert rows.keys() == want.keys()
        for k, (area, n, over) in want.items():
            assert rows[k].area == pytest.approx(area, rel=1e-9, abs=1e-3) and rows[k].incomplete == over
            assert not limit or rows[k].n_points == n
        for i, r in rings.items():
            assert sum(v.area for (j, _), v in rows.items() if i == j) == pytest.approx(plain_area(r), rel=1e-9)
    assert any(r.incomplete for r in rows.values()) and any(r.level == 3 for r in rows.values())
    assert all(r.covered for r in tiles.coverage_audit(got, ["id"], d).collect())


def test_whole_pieces_and_edges_of_the_plan(spark):
    small = [[[(0.0, 0.0), (6000.0, 0.0), (6000.0, 7000.0), (0.0, 7000.0)]]]
    d = frame(spark, [(1, small), (2, None), (3, [])])
    r = pieces.plan_pieces(d, ["id"], 2000.0).collect()
    assert [(x.id, x.piece_id, x.area, x.incomplete) for x in r] == [(1, "whole", 42e6, False)]
    least = pieces.plan_pieces(d, ["id"], 7000.0, cap=1e6, depth=5, least=3e6, whole=None).collect()
    assert {x.level for x in least} == {1} and all(x.incomplete for x in least)
    holed = [[small[0][0], [(1000.0, 1000.0), (5000.0, 1000.0), (5000.0, 5000.0), (1000.0, 5000.0)]]]
    cut = pieces.plan_pieces(frame(spark, [(1, holed)]), ["id"], 2000.0, whole=None)
    assert cut.agg(F.sum("area")).first()[0] == 42e6 - 16e6 and "cell-0001-0001" not in {x.piece_id for x in cut.collect()}
    f = pieces.fragmentation(frame(spark, [(1, holed)])).first()
    assert (f.vertices, f.perimeter, f.holes, f.parts, f.box_share) == (8, 42_000.0, 1, 1, pytest.approx(26 / 42))


def test_plan_is_dealt_over_tasks(spark):
    """Polygons that come in one partition are cut in several tasks, with holes, parts and rings of no vertices, slice by slice as at once."""
    rnd = random.Random(3)
    rows = [(i, [[star(rnd, 3000 * i, 0, 9000), star(rnd, 3000 * i, 0, 500)], [star(rnd, 3000 * i, 30_000, 4000)], []]) for i in range(40)]
    d = frame(spark, rows).coalesce(1)
    p = pieces.grid_pieces(d, ["id"], 2000.0, None).withColumn("part", F.spark_partition_id())
    got = {(r.id, r.piece_id): r for r in p.collect()}
    assert len({r.part for r in got.values()}) > 1
    for i, (big, other, _) in rows:
        own = [r for (j, _), r in got.items() if i == j]
        assert sum(r.area for r in own) == pytest.approx(plain_area(big[0]) - plain_area(big[1]) + plain_area(other[0]), rel=1e-9)
        assert all(min(len(q) for q in r.polygon) > 0 for r in own)
    import pyarrow as pa

    kind = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    shape = [[[[{"x": x, "y": y} for x, y in g] for g in q] for q in r] for _, r in rows]
    b = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([""] * 40), pa.array([0] * 40, pa.int32()), pa.array(shape, kind)], ["id", "piece_id", "level", "polygon"])
    at_once, sliced = (pa.Table.from_batches(list(pieces._clip_rows("grid", 2000.0, most)([b]))) for most in (1 << 30, 100))
    assert at_once.equals(sliced) and at_once.num_rows == len(got)
    with pytest.raises(ValueError):
        list(pieces._clip_rows("grid", 1.0)([pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([[[[{"x": math.inf, "y": 0.0}]]]] * 40, kind)], b.schema.names)]))


def test_adjacency_of_mixed_levels_and_any_pieces(spark):
    """Against overlaps of all edge pairs: quadtree pieces of several levels, a turned copy, and pieces that touch in a point only."""
    rnd = random.Random(9)
    ring = star(rnd, 0, 0, 9000)
    pts = spark.createDataFrame([(1, rnd.gauss(500, 900), rnd.gauss(500, 900)) for _ in range(200)], "id int, x double, y double")
    p = pieces.plan_pieces(frame(spark, [(1, [[ring]])]), ["id"], 5000.0, cap=1e9, depth=2, points=pts, limit=30, whole=None)
    c, s = math.cos(0.4), math.sin(0.4)
    turned = F.transform("polygon", lambda q: F.transform(q, lambda r: F.transform(r, lambda v: F.struct((v["x"] * c - v["y"] * s).alias("x"), (v["x"] * s + v["y"] * c).alias("y")))))
    rows = p.collect()
    got = {(r.left_id, r.right_id): r for r in pieces.piece_adjacency(p, ["id"], cap=20e6).collect()}
    want = {}
    shapes = {r.piece_id: [[(v.x, v.y) for v in g] for q in r.polygon for g in q] for r in rows}
    area = {r.piece_id: r.area for r in rows}

    def along(a, b):
        """Signed overlap of two edges on one axis-parallel line: positive if they run against each other."""
        for i in (0, 1):
            if a[i] == a[i + 2] == b[i] == b[i + 2]:
                j = 1 - i
                o = min(max(a[j], a[j + 2]), max(b[j], b[j + 2])) - max(min(a[j], a[j + 2]), min(b[j], b[j + 2]))
                return max(o, 0) * (1 if (a[j + 2] > a[j]) != (b[j + 2] > b[j]) else -1)
        return 0.0

    for x in shapes:
        for y in shapes:
            if x < y:
                o = sum(along(a, b) for r in shapes[x] for a in ring_edges(r) for q in shapes[y] for b in ring_edges(q))
                if o > 0.01:
                    want[x, y] = o
    assert got.keys() == want.keys() and len({k.count("-") for pair in want for k in pair}) > 1
    for k, o in want.items():
        assert got[k].shared == pytest.approx(o, rel=1e-9) and got[k].merge_allowed == (area[k[0]] + area[k[1]] <= 20e6 + 1)
    again = {(r.left_id, r.right_id): r.shared for r in pieces.piece_adjacency(p.withColumn("polygon", turned), ["id"]).collect()}
    assert again.keys() == want.keys() and all(again[k] == pytest.approx(o, abs=0.02) for k, o in want.items())


def test_edges_go_to_few_steps(spark):
    """Hardly an edge is copied to a second step, and edges on both sides of a step's border still meet."""
    rnd = random.Random(5)
    p = pieces.plan_pieces(frame(spark, [(i, [[star(rnd, 7919 * i, 104_729 * i, 9000)]]) for i in range(20)]), ["id"], 1000.0, whole=None)
    one, two = pieces._edge_rows(p, ["id"], 0.01, 4096.0)
    n = one.count()
    assert n > 4000 and two.count() < 1.2 * n
    # Neighbours with a gap of 8 mm, at distances all over two steps of a metre.
    box = lambda w, e: [[[(w, 0.0), (e, 0.0), (e, 10.0), (w, 10.0)]]]
    rows = [(i, k, q, 100.0) for i in range(200) for k, q in (("a", box(0.0, 20 + i / 100)), ("b", box(20.008 + i / 100, 50.0)))]
    d = spark.createDataFrame(rows, f"id int, piece_id string, polygon {POLYGON}, area double")
    got = pieces.piece_adjacency(d, ["id"], cap=200.0).collect()
    assert len(got) == 200 and all(r.shared == pytest.approx(10.0) and r.union_area == 200.0 and r.merge_allowed for r in got)


def test_exclusive_rings_of_many_vertices(spark):
    """Polygons of 5,000 vertices, the second wider by half: no edge list meets another one in a task."""
    n = 5000
    ring = lambda r: [(r * (3 + 0.2 * math.sin(30 * t)) * math.cos(t), r * (3 + 0.2 * math.sin(30 * t)) * math.sin(t)) for t in (2 * math.pi * i / n for i in range(n))]
    p = spark.createDataFrame([(1, 10, [[ring(1.0)]]), (1, 20, [[ring(1.5)]])], f"analysis_id int, range_minutes int, polygon {POLYGON}")
    d = spatial.with_edges(p).select("analysis_id", "range_minutes", "edges", geo.polygon_area(F.col("polygon")).alias("area"))
    got = {r.range_minutes: r for r in tiles.build_rings(d).collect()}
    assert got[20].nested and got[20].exclusive_area == pytest.approx(got[20].ring_area, rel=1e-9) and got[10].exclusive_area == pytest.approx(got[10].area, rel=1e-9)
