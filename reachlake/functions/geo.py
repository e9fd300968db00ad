"""Geometry as column expressions: no user-defined functions.

A polygon is array<array<array<struct<x,y>>>> (parts, rings, vertices; the first ring of a part is its shell), an edge
list is array<struct<x1,y1,x2,y2>>.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 and the UTM scale.
WGS84_A, WGS84_F, UTM_K0 = 6378137.0, 1 / 298.257223563, 0.9996
EARTH_M, DEGREE_M = 6371008.8, 111320.0


def ring_edges(ring: Column) -> Column:
    """Closed edges of a vertex array; a repeated last vertex gives one edge of no length, which changes nothing."""
    n = F.size(ring)
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(ring[i]["x"].alias("x1"), ring[i]["y"].alias("y1"), ring[F.pmod(i + 1, n)]["x"].alias("x2"), ring[F.pmod(i + 1, n)]["y"].alias("y2"))))


def polygon_edges(polygon: Column) -> Column:
    return F.flatten(F.transform(F.flatten(polygon), ring_edges))


def covers(edges: Column, x: Column, y: Column) -> Column:
    """Whether the polygon of these edges covers the point; the boundary is inside."""

    def on(e: Column) -> Column:
        return ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"])) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    def crosses(e: Column) -> Column:
        return F.when((e["y1"] > y) != (e["y2"] > y), x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]).otherwise(False)

    return F.exists(edges, on) | (F.size(F.filter(edges, crosses)) % 2 == 1)


def signed_area(ring: Column) -> Column:
    """Shoelace area of a vertex array, positive if counter-clockwise; taken from the first vertex to keep digits."""
    n = F.size(ring)

    def term(a: Column, i: Column) -> Column:
        p, q = ring[i], ring[F.pmod(i + 1, n)]
        return a + (p["x"] - ring[0]["x"]) * (q["y"] - ring[0]["y"]) - (q["x"] - ring[0]["x"]) * (p["y"] - ring[0]["y"])

    return F.when(n > 2, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), term) / 2).otherwise(F.lit(0.0))


def perimeter(ring: Column) -> Column:
    n = F.size(ring)
    return F.when(n > 1, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + F.hypot(ring[F.pmod(i + 1, n)]["x"] - ring[i]["x"], ring[F.pmod(i + 1, n)]["y"] - ring[i]["y"]))).otherwise(F.lit(0.0))


def polygon_area(polygon: Column) -> Column:
    """Shells minus holes."""
    part = lambda p: F.abs(signed_area(p[0])) - F.aggregate(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.lit(0.0), lambda a, h: a + F.abs(signed_area(h)))
    return F.aggregate(polygon, F.lit(0.0), lambda a, p: a + part(p))


def compactness(area: Column, length: Column) -> Column:
    return F.when(length > 0, 4 * math.pi * area / (length * length))


def bbox(polygon: Column) -> Column:
    v = F.flatten(F.flatten(polygon))
    return F.struct(
        F.array_min(F.transform(v, lambda p: p["x"])).alias("west"), F.array_min(F.transform(v, lambda p: p["y"])).alias("south"),
        F.array_max(F.transform(v, lambda p: p["x"])).alias("east"), F.array_max(F.transform(v, lambda p: p["y"])).alias("north"),
    )


def ring_text(ring: Column) -> Column:
    """Vertices from the smallest one on, counter-clockwise, at seven decimals: equal for equal rings."""
    open_ = F.when((F.size(ring) > 1) & (ring[0] == F.element_at(ring, -1)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    turned = F.transform(F.array(open_), lambda r: F.when(signed_area(r) < 0, F.reverse(r)).otherwise(r))[0]
    first = F.transform(F.array(turned), lambda r: F.struct(r.alias("r"), F.array_position(r, F.array_min(r)).cast("int").alias("i")))[0]
    moved = F.transform(F.array(first), lambda s: F.concat(F.slice(s["r"], s["i"], F.size(s["r"])), F.slice(s["r"], 1, s["i"] - 1)))[0]
    return F.array_join(F.transform(moved, lambda p: F.format_string("%.7f %.7f", p["x"].cast("double"), p["y"].cast("double"))), ",")


def geometry_hash(polygon: Column) -> Column:
    """SHA-256 of a polygon, whatever vertex its rings start at, whichever way round and in whichever order of parts."""
    return F.sha2(F.array_join(F.array_sort(F.transform(polygon, lambda p: F.array_join(F.transform(p, ring_text), "|"))), "#"), 256)


def utm_zone(lon: Column) -> Column:
    return F.least(F.lit(60), F.greatest(F.lit(1), F.floor((lon + 180) / 6) + 1)).cast("int")


#: False easting, and false northing of the southern hemisphere.
UTM_EAST, UTM_SOUTH = 500000.0, 10000000.0


def utm_forward(lon: Column, lat: Column, zone: Column, south: Column | None = None) -> Column:
    """Struct of easting and northing by the usual WGS84 series (fixed values). Where `south` (without it: the point lies below the equator) the northing has its false one."""
    south = lat < 0 if south is None else south
    e2 = WGS84_F * (2 - WGS84_F)
    ep2 = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    n = WGS84_A / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c, a = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2), F.cos(phi) * lam
    m = WGS84_A * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    x = UTM_K0 * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(a, 5) / 120) + UTM_EAST
    y = UTM_K0 * (m + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(a, 6) / 720))
    return F.struct(x.alias("x"), (y + F.when(south, UTM_SOUTH).otherwise(0.0)).alias("y"))


def utm_inverse(x: Column, y: Column, zone: Column, south: Column | None = None) -> Column:
    """Struct of lon and lat for easting and northing; `south` says that the northing has its false one."""
    y = y if south is None else y - F.when(south, UTM_SOUTH).otherwise(0.0)
    e2 = WGS84_F * (2 - WGS84_F)
    ep2, e1 = e2 / (1 - e2), (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu = y / UTM_K0 / (WGS84_A * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    p = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    c, t = ep2 * F.pow(F.cos(p), 2), F.pow(F.tan(p), 2)
    root = 1 - e2 * F.pow(F.sin(p), 2)
    n, r = WGS84_A / F.sqrt(root), WGS84_A * (1 - e2) / F.pow(root, 1.5)
    d = (x - UTM_EAST) / (n * UTM_K0)
    lat = p - n * F.tan(p) / r * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, 6) / 720)
    lon = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, 5) / 120) / F.cos(p)
    return F.struct((F.degrees(lon) + (zone * 6 - 183)).alias("lon"), F.degrees(lat).alias("lat"))


def utm_polygon(polygon: Column, zone: Column, south: Column | None = None) -> Column:
    """A polygon in metres, all of it with the false northing or (without `south`) none of it, so that one over the equator stays whole."""
    south = F.lit(False) if south is None else south
    return F.transform(polygon, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: utm_forward(p["x"], p["y"], zone, south))))


def centroid(polygon: Column) -> Column:
    """Struct of x and y: centre of the area, holes taken out; taken from the first vertex to keep digits. Null if the area is 0."""
    x0, y0 = polygon[0][0][0]["x"], polygon[0][0][0]["y"]

    def ring(r: Column, sign: Column) -> Column:
        """Signed area twice, and its moments six times, of one ring turned to `sign`."""
        n = F.size(r)

        def term(a: Column, i: Column) -> Column:
            p, q = r[i], r[F.pmod(i + 1, n)]
            px, py, qx, qy = p["x"] - x0, p["y"] - y0, q["x"] - x0, q["y"] - y0
            cross = px * qy - qx * py
            return F.struct((a["a"] + cross).alias("a"), (a["x"] + (px + qx) * cross).alias("x"), (a["y"] + (py + qy) * cross).alias("y"))

        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        turned = lambda a: F.transform(F.array(a), lambda s: F.struct(*((s[k] * F.signum(s["a"]) * sign).alias(k) for k in "axy")))[0]
        return F.aggregate(F.sequence(F.lit(0), n - 1), zero, term, turned)

    rings = F.flatten(F.transform(polygon, lambda part: F.transform(part, lambda r, i: ring(r, F.when(i == 0, 1.0).otherwise(-1.0)))))
    total = F.aggregate(rings, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda t, r: F.struct(*((t[k] + r[k]).alias(k) for k in "axy")))
    return F.transform(F.array(total), lambda t: F.when(t["a"] != 0, F.struct((x0 + t["x"] / (3 * t["a"])).alias("x"), (y0 + t["y"] / (3 * t["a"])).alias("y"))))[0]


def area_km2(polygon: Column) -> Column:
    """Area by UTM in the zone of the centroid, rounded to four decimals."""
    return F.round(polygon_area(utm_polygon(polygon, utm_zone(centroid(polygon)["x"]))) / 1e6, 4)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def local_xy(lon: Column, lat: Column, lon0: Column, lat0: Column) -> Column:
    """Metres east and north of a centre, equirectangular."""
    return F.struct(((lon - lon0) * DEGREE_M * F.cos(F.radians(lat0))).alias("dx"), ((lat - lat0) * DEGREE_M).alias("dy"))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial great-circle bearing in degrees, 0 north, clockwise, in [0, 360)."""
    d = F.radians(lon2 - lon1)
    a, b = F.radians(lat1), F.radians(lat2)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def normal_angle(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """Shortest angular distance in degrees, 0 to 180."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360.0 - d)


def sector(angle: Column, n: int) -> Column:
    """Index of the half-open sector, the first one centred on 0 degrees."""
    return F.pmod(F.floor((normal_angle(angle) + 180.0 / n) / (360.0 / n)), F.lit(n)).cast("int")


def near_sector_edge(angle: Column, n: int, tolerance: float = 1e-9) -> Column:
    width = 360.0 / n
    at = F.pmod(normal_angle(angle) + width / 2, F.lit(width))
    return F.least(at, width - at) <= tolerance


def sign_eps(x: Column, eps: float) -> Column:
    return F.when(x > eps, 1).when(x < -eps, -1).otherwise(0)
