"""Grid covers of polygons: tiles, clipped areas, adaptive splits, coverage audits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from .overlay import _meet, overlay, overlay_areas, plain_edges
from .ranks import MOST, at_places, by_size
from .spatial import cell_of


def _clip(ring: list[tuple[float, float]], x0: float, y0: float, x1: float, y1: float) -> float:
    """Area of a ring inside a box, by cutting it along the box's four sides."""
    for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for i, p in enumerate(ring):
            q = ring[i - 1]
            a, b = sign * (q[axis] - limit), sign * (p[axis] - limit)
            if (a < 0) != (b < 0):
                t = a / (a - b)
                out.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            if b >= 0:
                out.append(p)
        ring = out
        if len(ring) < 3:
            return 0.0
    return sum(ring[i - 1][0] * p[1] - p[0] * ring[i - 1][1] for i, p in enumerate(ring)) / 2


@F.pandas_udf(T.DoubleType())
def clipped_area(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """Area of polygon (parts, rings, x-y pairs) inside a box; shells count plus, holes minus."""
    for polygon, x0, y0, x1, y1 in batches:
        out = []
        for parts, *box in zip(polygon, x0, y0, x1, y1, strict=True):
            area = 0.0
            for part in parts:
                for k, ring in enumerate(part):
                    a = abs(_clip([(p[0] - box[0], p[1] - box[1]) for p in ring], 0.0, 0.0, box[2] - box[0], box[3] - box[1]))
                    area += a if k == 0 else -a
            out.append(area)
        yield pd.Series(out, dtype="float64")


def tile_polygons(polygons: DataFrame, size: float, whole_below: float | None = None) -> DataFrame:
    """Tiles (row, col) of a grid of `size` that a planar polygon has area in, with id cell-rrrr-cccc and clipped area.

    A polygon of at most whole_below area is one piece (row and col null).
    """
    d = polygons.withColumns({"box": geo.bbox(F.col("polygon")), "polygon_area": geo.polygon_area(F.col("polygon"))})
    small = F.lit(False) if whole_below is None else F.col("polygon_area") <= whole_below
    t = d.where(~small)
    t = t.withColumn("row", F.explode(F.sequence(cell_of(F.col("box.south"), size), cell_of(F.col("box.north"), size)))).withColumn("col", F.explode(F.sequence(cell_of(F.col("box.west"), size), cell_of(F.col("box.east"), size))))
    xy = F.transform("polygon", lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))))
    area = clipped_area(xy, F.col("col") * F.lit(float(size)), F.col("row") * F.lit(float(size)), (F.col("col") + 1) * F.lit(float(size)), (F.col("row") + 1) * F.lit(float(size)))
    name = F.format_string("cell-%04d-%04d", F.col("row") - cell_of(F.col("box.south"), size), F.col("col") - cell_of(F.col("box.west"), size))
    t = t.withColumns({"area": area, "tile_id": name}).where("area > 0")
    keep = [c for c in polygons.columns if c != "polygon"]
    whole = d.where(small).select(*keep, "polygon_area", F.lit(None).cast("bigint").alias("row"), F.lit(None).cast("bigint").alias("col"), F.lit("whole").alias("tile_id"), F.col("polygon_area").alias("area"))
    return t.select(*keep, "polygon_area", "row", "col", "tile_id", "area").unionByName(whole)


def morton(x, y, bits: int):
    """Interleaved bits of two whole numbers."""
    out = F.lit(0).cast("bigint")
    for b in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, b).bitwiseAND(1), 2 * b)).bitwiseOR(F.shiftleft(F.shiftright(y, b).bitwiseAND(1), 2 * b + 1))
    return out


def adaptive_tiles(points: DataFrame, limit: int, depth: int, key: str = "plan_id", size: float = 1.0, area_cap: float | None = None, min_area: float | None = None) -> DataFrame:
    """Quadtree leaves (key, root cell, level, code) with n points: the shallowest squares under the limit and of at most area_cap; those at the
    greatest depth that still reach the limit are flagged incomplete. No square is smaller than min_area. All levels are counted in
    one pass: points are first counted at the greatest depth, and these counts are summed into every level's prefix.
    """
    least = 0 if area_cap is None else max(0, math.ceil(math.log2(size / math.sqrt(area_cap))))
    depth = depth if min_area is None else min(depth, max(0, math.floor(math.log2(size / math.sqrt(min_area)))))
    least = min(least, depth)
    scale = 1 << depth
    fine = points.select(key, cell_of(F.col("lon"), size).alias("cx"), cell_of(F.col("lat"), size).alias("cy"), F.pmod(F.floor(F.col("lon") / size * scale), F.lit(scale)).cast("bigint").alias("x"), F.pmod(F.floor(F.col("lat") / size * scale), F.lit(scale)).cast("bigint").alias("y"))
    fine = fine.withColumn("code", morton(F.col("x"), F.col("y"), depth)).groupBy(key, "cx", "cy", "code").agg(F.count("*").alias("n"))
    up = fine.withColumn("level", F.explode(F.sequence(F.lit(least), F.lit(depth)))).withColumn("prefix", F.expr(f"shiftright(code, 2 * ({depth} - level))"))
    counts = up.groupBy(key, "cx", "cy", "level", "prefix").agg(F.sum("n").alias("n"))
    above = counts.select(key, "cx", "cy", (F.col("level") + 1).alias("level"), F.col("prefix").alias("up"), F.col("n").alias("n_up"))
    d = counts.withColumn("up", F.shiftright("prefix", 2)).join(above.hint("merge"), [key, "cx", "cy", "level", "up"], "left")
    leaf = ((F.col("n") < limit) | (F.col("level") == depth)) & (F.col("n_up").isNull() | (F.col("n_up") >= limit))
    return d.where(leaf).select(key, "cx", "cy", "level", F.col("prefix").alias("code"), "n", (F.col("n") >= limit).alias("incomplete"))


def split_parts(polygons: DataFrame) -> DataFrame:
    """One row a part, with its own area and the whole's."""
    d = polygons.withColumn("whole_area", geo.polygon_area(F.col("polygon"))).select("*", F.posexplode("polygon").alias("part", "_p")).withColumn("polygon", F.array("_p")).drop("_p")
    return d.withColumn("area", geo.polygon_area(F.col("polygon")))


def tile_adjacency(tiles: DataFrame, key: str | list[str], size: float) -> DataFrame:
    """Tiles of one grid (by its key columns) that share a side, each pair once, with the side's length."""
    keys = [key] if isinstance(key, str) else list(key)
    step = F.explode(F.array(F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc"))))
    a = tiles.select(*keys, "row", "col").withColumn("s", step).select(*keys, F.col("row").alias("row1"), F.col("col").alias("col1"), (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"))
    return a.join(tiles.select(*keys, "row", "col").hint("merge"), [*keys, "row", "col"]).select(*keys, "row1", "col1", F.col("row").alias("row2"), F.col("col").alias("col2"), F.lit(float(size)).alias("shared"))


def area_stats(pieces: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """Areas by key: count, min, max, median, interpolated p10 and p90, and how many are below 0.1, 1, 5 or above 40. Areas of a key of over `most` pieces are never in one buffer."""
    few, many = by_size(pieces, [key], most)
    counts = [F.count("*").alias("n"), F.min("area").alias("area_min"), F.max("area").alias("area_max"), *(F.count_if(F.col("area") < x).alias(f"below_{str(x).replace('.', '_')}") for x in (0.1, 1, 5)), F.count_if(F.col("area") > 40).alias("above_40")]
    p = F.percentile("area", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    d = few.groupBy(key).agg(*counts, p.alias("_p")).withColumns({"p10": F.col("_p")[0], "median": F.col("_p")[1], "p90": F.col("_p")[2]}).drop("_p")
    if many is None:
        return d
    places = at_places(many, [key], "area", {"p10": "0.1 * (n - 1)", "median": "0.5 * (n - 1)", "p90": "0.9 * (n - 1)"})
    return d.unionByName(_meet(many.groupBy(key).agg(*counts), places, [key], "merge", "left"))


def coverage_audit(pieces: DataFrame, keys: list[str], outer: DataFrame | None = None, lon_lat: bool = False, unit: float = 1e-6) -> DataFrame:
    """Whether pieces cover an outer polygon once and nothing else: keys, planned, outer_area, difference, uncovered, outside, overlap, tolerance, covered.

    With `outer` (keys, polygon) the areas are those of the exact overlay of the polygons; `lon_lat` projects both to the UTM zone of the outer box's middle first. Areas
    are multiplied by `unit`: from square metres to square kilometres, in which the tolerance is max(0.01, 0.1 % of the outer area). All of difference, uncovered, outside
    and overlap must be within it. An outer polygon without pieces is uncovered; pieces without an outer polygon are outside.

    Without `outer` the pieces are rows (row, col, area, polygon_area) of tile_polygons with areas as they come: repeated tiles are overlap, and the rest is a difference of sums.
    """
    if outer is None:
        by = pieces.groupBy(*keys, "row", "col").agg(F.count("*").alias("c"), F.first("area").alias("a"), F.first("polygon_area").alias("o"))
        d = by.groupBy(*keys).agg(F.sum(F.col("a") * F.col("c")).alias("planned"), F.first("o").alias("outer_area"), F.sum((F.col("c") - 1) * F.col("a")).alias("overlap"))
        gap = F.col("outer_area") - (F.col("planned") - F.col("overlap"))
        d = d.withColumns({"uncovered": F.greatest(gap, F.lit(0.0)), "outside": F.greatest(-gap, F.lit(0.0))})
    else:
        pieces, outer = (x.select(*keys, "polygon") for x in (pieces, outer))
        if lon_lat:
            middle = outer.select(*keys, geo.bbox(F.col("polygon")).alias("b")).groupBy(*keys).agg(((F.min("b.west") + F.max("b.east")) / 2).alias("_lon"))
            middle = middle.select(*keys, geo.utm_zone(F.col("_lon")).alias("_zone"))
            meet = lambda x: _meet(x, middle, keys, "merge").select(*keys, geo.utm_polygon(F.col("polygon"), F.col("_zone")).alias("polygon"))
            stray = _meet(pieces, middle, keys, "merge", "left_anti").select(*keys, geo.utm_polygon(F.col("polygon"), geo.utm_zone(geo.bbox(F.col("polygon"))["west"])).alias("polygon"))
            pieces, outer = meet(pieces).unionByName(stray), meet(outer)
        d = overlay(pieces, outer, keys)
        d = d.select(*keys, *((F.col(c) * unit).alias(c) for c in ("planned", "outer_area", "uncovered", "outside")), (F.greatest(F.col("planned") - F.col("union_area"), F.lit(0.0)) * unit).alias("overlap"))
    d = d.withColumns({"difference": F.col("planned") - F.col("outer_area"), "tolerance": F.greatest(F.lit(0.01), F.col("outer_area") * 0.001)})
    within = [F.abs(F.col(c)) <= F.col("tolerance") for c in ("difference", "uncovered", "outside", "overlap")]
    return d.withColumn("covered", within[0] & within[1] & within[2] & within[3])


def piece_report(pieces: DataFrame) -> DataFrame:
    """Vertices, rings, parts, JSON bytes and compactness of piece polygons."""
    rings = F.flatten("polygon")
    area = geo.polygon_area(F.col("polygon"))
    around = F.aggregate(rings, F.lit(0.0), lambda a, r: a + geo.perimeter(r))
    return pieces.withColumns({"n_vertices": F.size(F.flatten(rings)), "n_rings": F.size(rings), "n_parts": F.size("polygon"), "json_bytes": F.length(F.to_json("polygon")), "compactness": geo.compactness(area, around)})


def build_rings(isochrones: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Exclusive rings of (analysis_id, range_minutes, area; edges too, if there are any): id, bounds and ring_area, the difference of cumulative areas.

    With edges (even-odd) also exclusive_area, what the polygon has outside the one before it, and nested: whether it covers the one before, up to `tolerance` times the areas
    (at least `tolerance`). Where polygons do not nest the two areas differ. The areas come from an overlay by cells, for polygons of any number of vertices.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("analysis_id").orderBy("range_minutes")
    slim = isochrones.drop("edges")
    d = slim.withColumns({"inner_minutes": F.lag("range_minutes", 1, 0).over(w), "ring_area": F.col("area") - F.coalesce(F.lag("area").over(w), F.lit(0.0))})
    if "edges" in isochrones.columns:
        keys = ["analysis_id", "range_minutes"]
        own = isochrones.select(*keys, "edges")
        after = slim.select("analysis_id", F.col("range_minutes").alias("_before"), F.lead("range_minutes").over(w).alias("range_minutes")).where("range_minutes IS NOT NULL")
        before = own.withColumnRenamed("range_minutes", "_before").join(after.hint("merge"), ["analysis_id", "_before"]).select(*keys, "edges")
        areas = overlay_areas(plain_edges(before, keys, "p").unionByName(plain_edges(own, keys, "q")), keys, parity=True)
        least = F.greatest(F.lit(tolerance), tolerance * (F.col("planned") + F.col("outer_area")))
        areas = areas.select(*keys, F.col("uncovered").alias("exclusive_area"), (F.col("outside") <= least).alias("nested"))
        d = _meet(d, areas, keys, "merge", "left").withColumns({"exclusive_area": F.coalesce("exclusive_area", F.lit(0.0)), "nested": F.coalesce("nested", F.lit(True))})
    return d.withColumn("ring_id", F.concat(F.lit("ring-"), F.col("inner_minutes").cast("string"), F.lit("-"), F.col("range_minutes").cast("string")))
