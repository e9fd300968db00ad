"""Piece plans in metres: polygons clipped to a grid and split until small (numpy over the rings of a batch), and which pieces share a boundary."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..lineage import keep
from .overlay import _meet
from .spatial import cell_of

#: Areas in square metres up to which a polygon is one piece, and the tolerance of that bound.
SAFE_AREA, AREA_EPSILON = 45e6, 1.0


def _clip(x, y, count, bounds):
    """Vertices (x, y) of rings with `count` vertices each, cut along the four sides of each ring's box (west, south, east, north) in turn; the new x, y and counts.

    Vertices on a side lie on it exactly.
    """
    for axis, sign, limit in ((0, -1.0, bounds[0]), (0, 1.0, bounds[2]), (1, -1.0, bounds[1]), (1, 1.0, bounds[3])):
        at = np.repeat(limit, count)
        far = sign * (y if axis else x) - sign * at
        inside = far <= 0
        if inside.all():
            continue
        after = _next(count)
        crosses = inside != inside[after]
        put = np.cumsum(inside + crosses.astype(np.int64))
        total = int(put[-1]) if len(put) else 0
        i, j = np.flatnonzero(crosses), after[crosses]
        t = far[i] / (far[i] - far[j])
        new = []
        for k, v in enumerate((x, y)):
            out = np.empty(total)
            out[put[inside] - 1 - crosses[inside]] = v[inside]
            out[put[i] - 1] = at[i] if k == axis else v[i] + t * (v[j] - v[i])
            new.append(out)
        ends = np.concatenate([[0], put])[np.concatenate([[0], np.cumsum(count)])]
        (x, y), count = new, np.diff(ends)
    return x, y, count


def _next(count):
    """The index of the vertex after each one in its ring."""
    ends = np.cumsum(count)
    after = np.arange(1, (int(ends[-1]) if len(ends) else 0) + 1)
    some = count > 0
    after[ends[some] - 1] = (ends - count)[some]
    return after


def _ring_areas(x, y, count):
    """Shoelace areas without sign, taken from the first vertex; 0 below three vertices. Terms are added in order."""
    after, ring = _next(count), np.repeat(np.arange(len(count)), count)
    first = np.repeat((np.cumsum(count) - count), count)
    dx, dy = x - x[first], y - y[first]
    terms = np.stack([dx * dy[after], -(dx[after] * dy)], axis=1).ravel()
    return np.where(count > 2, np.abs(np.bincount(np.repeat(ring, 2), terms, len(count)) / 2), 0.0)


def _ragged(start, count):
    """The numbers start .. start + count - 1 of each entry, one after the other."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - start, count)


def _clip_rows(kind: str, grid: float, most: int = 1 << 17):
    """Batches whose last columns are piece_id, level, polygon -> a row for each grid cell (kind grid) or quarter (kind quarter) of its polygon's box that has area, with area.

    Polygons are copied for a slice of boxes at a time, some `most` vertices or one box.
    """

    def boxes(x, y, row, n):
        """For each box: its row, number of row and column, and bounds."""
        low = [np.full(n, np.inf) for _ in range(2)]
        high = [np.full(n, -np.inf) for _ in range(2)]
        for k, v in enumerate((x, y)):
            np.fmin.at(low[k], row, v)
            np.fmax.at(high[k], row, v)
        (w, s), (e, north) = low, high
        real = np.flatnonzero((w <= e) & (s <= north))
        if not all(np.isfinite(v[real]).all() for v in (w, s, e, north)):
            raise ValueError("a polygon has an infinite coordinate")
        if kind == "quarter":
            r, i = np.repeat(real, 4), np.tile(np.arange(4), len(real))
            up, right = i // 2, i % 2
            mx, my = (w[r] + e[r]) / 2, (s[r] + north[r]) / 2
            return r, up, right, [np.where(right, mx, w[r]), np.where(up, my, s[r]), np.where(right, e[r], mx), np.where(up, north[r], my)]
        at = lambda v: np.floor(v[real] / grid).astype(np.int64)
        c0, r0 = at(w), at(s)
        wide, n_cells = at(e) - c0 + 1, (at(e) - c0 + 1) * (at(north) - r0 + 1)
        r, i = np.repeat(real, n_cells), _ragged(np.zeros(len(real), np.int64), n_cells)
        up, right = i // np.repeat(wide, n_cells), i % np.repeat(wide, n_cells)
        col, line = np.repeat(c0, n_cells) + right, np.repeat(r0, n_cells) + up
        return r, up, right, [col * grid, line * grid, (col + 1) * grid, (line + 1) * grid]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            poly = batch.column("polygon")
            parts = poly.values
            rings = parts.values
            points = rings.values
            o1, o2, o3 = (np.asarray(a.offsets, dtype=np.int64) for a in (poly, parts, rings))
            x, y = (points.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y"))
            # Rings of a row follow each other: row -> its rings, ring -> its vertices.
            ring_at, n_rings = o2[o1[:-1]], o2[o1[1:]] - o2[o1[:-1]]
            n_points = o3[o2[o1[1:]]] - o3[o2[o1[:-1]]]
            own = _ragged(o3[o2[o1[:-1]]], n_points)
            row, up, right, bounds = boxes(x[own], y[own], np.repeat(np.arange(len(n_points)), n_points), len(n_points))
            # A ring is a shell if a part begins with it.
            part = np.repeat(np.arange(len(o2) - 1), np.diff(o2))
            size = np.cumsum(n_points[row])
            start = 0
            while start < len(row):
                end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most, "right")))
                cut, start = slice(start, end), end
                r = row[cut]
                ring = _ragged(ring_at[r], n_rings[r])
                box = np.repeat(np.arange(len(r)), n_rings[r])
                count = np.diff(o3)[ring]
                v = _ragged(o3[ring], count)
                cx, cy, count = _clip(x[v], y[v], count, [b[cut][box] for b in bounds])
                area = _ring_areas(cx, cy, count)
                key = np.stack([box, part[ring]])
                head = np.ones(len(ring), bool)
                head[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
                p = np.cumsum(head) - 1
                shell, n_parts = area[head], int(head.sum())
                holes = np.bincount(p[~head], area[~head], n_parts)
                good = shell > 0
                total = np.bincount(box[head][good], (shell - holes)[good], len(r))
                full = total > 0
                keep_ring = good[p] & full[box] & (count > 2)
                keep_part = good & full[box[head]]
                kv = np.repeat(keep_ring, count)
                offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                flat = pa.StructArray.from_arrays([pa.array(cx[kv]), pa.array(cy[kv])], ["x", "y"])
                out = pa.ListArray.from_arrays(offsets(count[keep_ring]), flat)
                out = pa.ListArray.from_arrays(offsets(np.bincount(p[keep_ring], minlength=n_parts)[keep_part]), out)
                out = pa.ListArray.from_arrays(offsets(np.bincount(box[head][keep_part], minlength=len(r))[full]), out)
                base = batch.select(batch.schema.names[:-3]).take(pa.array(r[full]))
                ids = zip(batch.column("piece_id").take(pa.array(r[full])).to_pylist(), up[cut][full].tolist(), right[cut][full].tolist(), strict=True)
                names = [f"{a}-{i}{j}" if kind == "quarter" else f"cell-{i:04d}-{j:04d}" for a, i, j in ids]
                level = np.asarray(batch.column("level"))[r[full]] + (kind == "quarter")
                if len(names):
                    yield pa.RecordBatch.from_arrays([*base.columns, pa.array(names, pa.string()), pa.array(level, pa.int32()), out, pa.array(total[full])], [*base.schema.names, "piece_id", "level", "polygon", "area"])

    return run


#: Polygons as they go to numpy.
_POLYGON = "array<array<array<struct<x:double,y:double>>>>"


def _cut(d: DataFrame, keys: list[str], kind: str, grid: float = 0.0) -> DataFrame:
    """keys, piece_id, level, polygon, area: d (keys, piece_id, level, polygon) cut by boxes, see _clip_rows. A ring that leaves its box and comes back
    stays one ring, whose extra edges run along the box's sides there and back and cancel; parts and boxes without area go."""
    if d.schema["polygon"].dataType.simpleString() != _POLYGON:
        vertex = lambda v: F.struct(v["x"].cast("double").alias("x"), v["y"].cast("double").alias("y"))
        d = d.withColumn("polygon", F.transform("polygon", lambda p: F.transform(p, lambda r: F.transform(r, vertex))))
    types = T.StructType([d.schema[k] for k in keys])
    out = T.StructType([*types.fields, *T.StructType.fromDDL(f"piece_id string, level int, polygon {_POLYGON}, area double").fields])
    return d.select(*keys, "piece_id", "level", "polygon").mapInArrow(_clip_rows(kind, float(grid)), out)


def grid_pieces(polygons: DataFrame, keys: list[str], grid: float, whole: float | None = SAFE_AREA) -> DataFrame:
    """keys, piece_id, level 0, polygon, area: planar polygons in metres, clipped to a grid anchored at whole numbers of `grid`; ids cell-rrrr-cccc from the polygon's
    south-west cell. A polygon of at most `whole` (no None) is one piece named `whole`. Null and empty polygons have none."""
    # A small file of many polygons is one task: they are dealt by key first.
    parts = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = polygons.select(*keys, "polygon").repartition(parts, *keys).where(F.size("polygon") > 0).withColumn("area", geo.polygon_area(F.col("polygon")))
    small = F.lit(False) if whole is None else F.col("area") <= whole + AREA_EPSILON
    one = d.where(small).where("area > 0").select(*keys, F.lit("whole").alias("piece_id"), F.lit(0).alias("level"), "polygon", "area")
    return one.unionByName(_cut(d.where(~small).withColumns({"piece_id": F.lit(""), "level": F.lit(0)}), keys, "grid", grid))


def quarter(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """The four parts of each piece by the middle lines of its own box, with ids -rc; parts without area go. Other columns are dropped."""
    return _cut(pieces, keys, "quarter")


def plan_pieces(polygons: DataFrame, keys: list[str], grid: float, cap: float = SAFE_AREA, depth: int = 2, points: DataFrame | None = None, limit: int | None = None, least: float = 0.0, whole: float | None = SAFE_AREA) -> DataFrame:
    """keys, piece_id, level, polygon, area, n_points, incomplete: pieces of at most `cap` square metres with fewer than `limit` points.

    polygons: planar, in metres, one a key. Pieces of grid_pieces over the cap, or with `limit` points or more (points: keys, x, y), are quartered, again and again until `depth`,
    or until a quarter would have less than `least` on average; those still over a bound are flagged incomplete. A point counts in the piece whose
    box has it; on a middle line it belongs to the upper or right part. Each level is one clip of the pieces that are left, all keys at once.
    """
    cut = keep(grid_pieces(polygons, keys, grid, whole), "pieces")
    counted = points is not None and limit is not None
    at = None
    if counted:
        boxes = polygons.select(*keys, geo.bbox(F.col("polygon")).alias("_b"), geo.polygon_area(F.col("polygon")).alias("_a"))
        at = _meet(points.select(*keys, "x", "y"), boxes, keys, "shuffle_hash").where("x >= _b.west AND x <= _b.east AND y >= _b.south AND y <= _b.north")
        name = F.format_string("cell-%04d-%04d", cell_of(F.col("y"), grid) - cell_of(F.col("_b.south"), grid), cell_of(F.col("x"), grid) - cell_of(F.col("_b.west"), grid))
        one = F.lit(False) if whole is None else F.col("_a") <= whole + AREA_EPSILON
        at = at.select(*keys, "x", "y", F.when(one, F.lit("whole")).otherwise(name).alias("piece_id"))
    done = None
    for level in range(depth + 1):
        if counted:
            n = at.groupBy(*keys, "piece_id").agg(F.count("*").alias("n_points"))
            cut = keep(_meet(cut, n, [*keys, "piece_id"], "shuffle_hash", "left").na.fill(0, ["n_points"]), "pieces-counted")
        else:
            cut = cut.withColumn("n_points", F.lit(None).cast("bigint"))
        over = (F.col("area") > cap + AREA_EPSILON) | (F.coalesce(F.col("n_points") >= limit, F.lit(False)) if counted else F.lit(False))
        split = over & (F.col("area") / 4 >= least) & F.lit(level < depth)
        rest = cut.where(~split).withColumn("incomplete", over.cast("boolean"))
        done = rest if done is None else done.unionByName(rest)
        cut = cut.where(split)
        if level == depth or cut.isEmpty():
            break
        if counted:
            middle = cut.select(*keys, "piece_id", geo.bbox(F.col("polygon")).alias("_b"))
            at = _meet(at, middle, [*keys, "piece_id"], "shuffle_hash")
            down = F.concat(F.col("piece_id"), F.lit("-"), F.when(F.col("y") >= (F.col("_b.south") + F.col("_b.north")) / 2, "1").otherwise("0"), F.when(F.col("x") >= (F.col("_b.west") + F.col("_b.east")) / 2, "1").otherwise("0"))
            at = keep(at.select(*keys, "x", "y", down.alias("piece_id")), "pieces-points")
        cut = keep(quarter(cut, keys), "pieces")
    return done


def _edge_rows(pieces: DataFrame, keys: list[str], tolerance: float, stretch: float) -> tuple[DataFrame, DataFrame]:
    """Edges by the step of direction (dir), distance (row) and stretch (k) they lie in, with a_ before their columns; and by all steps they may meet another one in, with b_."""
    rings = pieces.select(*keys, "piece_id", "area", F.explode("polygon").alias("_part")).select(*keys, "piece_id", "area", F.posexplode("_part").alias("_i", "_r"))
    turn = F.signum(geo.signed_area(F.col("_r"))) * F.when(F.col("_i") == 0, 1).otherwise(-1)
    e = rings.select(*keys, "piece_id", "area", turn.alias("turn"), F.explode(geo.ring_edges(F.col("_r"))).alias("e")).where("e.x1 <> e.x2 OR e.y1 <> e.y2")
    forward = F.expr("e.x2 > e.x1 OR (e.x2 = e.x1 AND e.y2 > e.y1)")
    e = e.withColumns({"sign": F.when(forward, F.col("turn")).otherwise(-F.col("turn")), "len": F.expr("hypot(e.x2 - e.x1, e.y2 - e.y1)")})
    e = e.withColumns({"ux": F.expr("CASE WHEN e.x2 > e.x1 OR (e.x2 = e.x1 AND e.y2 > e.y1) THEN 1 ELSE -1 END * (e.x2 - e.x1) / len"), "uy": F.expr("CASE WHEN e.x2 > e.x1 OR (e.x2 = e.x1 AND e.y2 > e.y1) THEN 1 ELSE -1 END * (e.y2 - e.y1) / len")})
    e = e.withColumns({"off": F.expr("ux * e.y1 - uy * e.x1"), "s1": F.expr("least(ux * e.x1 + uy * e.y1, ux * e.x2 + uy * e.y2)"), "s2": F.expr("greatest(ux * e.x1 + uy * e.y1, ux * e.x2 + uy * e.y2)")})
    # Steps are moved so that upright and level edges at round distances lie inside one. The direction is an angle, where straight up and straight down are one.
    at = {"dir": (F.atan2("uy", "ux"), 1e-5), "row": (F.col("off"), tolerance)}
    step = lambda name, by=0.0: F.floor((at[name][0] + by * at[name][1]) / (100 * at[name][1]) + 0.37)
    e = e.withColumn("k", F.explode(F.sequence(F.floor(F.col("s1") / stretch), F.floor(F.col("s2") / stretch))))
    cols = ["piece_id", "area", "sign", "ux", "uy", "off", "s1", "s2"]
    one = e.select(*keys, *(F.col(c).alias(f"a_{c}") for c in cols), step("dir").alias("dir"), step("row").alias("row"), "k")
    # A hair more than the difference, for rounding on the way.
    both = lambda name: F.explode(F.sequence(step(name, -1.001), step(name, 1.001))).alias(name)
    two = e.select(*keys, *cols, "k", both("dir")).select(*keys, *(F.col(c).alias(f"b_{c}") for c in cols), "k", "dir", both("row"))
    return one, two


def piece_adjacency(pieces: DataFrame, keys: list[str], cap: float = SAFE_AREA, tolerance: float = 0.01, stretch: float = 4096.0) -> DataFrame:
    """keys, left_id, right_id (left_id < right_id), shared, union_area, merge_allowed: pieces (piece_id, polygon, area; planar, in metres, not overlapping) with a common boundary
    longer than `tolerance`, of any shapes and levels.

    Edges meet on their line: by direction, distance from the origin, and stretches along the line, so neither a long line nor a large key is one group. Steps of direction and distance are
    100 times what edges may differ by, and an edge goes to a second step only if it lies that near to it. The shared length is the overlap of edges that run in opposite directions,
    less that of edges in the same one: a ring that runs along a side and back shares nothing there. Two pieces may merge if their union has at most `cap` and they meet along a line.
    """
    one, two = _edge_rows(pieces, keys, tolerance, stretch)
    met = _meet(one, two, [*keys, "dir", "row", "k"], "merge").where("a_piece_id < b_piece_id")
    same = F.expr(f"abs(a_off - b_off) <= {tolerance} AND abs(a_ux * b_uy - a_uy * b_ux) <= 1e-5")
    lo, hi = F.greatest("a_s1", "b_s1", F.col("k") * stretch), F.least("a_s2", "b_s2", (F.col("k") + 1) * stretch)
    met = met.where(same).withColumn("o", F.greatest(hi - lo, F.lit(0.0)) * -F.col("a_sign") * F.col("b_sign"))
    pairs = met.groupBy(*keys, F.col("a_piece_id").alias("left_id"), F.col("b_piece_id").alias("right_id")).agg(F.sum("o").alias("shared"), (F.max("a_area") + F.max("b_area")).alias("union_area")).where(F.col("shared") > tolerance)
    return pairs.select(*keys, "left_id", "right_id", "shared", "union_area", (F.col("union_area") <= cap + AREA_EPSILON).alias("merge_allowed"))


def fragmentation(pieces: DataFrame) -> DataFrame:
    """Adds vertices, perimeter, compactness, box_share (area over that of the box; null for a box without area), holes and parts to pieces."""
    rings = F.flatten("polygon")
    b = geo.bbox(F.col("polygon"))
    around = F.aggregate(rings, F.lit(0.0), lambda a, r: a + geo.perimeter(r))
    box = (b["east"] - b["west"]) * (b["north"] - b["south"])
    holes = F.aggregate("polygon", F.lit(0), lambda a, p: a + F.greatest(F.size(p) - 1, F.lit(0)))
    area = geo.polygon_area(F.col("polygon"))
    return pieces.withColumns({"vertices": F.size(F.flatten(rings)), "perimeter": around, "compactness": geo.compactness(area, around), "box_share": F.when(box > 0, area / box), "holes": holes, "parts": F.size("polygon")})
