"""Spatial joins: everything meets through grid cells as an equi-join, then an exact test refines.

Cells are squares of `cell` degrees (or units), for polygons of a power of two by their size. A polygon is dealt to the cells
its bounding box covers and carries the edges that a cell needs; a point has one cell a size in use. Neither side has to fit in
memory; hot cells are left to AQE's skew handling (a plain sort-merge join that it can split).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..lineage import keep


def cell_of(v: Column, cell: float) -> Column:
    return F.floor(v / cell).cast("bigint")


def box_cells(df: DataFrame, west, south, east, north, cell: float) -> DataFrame:
    """One row for each cell (cx, cy) that a box touches."""
    return df.withColumn("cx", F.explode(F.sequence(cell_of(west, cell), cell_of(east, cell)))).withColumn("cy", F.explode(F.sequence(cell_of(south, cell), cell_of(north, cell))))


def with_edges(polygons: DataFrame) -> DataFrame:
    """Adds edges and box to rows that have a polygon column."""
    return polygons.withColumns({"edges": geo.polygon_edges(F.col("polygon")), "box": geo.bbox(F.col("polygon"))})


def edges_to_polygons(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of edges (seq, x1, y1, x2, y2) to one row a polygon with edges and box."""
    e = edges.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "x1", "y1", "x2", "y2"))), lambda s: F.struct(s["x1"].alias("x1"), s["y1"].alias("y1"), s["x2"].alias("x2"), s["y2"].alias("y2"))).alias("edges"),
        F.struct(F.min("x1").alias("west"), F.min("y1").alias("south"), F.max("x1").alias("east"), F.max("y1").alias("north")).alias("box"),
    )
    return e


def _deal_polygons(polygons: DataFrame, cell: float | None, side: int) -> DataFrame:
    """Polygon rows a cell they have area or boundary in (_level, _cx, _cy), with _edges: what a point of that cell needs.

    The cell's size is a power of two by the box, so that a polygon has about `side` cells a side, whatever its size. A cell that no
    edge comes near is inside or outside as a whole: outside ones go, inside ones carry no edges. Others carry the edges
    of their row that are not left of them.
    """
    box, level = F.col("box"), _level(cell, side)
    size = F.pow(F.lit(2.0), F.col("_level")) if cell is None else F.lit(cell)
    at = lambda a: F.floor(box[a] / F.col("_size")).cast("bigint")
    d = polygons.withColumn("_level", level).withColumn("_size", size)
    d = d.withColumn("_cx", F.explode(F.sequence(at("west"), at("east")))).withColumn("_cy", F.explode(F.sequence(at("south"), at("north"))))
    d = d.withColumns({"_x0": F.col("_cx") * F.col("_size"), "_y0": F.col("_cy") * F.col("_size")}).withColumns({"_x1": F.col("_x0") + F.col("_size"), "_y1": F.col("_y0") + F.col("_size")})
    row = F.filter("edges", lambda e: (F.greatest(e["y1"], e["y2"]) >= F.col("_y0")) & (F.least(e["y1"], e["y2"]) <= F.col("_y1")) & (F.greatest(e["x1"], e["x2"]) >= F.col("_x0")))
    d = d.withColumn("_edges", row)
    near = F.exists("_edges", lambda e: F.least(e["x1"], e["x2"]) <= F.col("_x1"))
    middle = geo.covers(F.col("_edges"), F.col("_x0") + F.col("_size") / 2, F.col("_y0") + F.col("_size") / 2)
    d = d.withColumn("_edges", F.when(near, F.col("_edges")).when(middle, F.slice("_edges", 1, 0))).where("_edges is not null")
    return d.withColumn("_whole", F.size("_edges") == 0).drop("_size", "_x0", "_y0", "_x1", "_y1", "edges")


def _level(cell: float | None, side: int) -> Column:
    box = F.col("box")
    span = F.greatest(box["east"] - box["west"], box["north"] - box["south"], F.lit(2.0**-20))
    return F.ceil(F.log2(span / side)).cast("int") if cell is None else F.lit(0)


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float | None = None, side: int = 16, on: tuple[str, ...] = ()) -> DataFrame:
    """Every pair of a point (lon, lat) and a polygon (edges, box) that covers it, boundary included. Columns named in `on` must be equal too: they are part of the join's key."""
    dealt = _deal_polygons(polygons, cell, side)
    levels = [r[0] for r in polygons.select(_level(cell, side)).distinct().collect() if r[0] is not None]  # powers of two between the smallest and the largest box
    size = F.pow(F.lit(2.0), F.col("_level")) if cell is None else F.lit(cell)
    p = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    p = p.withColumns({"_cx": F.floor(F.col("lon") / size).cast("bigint"), "_cy": F.floor(F.col("lat") / size).cast("bigint")})
    near = p.join(dealt.hint("merge"), [*on, "_level", "_cx", "_cy"]).where(F.col("_whole") | (F.col("lon").between(F.col("box.west"), F.col("box.east")) & F.col("lat").between(F.col("box.south"), F.col("box.north"))))
    return near.where(F.col("_whole") | geo.covers(F.col("_edges"), F.col("lon"), F.col("lat"))).drop("_level", "_cx", "_cy", "_edges", "_whole", "box")


def assign_rings(points: DataFrame, isochrones: DataFrame, cell: float | None = None) -> DataFrame:
    """Exclusive ring of each (analysis_id, poi_id): the smallest range whose cumulative polygon covers the point.

    No polygon difference is taken: if k is the smallest covering range then the previous polygon does not cover the
    point, so it lies in ring k, also where polygons do not nest.
    """
    hit = points_in_polygons(points.select("poi_id", "lon", "lat"), isochrones, cell)
    return hit.groupBy("analysis_id", "poi_id").agg(F.min("range_minutes").alias("outer_minutes"))


def bbox_candidates(points: DataFrame, boxes: DataFrame, cell: float = 1 / 16) -> DataFrame:
    """Pairs of points and boxes (west, south, east, north), inclusive."""
    dealt = box_cells(boxes, F.col("west"), F.col("south"), F.col("east"), F.col("north"), cell)
    p = points.withColumns({"cx": cell_of(F.col("lon"), cell), "cy": cell_of(F.col("lat"), cell)})
    return p.join(dealt.hint("merge"), ["cx", "cy"]).where(F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))).drop("cx", "cy")


def within_radius(points: DataFrame, centres: DataFrame, radii: tuple[int, ...] = (500, 1000, 2000), cell: float = 1 / 32) -> DataFrame:
    """Points within the largest radius of a centre (analysis_id, clon, clat), with the smallest radius that holds them.

    A box that reaches over the 180th meridian is two boxes; one that reaches a pole goes all the way round.
    """
    reach = math.degrees(max(radii) / geo.EARTH_M) * 1.000001
    turn = F.sin(F.radians(F.lit(reach))) / F.cos(F.radians("clat"))
    lon_reach = F.when(F.abs("clat") + reach >= 90, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), turn))) * 1.000001)
    west, east = F.col("clon") - lon_reach, F.col("clon") + lon_reach
    box = lambda a, b: F.struct(F.greatest(a, F.lit(-180.0)).alias("west"), F.least(b, F.lit(180.0)).alias("east"))
    boxes = F.when(lon_reach >= 180, F.array(box(F.lit(-180.0), F.lit(180.0)))).when(west < -180, F.array(box(west + 360, F.lit(180.0)), box(F.lit(-180.0), east))).when(east > 180, F.array(box(west, F.lit(180.0)), box(F.lit(-180.0), east - 360))).otherwise(F.array(box(west, east)))
    c = centres.withColumn("_b", F.explode(boxes)).withColumns({"west": F.col("_b.west"), "east": F.col("_b.east"), "south": F.col("clat") - reach, "north": F.col("clat") + reach}).drop("_b")
    d = bbox_candidates(points, c, cell).withColumn("distance_m", geo.haversine_m(F.col("clon"), F.col("clat"), F.col("lon"), F.col("lat")))
    level = F.lit(None).cast("int")
    for r in sorted(radii, reverse=True):
        level = F.when(F.col("distance_m") <= r, F.lit(r)).otherwise(level)
    return d.withColumn("radius_m", level).where("radius_m is not null").withColumn("ring_id", F.concat(F.lit("ring-preview-"), F.col("radius_m").cast("string"))).drop("west", "east", "south", "north")


def _near_pairs(df: DataFrame, key: str, order: str, metres: float) -> DataFrame:
    """(key, first, second, and lon and lat of both)."""
    step = metres / 96000.0
    d = df.withColumns({"cx": cell_of(F.col("lon"), step), "cy": cell_of(F.col("lat"), metres / 111000.0)})
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    b = d.withColumn("d", around).select(F.col(key).alias("key"), (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"), F.col(order).alias("second"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    a = d.select(F.col(key).alias("key"), "cx", "cy", F.col(order).alias("first"), "lon", "lat")
    near = a.join(b.hint("merge"), ["key", "cx", "cy"]).where(F.col("first") < F.col("second"))
    return near.where(F.hypot((F.col("lon") - F.col("lon2")) * 96000.0, (F.col("lat") - F.col("lat2")) * 111000.0) <= metres).select("key", "first", "second", "lon", "lat", "lon2", "lat2")


def near_pairs(df: DataFrame, key: str, order: str, metres: float = 5.0) -> DataFrame:
    """(first, second): rows of equal key at planar distance metres or less, first before second in order."""
    return _near_pairs(df, key, order, metres).select("key", "first", "second")


class _Near:
    """Points in squares of 1.4 times `metres`, cut in four: two points of one quarter are always near."""

    def __init__(self, metres: float) -> None:
        self.metres, self.squares, self.quarters = metres, {}, set()

    def add(self, x: float, y: float, square: tuple, quarter: tuple) -> None:
        self.squares.setdefault(square, []).append((x, y))
        self.quarters.add(quarter)

    def has(self, x: float, y: float, square: tuple, quarter: tuple) -> bool:
        """Whether a point lies within metres of this one."""
        if quarter in self.quarters:
            return True
        if not self.squares:
            return False
        i, j = square
        for cell in ((i, j), (i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1), (i - 1, j - 1), (i - 1, j + 1), (i + 1, j - 1), (i + 1, j + 1)):
            points = self.squares.get(cell, ())
            for at, (px, py) in enumerate(points):
                if math.hypot((px - x) * 96000.0, (py - y) * 111000.0) <= self.metres:
                    # A point that is met goes to the front, so that a full square is not read through again and again.
                    points[0], points[at] = points[at], points[0]
                    return True
        return False


def _walk(metres: float, everything: bool, deep: bool):
    """Rows (key, sx, sy, row, lon, lat, sure, own) sorted by key, square and row -> (key, row, lon, lat, gone, depth) of a square's own rows that are not sure: those that go, or (everything)
    all, with a null where rows of other squares decide first.

    Only rows that stay or wait are held, of one key and square, and a row is held against those around it, so no pair is made. Rows of equal order are decided together. depth, if asked
    for: decisions in a row, for which all rows are held.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def changes(column):
            if pa.types.is_struct(column.type):
                return np.logical_or.reduce([changes(c) for c in column.flatten()])
            c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            return pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), False).to_numpy(zero_copy_only=False) | (c.slice(1).is_null().to_numpy(zero_copy_only=False) != c.slice(0, len(c) - 1).is_null().to_numpy(zero_copy_only=False))

        stay = wait = None
        past: list[tuple[float, float, int]] = []

        def decide(unit):
            """The fate of rows of one order: [(x, y, square, quarter, sure, own)]; each is (gone, depth)."""
            depth = 0
            if deep:
                before = [z for x, y, *_ in unit for px, py, z in past if math.hypot((px - x) * 96000.0, (py - y) * 111000.0) <= metres]
                depth = 1 + max(before) if before else 0
            free = [u for u in unit if not u[4]]
            gone = any(stay.has(*u[:4]) for u in free)
            open_ = not gone and any(not u[5] or wait.has(*u[:4]) for u in free)
            for u in unit:
                if u[4] or not gone:
                    (wait if open_ and not u[4] else stay).add(*u[:4])
                if deep:
                    past.append((u[0], u[1], 0 if u[4] else depth))
            return (None if open_ else gone), depth

        def decided(table, first):
            """Fates of all rows of a table that begins with a new key or square (first), or a new row."""
            nonlocal stay, wait, past
            n = table.num_rows
            group = np.concatenate([[first], np.logical_or.reduce([changes(table.column(i)) for i in range(3)])])
            row = np.concatenate([[True], changes(table.column(3))]) | group
            x, y = (table.column(i).to_numpy() for i in (4, 5))
            q = [np.floor(v * k / (0.7 * metres)) for v, k in ((x, 96000.0), (y, 111000.0))]
            squares, quarters = zip(*(np.floor(v / 2).tolist() for v in q), strict=True), zip(*(v.tolist() for v in q), strict=True)
            rows = list(zip(x.tolist(), y.tolist(), squares, quarters, table.column(6).to_pylist(), table.column(7).to_pylist(), strict=True))
            starts = np.flatnonzero(row).tolist()
            gone, depth = [None] * n, [0] * n
            for at, end in zip(starts, [*starts[1:], n], strict=True):
                if group[at]:
                    stay, wait, past = _Near(metres), _Near(metres), []
                fate = decide(rows[at:end])
                gone[at:end], depth[at:end] = [fate[0]] * (end - at), [fate[1]] * (end - at)
            verdict = pa.array(gone, pa.bool_())
            mine = pc.and_(table.column(7), pc.invert(table.column(6)))
            out = pa.table([table.column(i) for i in (0, 3, 4, 5)] + [verdict, pa.array(depth, pa.int64())], ["key", "row", "lon", "lat", "gone", "depth"])
            yield from out.filter(mine if everything or deep else pc.and_(mine, verdict)).combine_chunks().to_batches()

        # The last row of a batch may have others of its order in the next one.
        held, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            new = np.flatnonzero(np.logical_or.reduce([changes(table.column(i)) for i in range(4)]))
            if not len(new):
                held = table
                continue
            end = int(new[-1]) + 1
            yield from decided(table.slice(0, end), first)
            held = table.slice(end)
            first = any(bool(changes(table.column(i).slice(end - 1, 2))[0]) for i in range(3))
        if held is not None:
            yield from decided(held, first)

    return run


def dedupe_near(df: DataFrame, name: str = "name", order: str = "pos", metres: float = 5.0, rounds: int | None = None, fixed: Column | None = None, most: int = 1 << 18) -> DataFrame:
    """Keep-first near-duplicates: in order, a row goes if an earlier row that stays is within metres and has its name.

    Not a transitive closure: if A-B and B-C are close and A-C are not, B goes and C stays. No pairs are made: the rows of a name are walked in order in one task, against the rows around them that stay. A name
    of over `most` rows (whose order must be unique) is dealt by squares with the rows around their borders, each walked as far as rows of other squares allow; rows that wait for these
    go on to the next round with those that stay near them, a few squares or one name again. With `rounds`, more decisions than that, each waiting for the one before, raise an
    error. Rows that are `fixed` stay whatever is before them.
    """
    d = df.withColumn("_key", text.name_key(F.col(name)))
    sure = F.lit(False) if fixed is None else F.coalesce(fixed, F.lit(False))
    real = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < math.inf)
    # Rows without a name, a place in the order or coordinates are near to none.
    left = d.where(F.col("_key").isNotNull() & F.col(order).isNotNull() & real("lon") & real("lat")).select(F.col("_key").alias("key"), F.col(order).alias("row"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), sure.alias("sure"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = left.schema["row"].dataType.simpleString()
    x, y = F.col("lon") * 96000.0, F.col("lat") * 111000.0
    gone, done, whole = None, 0, False
    while not whole:
        large = keep(left.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most), "near-large")
        whole = large.isEmpty()
        if whole:
            dealt = left.select("key", F.lit(0).cast("bigint").alias("sx"), F.lit(0).cast("bigint").alias("sy"), "row", "lon", "lat", "sure", F.lit(True).alias("own"))
        else:
            # Squares get half as wide as rows quadruple, down to four times the distance; a row goes to its own square and those it comes near to.
            edge = F.when(F.col("n").isNotNull(), F.greatest(F.lit(4.0 * metres), F.lit(2048.0 * metres) / F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / most) / 2))))
            at = lambda v, by=0.0: F.coalesce(F.floor((v + by * metres) / F.col("edge")), F.lit(0)).cast("bigint")
            span = lambda v, c: F.explode(F.sequence(at(v, -1.001), at(v, 1.001))).alias(c)
            dealt = left.join(large.hint("shuffle_hash"), "key", "left").withColumn("edge", edge).select("*", span(x, "sx")).select("*", span(y, "sy"))
            dealt = dealt.select("key", "sx", "sy", "row", "lon", "lat", "sure", ((F.col("sx") == at(x)) & (F.col("sy") == at(y))).alias("own"))
        dealt = dealt.repartition(parts, "key", "sx", "sy").sortWithinPartitions("key", "sx", "sy", "row")
        settled = dealt.mapInArrow(_walk(metres, not whole, rounds is not None), f"key string, row {kind}, lon double, lat double, gone boolean, depth bigint")
        if not whole or rounds is not None:
            settled = keep(settled, "near-settled")
        if rounds is not None:
            done += settled.agg(F.max("depth")).first()[0] or 0
            if done > rounds:
                raise ValueError(f"near-duplicates are left after {rounds} rounds")
        out = settled.where("gone").select(F.col("row").alias("_gone"))
        gone = out if gone is None else gone.union(out)
        if whole:
            break
        waiting = settled.where("gone is null")
        if waiting.isEmpty():
            break
        # Rows that stay go on only if a row that waits is around.
        cell = {"cx": F.floor(x / (1.01 * metres)), "cy": F.floor(y / (1.01 * metres))}
        around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
        cells = waiting.select("key", *(c.alias(k) for k, c in cell.items()), around.alias("z")).select("key", (F.col("cx") + F.col("z.i")).alias("cx"), (F.col("cy") + F.col("z.j")).alias("cy")).distinct()
        rows = lambda d, s: d.select("key", "row", "lon", "lat", F.lit(s).alias("sure"))
        staying = rows(left.where("sure"), True).unionByName(rows(settled.where("not gone"), True)).withColumns(cell)
        staying = staying.join(cells.hint("merge"), ["key", "cx", "cy"], "left_semi").drop("cx", "cy")
        left = keep(staying.unionByName(rows(waiting, False)), "near-rows")
    return d.drop("_key").join(gone.hint("merge"), d[order] == F.col("_gone"), "left_anti")


def rect_overlaps(nodes: DataFrame, cell: float = 64.0) -> DataFrame:
    """Pairs of label rectangles (centre x, y, width, height) of one layout that overlap, each once."""
    n = nodes.withColumns({"l": F.col("x") - F.col("width") / 2, "r": F.col("x") + F.col("width") / 2, "t": F.col("y") - F.col("height") / 2, "b": F.col("y") + F.col("height") / 2}).select("layout_id", "node_id", "l", "r", "t", "b")
    d = box_cells(n, F.col("l"), F.col("t"), F.col("r"), F.col("b"), cell)
    other = d.select("layout_id", "cx", "cy", *(F.col(c).alias(f"{c}2") for c in ("node_id", "l", "r", "t", "b")))
    hit = d.join(other.hint("merge"), ["layout_id", "cx", "cy"]).where("node_id < node_id2 and l < r2 and l2 < r and t < b2 and t2 < b")
    # A pair that shares several cells is reported by the one that holds the overlap's corner.
    return hit.where((F.col("cx") == cell_of(F.greatest("l", "l2"), cell)) & (F.col("cy") == cell_of(F.greatest("t", "t2"), cell))).select("layout_id", F.col("node_id").alias("a"), F.col("node_id2").alias("b"))


def nearest_gap(nodes: DataFrame, keys: tuple[str, ...] = ("layout_id",), cell: float = 64.0) -> DataFrame:
    """Smallest rectangle gap from each node to another of its keys (for example layout and ring); null if alone.

    Nodes are looked for in cells of centres around a node, first of `cell` or the mean spacing, then of four times that and so on, until each node has found
    one nearer than its reach could have missed. A cell is a join key, so a layout of any size spreads over tasks; nodes
    that have found theirs leave the next round. A gap of centre distance d is at least d less both half sizes.
    """
    n = nodes.select(*keys, "node_id", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")))
    size = n.groupBy(*keys).agg(F.max(F.greatest("width", "height")).alias("_most"), F.count("*").alias("_n"), F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("_far"))
    todo = keep(n.join(size.hint("merge"), list(keys)), "gap-nodes")
    alone = todo.where("_n = 1").select(*keys, "node_id", F.lit(None).cast("double").alias("gap"))
    others, todo, done = n, todo.where("_n > 1"), []
    most, far = todo.agg(F.max("_n"), F.max("_far")).first()
    cell = max(cell, 4 * (far or 0.0) / math.sqrt(most or 1))  # a cell of the largest keys then holds a few nodes
    while not todo.isEmpty():
        b = others.select(*keys, cell_of(F.col("x"), cell).alias("_cx"), cell_of(F.col("y"), cell).alias("_cy"), *(F.col(c).alias(f"{c}2") for c in ("node_id", "x", "y", "width", "height")))
        near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
        a = todo.withColumn("_d", near).withColumns({"_cx": cell_of(F.col("x"), cell) + F.col("_d.i"), "_cy": cell_of(F.col("y"), cell) + F.col("_d.j")}).drop("_d")
        gx = F.greatest(F.lit(0.0), F.abs(F.col("x") - F.col("x2")) - (F.col("width") + F.col("width2")) / 2)
        gy = F.greatest(F.lit(0.0), F.abs(F.col("y") - F.col("y2")) - (F.col("height") + F.col("height2")) / 2)
        j = a.join(b.hint("merge"), [*keys, "_cx", "_cy"]).groupBy(*keys, "node_id").agg(F.min(F.when(F.col("node_id") != F.col("node_id2"), F.hypot(gx, gy))).alias("gap"))
        # Every node whose centre is within `cell` along both axes was met, so one that was not is at least cell - sizes away.
        d = keep(todo.join(j.hint("merge"), [*keys, "node_id"], "left"), "gap-found")
        sure = F.coalesce(F.col("gap") <= cell - (F.greatest("width", "height") + F.col("_most")) / 2, F.lit(False)) | (F.lit(cell) > 2 * F.col("_far"))
        done.append(d.where(sure).select(*keys, "node_id", "gap"))
        todo = d.where(~sure).drop("gap")
        cell *= 4
    out = alone
    for d in done:
        out = out.unionByName(d)
    return out


def ring_bounds(isochrones: DataFrame) -> DataFrame:
    """Adds inner_minutes (previous range, first 0) and ring_id to (analysis_id, range_minutes)."""
    w = Window.partitionBy("analysis_id").orderBy("range_minutes")
    d = isochrones.withColumn("inner_minutes", F.lag("range_minutes", 1, 0).over(w))
    return d.withColumn("ring_id", F.concat(F.lit("ring-"), F.col("inner_minutes").cast("string"), F.lit("-"), F.col("range_minutes").cast("string")))


def ring_counts(rings: DataFrame, assigned: DataFrame) -> DataFrame:
    """poi_count of every ring (analysis_id, outer_minutes), 0 where it is empty."""
    n = assigned.groupBy("analysis_id", "outer_minutes").count()
    return rings.join(n.hint("merge"), ["analysis_id", "outer_minutes"], "left").withColumn("poi_count", F.coalesce("count", F.lit(0))).drop("count")


def candidate_guard(candidates: DataFrame, limit: int, key: str = "analysis_id") -> DataFrame:
    """Adds status: candidate-limit for all rows of an analysis with more than limit of them, else ok. Counts are the hashed side, so an analysis's rows pass by unsorted."""
    n = candidates.groupBy(key).agg(F.count("*").alias("_n"))
    return candidates.join(n.hint("shuffle_hash"), key).withColumn("status", F.when(F.col("_n") > limit, "candidate-limit").otherwise("ok")).drop("_n")
