"""Exact areas of polygon overlays by key: how often a point is covered by pieces, and whether an outer polygon covers it.

Every polygon becomes edges with a step: how its coverage changes to the right of the edge. A cell (at first a key's bounding box) has the edges inside it, and what
lies left of it as steps in y at its left side, where closed polygons cancel vertex by vertex. Cells with many edges are split, their rows clipped by plain
expressions and summed again, until all are small. A small cell is swept in strips between the heights of its ends, steps and crossings: inside a
strip edges keep their order, so areas are height times middle width. Sums by key follow. Rows are edges and cells, so neither a polygon of many vertices
nor a key of many pieces meets in one task, and no Python runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..lineage import keep

#: Edges of a cell that is swept; splits in a row at most (a cell is then 4**-LEVELS of its key's box).
EDGES, LEVELS = 12, 20
CELL = ["cl", "cb", "cw", "ch"]
AREAS = ("planned", "outer_area", "union_area", "uncovered", "outside")


def region_edges(polygons: DataFrame, keys: list[str], covers: str) -> DataFrame:
    """keys, ax, ay, bx, by (ay < by), p, q: edges of all rings, with the step in `covers` (p or q). Shells and holes may run either way; null polygons have none."""
    rings = polygons.select(*keys, F.explode("polygon").alias("_part")).select(*keys, F.posexplode("_part").alias("_i", "_ring"))
    turn = F.signum(geo.signed_area(F.col("_ring"))) * F.when(F.col("_i") == 0, 1).otherwise(-1)
    e = rings.select(*keys, turn.alias("_turn"), F.explode(geo.ring_edges(F.col("_ring"))).alias("e")).where("e.y1 <> e.y2")
    up = F.col("e.y2") > F.col("e.y1")
    step = F.when(up, -F.col("_turn")).otherwise(F.col("_turn")).cast("bigint")
    return _upward(e, keys, step, covers)


def plain_edges(rows: DataFrame, keys: list[str], covers: str) -> DataFrame:
    """The same of a column `edges` without rings: for parity, where each edge changes inside to outside."""
    return _upward(rows.select(*keys, F.explode("edges").alias("e")).where("e.y1 <> e.y2"), keys, F.lit(1).cast("bigint"), covers)


def _upward(e: DataFrame, keys: list[str], step, covers: str) -> DataFrame:
    up = F.col("e.y2") > F.col("e.y1")
    ends = [F.when(up, F.col(f"e.{a}")).otherwise(F.col(f"e.{b}")).alias(n) for n, a, b in (("ax", "x1", "x2"), ("ay", "y1", "y2"), ("bx", "x2", "x1"), ("by", "y2", "y1"))]
    none = F.lit(0).cast("bigint")
    return e.select(*keys, *ends, *((step if c == covers else none).alias(c) for c in ("p", "q")))


def _summed(rows: DataFrame, keys: list[str], parity: bool) -> DataFrame:
    """Equal edges, and steps at one height, as one row; those that cancel go."""
    total = lambda c: (F.pmod(F.sum(c), F.lit(2)) if parity else F.sum(c)).alias(c)
    return rows.groupBy(*keys, *CELL, "edge", "ax", "ay", "bx", "by").agg(total("p"), total("q")).where("p <> 0 OR q <> 0")


def _split(rows: DataFrame, keys: list[str], parity: bool) -> DataFrame:
    """Rows of cells with column f -> rows of their f x f cells."""
    clamp = lambda v: f"CAST(greatest(0, least(f - 1, floor({v}))) AS INT)"
    back = 1 if parity else -1
    d = rows.withColumns({"w": F.expr("cw / f"), "h": F.expr("ch / f")})
    d = d.withColumns({"r0": F.expr(clamp("(ay - cb) / h")), "r1": F.expr(f"CASE WHEN edge THEN {clamp('(by - cb) / h')} ELSE f - 1 END")})
    d = d.withColumn("r", F.explode(F.sequence("r0", "r1")))
    d = d.withColumns({"nb": F.expr("cb + r * h"), "slope": F.expr("CASE WHEN edge THEN (bx - ax) / (by - ay) END")})
    d = d.withColumns({"yl": F.expr("CASE WHEN r = r0 THEN ay ELSE nb END"), "yh": F.expr("CASE WHEN r = r1 THEN by ELSE cb + (r + 1) * h END")}).where("NOT edge OR yh > yl")
    d = d.withColumns({"xl": F.expr("CASE WHEN r = r0 THEN ax ELSE ax + (yl - ay) * slope END"), "xh": F.expr("CASE WHEN r = r1 THEN bx ELSE ax + (yh - ay) * slope END")})
    d = d.withColumn("c", F.explode(F.expr(f"sequence(CASE WHEN edge THEN {clamp('(least(xl, xh) - cl) / w')} ELSE 0 END, f - 1)")))
    d = d.withColumns({"nl": F.expr("cl + c * w"), "nr": F.expr("cl + (c + 1) * w")})
    at = lambda x: f"yl + ({x} - xl) / nullif(xh - xl, 0) * (yh - yl)"
    d = d.withColumns({"y_l": F.expr(f"CASE WHEN (xl < nl) <> (xh < nl) THEN {at('nl')} END"), "y_r": F.expr(f"CASE WHEN (xl > nr) <> (xh > nr) THEN {at('nr')} END")})
    # The part left of the cell, as heights, and the part inside.
    d = d.withColumns({
        "e1": F.expr("CASE WHEN xl <= nl AND xh <= nl THEN yl WHEN xl < nl THEN yl WHEN xh < nl THEN y_l END"),
        "e2": F.expr("CASE WHEN xl <= nl AND xh <= nl THEN yh WHEN xl < nl THEN y_l WHEN xh < nl THEN yh END"),
        "s1": F.expr("CASE WHEN xl < nl THEN y_l WHEN xl > nr THEN y_r ELSE yl END"), "t1": F.expr("CASE WHEN xl < nl THEN nl WHEN xl > nr THEN nr ELSE xl END"),
        "s2": F.expr("CASE WHEN xh < nl THEN y_l WHEN xh > nr THEN y_r ELSE yh END"), "t2": F.expr("CASE WHEN xh < nl THEN nl WHEN xh > nr THEN nr ELSE xh END"),
    })
    row = lambda edge, ax, ay, bx, by, sign: f"struct({edge} AS edge, CAST({ax} AS DOUBLE) AS ax, CAST({ay} AS DOUBLE) AS ay, CAST({bx} AS DOUBLE) AS bx, CAST({by} AS DOUBLE) AS by, {sign} * p AS p, {sign} * q AS q)"
    inside = "NOT (xl <= nl AND xh <= nl) AND NOT (xl >= nr AND xh >= nr) AND s2 > s1"
    made = f"""CASE WHEN NOT edge THEN array({row('false', 0, 'yl', 0, 0, 1)}) ELSE concat(
     CASE WHEN e2 > e1 THEN array({row('false', 0, 'e1', 0, 0, 1)}, {row('false', 0, 'e2', 0, 0, back)}) ELSE array() END,
     CASE WHEN {inside} THEN array({row('true', 't1', 's1', 't2', 's2', 1)}) ELSE array() END) END"""
    d = d.select(*keys, F.col("nl").alias("cl"), F.col("nb").alias("cb"), F.col("w").alias("cw"), F.col("h").alias("ch"), F.explode(F.expr(made)).alias("x"))
    return d.select(*keys, *CELL, "x.*")


#: A cell's edges (local coordinates, with slope m) and steps -> areas by strips.
_SWEEP = f"""transform(array(struct(
 array_sort(array_distinct(concat(array(0D, ch), transform(edges, s -> s.ay), transform(edges, s -> s.by), transform(steps, e -> e.y),
  flatten(transform(edges, (s, i) -> filter(transform(filter(slice(edges, i + 2, size(edges)), t -> t.ay < s.by AND s.ay < t.by AND least(s.ax, s.bx) <= greatest(t.ax, t.bx) AND least(t.ax, t.bx) <= greatest(s.ax, s.bx)),
   t -> struct((t.ax - s.ax + s.ay * s.m - t.ay * t.m) / nullif(s.m - t.m, 0) AS y, greatest(s.ay, t.ay) AS lo, least(s.by, t.by) AS hi)), v -> v.y > v.lo AND v.y < v.hi).y))))) AS ys)),
 h -> aggregate(transform(sequence(0, size(h.ys) - 2), k -> struct(h.ys[k] AS lo, h.ys[k + 1] AS hi)),
  struct({', '.join(f'0D AS {a}' for a in AREAS)}),
  (acc, t) -> transform(array(aggregate(concat(array_sort(transform(filter(edges, s -> s.ay <= t.lo AND s.by >= t.hi), s -> struct(least(cw, greatest(0D, s.ax + ((t.lo + t.hi) / 2 - s.ay) * s.m)) AS x, s.p AS p, s.q AS q))), array(struct(cw AS x, 0L AS p, 0L AS q))),
   struct(0D AS x, aggregate(filter(steps, e -> e.y <= t.lo), 0L, (a, e) -> a + e.p) AS p, aggregate(filter(steps, e -> e.y <= t.lo), 0L, (a, e) -> a + e.q) AS q, {', '.join(f'0D AS {a}' for a in AREAS)}),
   (a, e) -> struct(e.x AS x, a.p + e.p AS p, a.q + e.q AS q, a.planned + (e.x - a.x) * %(p)s AS planned, a.outer_area + (e.x - a.x) * %(q)s AS outer_area, a.union_area + (e.x - a.x) * least(%(p)s, 1) AS union_area,
    a.uncovered + CASE WHEN %(q)s > 0 AND %(p)s = 0 THEN e.x - a.x ELSE 0D END AS uncovered, a.outside + CASE WHEN %(p)s > 0 AND %(q)s = 0 THEN e.x - a.x ELSE 0D END AS outside))),
   z -> struct({', '.join(f'acc.{a} + z.{a} * (t.hi - t.lo) AS {a}' for a in AREAS)}))[0]))[0]"""


def _meet(rows: DataFrame, other: DataFrame, on: list[str], hint: str, how: str = "inner") -> DataFrame:
    """Join on columns of one name, null equal to null."""
    other = other.select(*(F.col(c).alias(f"_{c}" if c in on else c) for c in other.columns))
    return rows.join(other.hint(hint), reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on)), how).drop(*(f"_{c}" for c in on))


def overlay_areas(edges: DataFrame, keys: list[str], parity: bool = False, most: int = EDGES) -> DataFrame:
    """keys and AREAS from edges of region_edges (or plain_edges, with parity): pieces are p, the outer polygon q. A key without any area is left out.

    planned: area times number of pieces; union_area: covered by a piece; uncovered: of the outer polygon, by none; outside: covered by a piece, not by the outer polygon.
    """
    box = edges.groupBy(*keys).agg(F.min(F.least("ax", "bx")).alias("cl"), F.min("ay").alias("cb"), F.max(F.greatest("ax", "bx")).alias("_r"), F.max("by").alias("_t"), F.count("*").alias("_n"))
    box = box.select(*keys, "cl", "cb", (F.col("_r") - F.col("cl")).alias("cw"), (F.col("_t") - F.col("cb")).alias("ch"))
    rows = _meet(edges, box, keys, "merge").where("cw > 0").withColumn("edge", F.lit(True))
    cell, done = [*keys, *CELL], None
    for level in range(LEVELS + 1):
        rows = keep(_summed(rows, keys, parity), "overlay-cells")
        large = rows.where("edge").groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > most)
        large = keep(large.select(*cell, F.expr("CASE WHEN n > 1024 THEN 16 WHEN n > 128 THEN 8 ELSE 4 END").alias("f")), "overlay-large")
        if level == LEVELS or large.isEmpty():
            done = rows if done is None else done.unionByName(rows)
            break
        rest = _meet(rows, large, cell, "shuffle_hash", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        rows = _split(_meet(rows, large, cell, "shuffle_hash"), keys, parity)
    local = F.expr("struct(ax - cl AS ax, ay - cb AS ay, bx - cl AS bx, by - cb AS by, p, q, (bx - ax) / (by - ay) AS m)")
    cells = done.groupBy(*cell).agg(F.collect_list(F.when(F.col("edge"), local)).alias("edges"), F.collect_list(F.when(~F.col("edge"), F.expr("struct(ay - cb AS y, p, q)"))).alias("steps"))
    count = {c: (f"pmod(a.{c}, 2)" if parity else f"greatest(a.{c}, 0)") for c in "pq"}
    swept = cells.select(*keys, F.expr(_SWEEP % count).alias("z"))
    return swept.groupBy(*keys).agg(*(F.sum(f"z.{a}").alias(a) for a in AREAS))


def overlay(pieces: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """overlay_areas of polygon columns: any number of pieces a key, one outer polygon (or more that do not overlap)."""
    return overlay_areas(region_edges(pieces, keys, "p").unionByName(region_edges(outer, keys, "q")), keys)
