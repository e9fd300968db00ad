"""Label layout metrics: directions, pair order, overlaps, rings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .paircounts import MOST, order_counts
from .spatial import box_cells, cell_of, nearest_gap, rect_overlaps


def with_angles(nodes: DataFrame, lon0: Column, lat0: Column, cx: Column, cy: Column) -> DataFrame:
    """src and dst offsets and angles (0 east, counter-clockwise) of true place and label; canvas y points down."""
    src = geo.local_xy(F.col("lon"), F.col("lat"), lon0, lat0)
    d = nodes.withColumns({"sx": src["dx"], "sy": src["dy"], "tx": F.col("x") - cx, "ty": cy - F.col("y")})
    return d.withColumns({"src_angle": geo.normal_angle(F.degrees(F.atan2("sy", "sx"))), "dst_angle": geo.normal_angle(F.degrees(F.atan2("ty", "tx")))})


def direction_metrics(angled: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Per layout: angular error (mean, median, p95, max), excluded nodes, east-west and north-south flips, sector retention.

    Nodes at a centre have no direction and are excluded. Rates have their own denominators; none gives null.
    Lower-rank percentiles come from a rank filter, so no list of a layout's nodes is built.
    """
    at_centre = ((F.abs("sx") <= eps) & (F.abs("sy") <= eps)) | ((F.abs("tx") <= eps) & (F.abs("ty") <= eps))
    d = angled.withColumn("skip", at_centre).withColumn("err", F.when(~F.col("skip"), geo.angle_between(F.col("src_angle"), F.col("dst_angle"))))
    w = Window.partitionBy("layout_id")
    d = d.withColumns({"_i": F.row_number().over(w.orderBy(F.asc_nulls_last("err"), "node_id")) - 1, "_n": F.count("err").over(w)})
    at = lambda p: F.max(F.when(F.col("_i") == F.floor((F.col("_n") - 1) * p), F.col("err")))
    out = [F.count("*").alias("n"), F.count_if("skip").alias("excluded"), F.avg("err").alias("err_mean"), at(0.5).alias("err_median"), at(0.95).alias("err_p95"), F.max("err").alias("err_max")]
    for name, s, t in (("ew", "sx", "tx"), ("ns", "sy", "ty")):
        a, b = geo.sign_eps(F.col(s), eps), geo.sign_eps(F.col(t), eps)
        base = (a != 0) & (b != 0)
        out += [F.count_if(base).alias(f"{name}_base"), F.count_if(base & (a != b)).alias(f"{name}_flips")]
    for k in (4, 8, 12):
        base = ~F.col("skip") & ~geo.near_sector_edge(F.col("src_angle"), k)
        same = geo.sector(F.col("src_angle"), k) == geo.sector(F.col("dst_angle"), k)
        out += [F.count_if(base).alias(f"sector{k}_base"), F.count_if(base & same).alias(f"sector{k}_kept")]
    return d.groupBy("layout_id").agg(*out)


def pairwise_retention(angled: DataFrame, eps_src: float = 1e-6, eps_dst: float = 1e-6, most: int = MOST) -> DataFrame:
    """Per layout of two nodes or more, over all node pairs: how many keep their left-right and up-down order, and how many are excluded.

    Pairs are counted, not made (`paircounts`): n log n, and a layout of over `most` nodes is cut in blocks. A node without a place (null) is apart from none.
    """
    d = order_counts(angled, "layout_id", {"lr": (F.col("sx"), F.col("tx")), "ud": (F.col("sy"), F.col("ty"))}, eps_src, eps_dst, most).where("n > 1")
    pairs = F.expr("n * (n - 1) div 2")
    out = []
    for name in ("lr", "ud"):
        far, both, same = (F.col(f"{name}_{c}") for c in ("far", "both", "same"))
        out += [(pairs - far).alias(f"{name}_source_excluded"), (far - both).alias(f"{name}_layout_excluded"), both.alias(f"{name}_base"), same.alias(f"{name}_kept")]
    return d.select("layout_id", *out)


def layout_completeness(nodes: DataFrame, eligible: DataFrame, bands: DataFrame | None = None) -> DataFrame:
    """Per layout: eligible, placed, placement rate, overlapping pairs and their rate over n (n - 1) / 2; with bands also labels outside their ring and their rate."""
    n = nodes.groupBy("layout_id").agg(F.count("*").alias("placed"))
    o = rect_overlaps(nodes).groupBy("layout_id").agg(F.count("*").alias("overlaps"))
    d = eligible.join(n.hint("merge"), "layout_id", "left").join(o.hint("merge"), "layout_id", "left").na.fill(0, ["placed", "overlaps"])
    pairs = F.col("placed") * (F.col("placed") - 1) / 2
    d = d.withColumns({"placement_rate": F.when(F.col("eligible") > 0, F.col("placed") / F.col("eligible")), "overlap_rate": F.when(pairs > 0, F.col("overlaps") / pairs)})
    if bands is None:
        return d
    out = layout_constraints(nodes, bands).select("layout_id", "outside_ring")
    d = d.join(out.hint("merge"), "layout_id", "left").na.fill(0, ["outside_ring"])
    return d.withColumn("outside_rate", F.when(F.col("placed") > 0, F.col("outside_ring") / F.col("placed")))


def _near_far() -> tuple[Column, Column]:
    """Distance from the centre of a label's nearest point and of its farthest corner."""
    hw, hh = F.col("width") / 2, F.col("height") / 2
    return F.hypot(F.greatest(F.lit(0.0), F.abs("tx") - hw), F.greatest(F.lit(0.0), F.abs("ty") - hh)), F.hypot(F.abs("tx") + hw, F.abs("ty") + hh)


def ring_metrics(nodes: DataFrame, bands: DataFrame, centre_radius: float = 0.0) -> DataFrame:
    """Per layout and ring (bands: ring_id, inner, outer): label area over ring area, void ratio, gaps min, median and p95, the
    band's width, what labels leave of it inside and outside, and the gap from the band before (from centre_radius for the first)."""
    g = nearest_gap(nodes, ("layout_id", "ring_id"))
    w = Window.partitionBy("layout_id", "ring_id")
    g = g.withColumns({"_i": F.row_number().over(w.orderBy(F.asc_nulls_last("gap"), "node_id")) - 1, "_n": F.count("gap").over(w)})
    at = lambda p: F.max(F.when(F.col("_i") == F.floor((F.col("_n") - 1) * p), F.col("gap")))
    gaps = g.groupBy("layout_id", "ring_id").agg(F.min("gap").alias("gap_min"), at(0.5).alias("gap_median"), at(0.95).alias("gap_p95"))
    near, far = _near_far()
    area = nodes.groupBy("layout_id", "ring_id").agg(F.count("*").alias("n"), F.sum(F.col("width") * F.col("height")).alias("label_area"), F.min(near).alias("_near"), F.max(far).alias("_far"))
    before = F.lag("outer", 1, centre_radius).over(Window.partitionBy(F.lit(1)).orderBy("inner", "ring_id"))  # a few bands
    bands = bands.withColumn("gap_from_previous", F.col("inner") - before)
    ring = F.pi() * (F.col("outer") * F.col("outer") - F.col("inner") * F.col("inner"))
    d = area.join(gaps.hint("merge"), ["layout_id", "ring_id"]).join(bands.hint("shuffle_hash"), "ring_id")
    d = d.withColumn("fill_ratio", F.col("label_area") / ring).withColumn("void_ratio", 1 - F.col("fill_ratio"))
    return d.withColumns({"band_width": F.col("outer") - F.col("inner"), "unused_inner": F.col("_near") - F.col("inner"), "outer_slack": F.col("outer") - F.col("_far")}).drop("_near", "_far")


def layout_constraints(nodes: DataFrame, bands: DataFrame, centre_half: tuple[float, float] = (20, 20)) -> DataFrame:
    """Per layout: labels not within their own band, labels on the centre box, and half-plane violations by sx, sy, tx, ty.

    A label is within a band if its nearest point is at least inner and its farthest corner at most outer from the centre.
    """
    near, far = _near_far()
    d = nodes.join(bands.hint("shuffle_hash"), "ring_id")
    return d.groupBy("layout_id").agg(
        F.count_if((near < F.col("inner")) | (far > F.col("outer"))).alias("outside_ring"),
        F.count_if((F.abs("tx") < F.col("width") / 2 + centre_half[0]) & (F.abs("ty") < F.col("height") / 2 + centre_half[1])).alias("on_centre"),
        F.count_if(F.signum("sx") * F.signum("tx") < 0).alias("ew_violations"), F.count_if(F.signum("sy") * F.signum("ty") < 0).alias("ns_violations"),
    )


def obstacle_collisions(nodes: DataFrame, obstacles: DataFrame, cell: float = 64.0) -> DataFrame:
    """Pairs (layout_id, node_id, obstacle_id) of labels and obstacle boxes (centre x, y, width, height) that overlap. Obstacles with a
    layout_id are of that layout, others of all."""

    def sides(d: DataFrame, end: str) -> dict:
        return {f"{k}{end}": F.col(c) + s * F.col(z) / 2 for k, c, s, z in (("l", "x", -1, "width"), ("r", "x", 1, "width"), ("t", "y", -1, "height"), ("b", "y", 1, "height"))}

    n = nodes.withColumns(sides(nodes, "1")).select("layout_id", "node_id", "l1", "r1", "t1", "b1")
    own = ["layout_id"] if "layout_id" in obstacles.columns else []
    o = obstacles.withColumns(sides(obstacles, "2")).select(*own, "obstacle_id", "l2", "r2", "t2", "b2")
    a = box_cells(n, F.col("l1"), F.col("t1"), F.col("r1"), F.col("b1"), cell)
    b = box_cells(o, F.col("l2"), F.col("t2"), F.col("r2"), F.col("b2"), cell)
    hit = a.join(b.hint("merge"), [*own, "cx", "cy"]).where("l1 < r2 and l2 < r1 and t1 < b2 and t2 < b1")
    return hit.where((F.col("cx") == cell_of(F.greatest("l1", "l2"), cell)) & (F.col("cy") == cell_of(F.greatest("t1", "t2"), cell))).select("layout_id", "node_id", "obstacle_id")


def validate_metrics(metrics: DataFrame, ratios: list[str]) -> DataFrame:
    """errors: names of ratios outside 0..1, and "sum" where placed + unplaced <> eligible."""
    bad = [F.when(~F.coalesce(F.col(c).between(0, 1), F.lit(True)), c) for c in ratios]
    return metrics.withColumn("errors", F.array_compact(F.array(*bad, F.when(F.col("placed") + F.col("unplaced") != F.col("eligible"), "sum"))))


def experiment_gate(metrics: DataFrame, algorithms: list[str], value: str) -> DataFrame:
    """One row a density: a column an algorithm, the best one, and whether all are there."""
    p = metrics.groupBy("density").pivot("algorithm", algorithms).agg(F.first(value))
    best = F.least(*(F.struct(F.coalesce(F.col(a), F.lit(float("inf"))).alias("v"), F.lit(a).alias("a")) for a in algorithms))["a"]
    there = F.lit(True)
    for a in algorithms:
        there = there & F.col(a).isNotNull()
    return p.withColumn("complete", there).withColumn("best", best)


def balanced_gate(metrics: DataFrame) -> DataFrame:
    """Nine checks of the balanced algorithm against geography-first and compact-first at each density, and whether all pass.

    metrics: density, algorithm, overlap, outside, on_centre, on_label, mutated, stable, err_mean, ew_rate, ns_rate, canvas_width, utilization. A
    check that lacks a value fails.
    """
    of = lambda algorithm, column: F.max(F.when(F.col("algorithm") == algorithm, F.col(column)))
    base, compact, geography = "balanced", "compact-first", "geography-first"
    flips = lambda a: F.coalesce(of(a, "ew_rate"), F.lit(0.0)) + F.coalesce(of(a, "ns_rate"), F.lit(0.0))
    checks = {
        "overlap0": of(base, "overlap") == 0, "outside0": of(base, "outside") == 0, "on_centre0": of(base, "on_centre") == 0, "on_label0": of(base, "on_label") == 0,
        "unchanged": ~of(base, "mutated"), "stable": of(base, "stable"),
        "direction": (of(base, "err_mean") <= of(compact, "err_mean") * 0.85) | (flips(base) <= flips(compact) * 0.85),
        "smaller": of(base, "canvas_width") < of(geography, "canvas_width"), "utilized": of(base, "utilization") >= of(geography, "utilization"),
    }
    d = metrics.groupBy("density").agg(*(F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()))
    passed = F.lit(True)
    for k in checks:
        passed = passed & F.col(k)
    return d.withColumn("passed", passed)


def bearing_bins(points: DataFrame, bins: int = 360) -> DataFrame:
    """Adds bin (by compass bearing) and radius_m from centre columns clon, clat."""
    b = geo.bearing(F.col("clon"), F.col("clat"), F.col("lon"), F.col("lat"))
    return points.withColumns({"bin": F.floor(b / (360.0 / bins)).cast("int"), "radius_m": geo.haversine_m(F.col("clon"), F.col("clat"), F.col("lon"), F.col("lat"))})


def reach_profile(binned: DataFrame, spread: int = 3, bins: int = 360) -> DataFrame:
    """Largest weighted radius of each (analysis_id, bin): a point reaches `spread` bins either way with falling weight."""
    d = binned.groupBy("analysis_id", "bin").agg(F.max("radius_m").alias("radius_m"))
    d = d.withColumn("off", F.explode(F.sequence(F.lit(-spread), F.lit(spread))))
    w = 1 - F.abs("off") / (spread + 1)
    return d.groupBy("analysis_id", F.pmod(F.col("bin") + F.col("off"), F.lit(bins)).alias("bin")).agg(F.max(F.col("radius_m") * w).alias("reach_m"))


def profile_shape(profile: DataFrame, bins: int = 360, value: str = "reach_m") -> DataFrame:
    """Per analysis: area, perimeter and 4 pi A / P^2 of the closed shape whose radius at each bearing bin is `value`; missing bins are 0."""
    keys = profile.select("analysis_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    d = keys.join(profile.hint("merge"), ["analysis_id", "bin"], "left").select("analysis_id", "bin", F.coalesce(value, F.lit(0.0)).alias("r"))
    w = Window.partitionBy("analysis_id").orderBy("bin")
    d = d.withColumn("next", F.coalesce(F.lead("r").over(w), F.first("r").over(w)))
    turn = 2 * math.pi / bins
    area = F.sum(F.col("r") * F.col("next")) * math.sin(turn) / 2
    edge = F.sum(F.sqrt(F.greatest(F.lit(0.0), F.col("r") * F.col("r") + F.col("next") * F.col("next") - 2 * F.col("r") * F.col("next") * math.cos(turn))))
    s = d.groupBy("analysis_id").agg(area.alias("area"), edge.alias("perimeter"))
    return s.withColumn("compactness", geo.compactness(F.col("area"), F.col("perimeter")))


def contour_radius(density: DataFrame, threshold: float = 1.05, least: float = 70.0) -> DataFrame:
    """Per analysis and bearing bin the largest radius whose density (analysis_id, bin, radius, density) reaches the threshold, at least `least`."""
    reached = F.max(F.when(F.col("density") >= threshold, F.col("radius")))
    return density.groupBy("analysis_id", "bin").agg(F.greatest(F.coalesce(reached, F.lit(least)), F.lit(least)).alias("contour"))


def circular_smooth(profile: DataFrame, radius: int = 2, bins: int = 360, value: str = "reach_m") -> DataFrame:
    """Triangular moving average over a circle of bins: two box sums over a wrapped copy; missing bins count 0."""
    keys = profile.select("analysis_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    d = keys.join(profile.hint("merge"), ["analysis_id", "bin"], "left").select("analysis_id", "bin", F.coalesce(value, F.lit(0.0)).alias("v"))
    turned = F.explode(F.array(F.lit(-bins), F.lit(0), F.lit(bins)))
    d = d.withColumn("turn", turned).withColumn("at", F.col("bin") + F.col("turn")).where((F.col("at") >= -2 * radius) & (F.col("at") < bins + 2 * radius))
    w = Window.partitionBy("analysis_id").orderBy("at")
    d = d.withColumn("a", F.sum("v").over(w.rowsBetween(-radius, 0))).withColumn("s", F.sum("a").over(w.rowsBetween(0, radius)))
    return d.where("turn = 0").select("analysis_id", "bin", (F.col("s") / ((radius + 1) * (radius + 1))).alias("smooth"))


def max_empty_arc(binned: DataFrame, key: str = "layout_id", bins: int = 720) -> DataFrame:
    """Longest run of empty bins around the circle."""
    d = binned.select(key, "bin").distinct()
    d = d.union(d.select(key, F.col("bin") + bins))
    gap = F.col("bin") - F.lag("bin").over(Window.partitionBy(key).orderBy("bin")) - 1
    return d.withColumn("gap", gap).groupBy(key).agg(F.least(F.lit(bins - 1), F.max("gap")).alias("max_empty"))


def kernel_density(points: DataFrame, grid: DataFrame, h: float, weight: str = "w") -> DataFrame:
    """Sum of w exp(-d^2 / 2 h^2) at grid points (analysis_id, gid, x, y) over points (analysis_id, x, y) within 4 h; a cell join."""
    reach = 4 * h
    p = points.withColumns({"cx": F.floor(F.col("x") / reach), "cy": F.floor(F.col("y") / reach)}).select("analysis_id", "cx", "cy", F.col("x").alias("px"), F.col("y").alias("py"), weight)
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    g = grid.withColumn("n", near).withColumns({"cx": F.floor(F.col("x") / reach) + F.col("n.i"), "cy": F.floor(F.col("y") / reach) + F.col("n.j")})
    d2 = F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2)
    j = g.join(p.hint("merge"), ["analysis_id", "cx", "cy"]).withColumn("d2", d2).where(F.col("d2") <= reach * reach)
    return j.groupBy("analysis_id", "gid").agg(F.sum(F.col(weight) * F.exp(-F.col("d2") / (2 * h * h))).alias("density"))
