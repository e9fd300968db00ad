"""Counts over all pairs of a group without making pairs: which pairs keep their order in two coordinates, beyond a tolerance.

For a node j the nodes i with s_j - s_i > eps_s are those with s_i < x_j, where x_j is the smallest double that is within the tolerance of s_j; so all counts are sums over j of
dominance counts #{i: s_i < x, t_i < y}. In memory these come from a wavelet matrix, n log n and vectorised. Groups of more than `most` nodes are cut at
quantiles of s and of t: counts of whole blocks come from prefix sums of the block counts, the rest from one block of s or of t each, so that no task
holds more than a block (and the nodes that share one coordinate value with it).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import keep

#: Nodes of a group that one task takes whole; most blocks of a larger one.
MOST, BLOCKS = 1 << 17, 1024
_TOP = 1.7976931348623157e308


def within_from(v, eps: float, above: bool = False):
    """Smallest double k with v - k <= eps; above: with k - v > eps. By bisection over the doubles' order, so it agrees with the subtraction as it is computed."""
    import numpy as np

    sign = np.uint64(1 << 63)

    def ordered(x):
        i = x.view(np.uint64)
        return np.where(i & sign, ~i, i | sign)

    def double(o):
        return np.where(o & sign, o ^ sign, ~o).view(np.float64)

    v = np.ascontiguousarray(v, np.float64)
    lo = ordered(np.nextafter(v if above else v - 4 * eps, -np.inf))
    hi = ordered(np.nextafter(v + 4 * eps if above else v, np.inf))
    for _ in range(64):
        mid = lo + (hi - lo) // np.uint64(2)
        k = double(mid)
        on = (k - v > eps) if above else (v - k <= eps)
        hi, lo = np.where(on, mid, hi), np.where(on, lo, mid)
    return double(hi)


def dominated(px, py, qx, qy):
    """For each query the number of points with px < qx and py < qy."""
    import numpy as np

    order = np.argsort(px, kind="stable")
    high = np.searchsorted(px[order], qx, side="left")
    heights = np.sort(py)
    code, want = np.searchsorted(heights, py[order], side="left"), np.searchsorted(heights, qy, side="left")
    low, total = np.zeros(len(high), np.int64), np.zeros(len(high), np.int64)
    high = high.astype(np.int64)
    for bit in range(int(len(px)).bit_length() - 1, -1, -1):
        one = (code >> bit) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - one)])
        up = ((want >> bit) & 1).astype(bool)
        zl, zh, n = zeros[low], zeros[high], int(zeros[-1])
        total += np.where(up, zh - zl, 0)
        low, high = np.where(up, n + low - zl, zl), np.where(up, n + high - zh, zh)
        code = np.concatenate([code[one == 0], code[one == 1]])
    return total


def _counts(s, t, eps_s: float, eps_t: float) -> tuple[int, int, int]:
    """(pairs apart in s, pairs apart in both, pairs of these in the same order) of one group; nan is no value."""
    import numpy as np

    t = t[~np.isnan(s)]
    s = s[~np.isnan(s)]
    x = within_from(s, eps_s)
    far = int(np.searchsorted(np.sort(s), x, side="left").sum())
    on = ~np.isnan(t)
    s, t, x = s[on], t[on], x[on]
    same = int(dominated(s, t, x, within_from(t, eps_t)).sum())
    below = int(dominated(s, t, x, within_from(t, eps_t, above=True)).sum())
    return far, int(np.searchsorted(np.sort(s), x, side="left").sum()) - below + same, same


def _runs(batches: Iterator, width: int):
    """Columns (numpy) of each run of equal first two columns."""
    import numpy as np

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        x = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
        cuts = np.flatnonzero((x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(x[0])], strict=True):
            part = [v[a:b] for v in x]
            if held and (held[-1][0][-1] != part[0][0] or held[-1][1][-1] != part[1][0]):
                yield [np.concatenate([h[i] for h in held]) for i in range(width)]
                held = []
            held.append(part)
    if held:
        yield [np.concatenate([h[i] for h in held]) for i in range(width)]


def _small(eps: tuple[float, float]):
    """(g, axis, s, t) sorted by g, axis -> (g, axis, far, both, same)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out = [(int(g[0]), int(a[0]), *_counts(s, t, *eps)) for g, a, s, t in _runs(batches, 4)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["g", "axis", "far", "both", "same"])

    return run


def _with_bounds(eps: tuple[float, float]):
    """(g, axis, s, t) -> also x, y1, y2: below x a node is apart in s; below y1 apart in t; from y2 on apart the other way."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            s, t = (np.array(b.column(i).to_numpy(zero_copy_only=False), np.float64) for i in (2, 3))
            none = np.isnan(t)
            low, high = (np.where(none, np.nan, within_from(np.nan_to_num(t), eps[1], above)) for above in (False, True))
            cols = [b.column(0), b.column(1), pa.array(s), pa.array(np.where(none, _TOP, t)), pa.array(within_from(s, eps[0])), pa.array(low, from_pandas=True), pa.array(high, from_pandas=True)]
            yield pa.RecordBatch.from_arrays(cols, ["g", "axis", "s", "t", "x", "y1", "y2"])

    return run


def _inside(batches: Iterator) -> Iterator:
    """(block hash, part, g, axis, point, a, b, out) sorted by the first two: points and queries of one block -> (g, axis, out, n) sums of dominance counts by out."""
    import numpy as np
    import pyarrow as pa

    for _, _, g, axis, point, a, b, out in _runs(batches, 8):
        p = point.astype(bool)
        if p.all() or not p.any():
            continue
        n = dominated(a[p], b[p], a[~p], b[~p])
        total = np.array([n[out[~p] == k].sum() for k in range(4)], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in ([int(g[0])] * 4, [int(axis[0])] * 4, range(4), total.tolist())], ["g", "axis", "out", "n"])


def _large(rows: DataFrame, eps: tuple[float, float], blocks: int) -> DataFrame:
    """(g, axis, far, both, same) of large groups. Outputs of queries: 0 same, 1 below or within, 2 all with both values, 3 all with s."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = rows.where("s IS NOT NULL AND NOT isnan(s)").withColumn("t", F.nanvl("t", F.lit(None).cast("double")))
    steps = F.array(*(F.lit(i / blocks) for i in range(1, blocks)))
    cuts = keep(d.groupBy("g", "axis").agg(F.percentile_approx("s", steps, 20 * blocks).alias("cs"), F.percentile_approx("t", steps, 20 * blocks).alias("ct")), "order-cuts")
    d = d.mapInArrow(_with_bounds(eps), "g bigint, axis bigint, s double, t double, x double, y1 double, y2 double").join(cuts.hint("merge"), ["g", "axis"])
    digit = lambda v, c: F.size(F.filter(c, lambda k: k <= v))
    none = F.array().cast("array<double>")
    d = d.withColumns({"cs": F.coalesce("cs", none), "ct": F.coalesce("ct", none)})
    d = d.withColumns({"ds": digit(F.col("s"), F.col("cs")), "dt": digit(F.col("t"), F.col("ct")), "dx": digit(F.col("x"), F.col("cs"))})
    asks = F.expr(f"filter(array(struct(y1 AS y, 0 AS out), struct(y2 AS y, 1 AS out), struct(CASE WHEN y1 IS NOT NULL THEN {_TOP}D END AS y, 2 AS out), struct(double('infinity') AS y, 3 AS out)), q -> q.y IS NOT NULL)")
    d = keep(d.withColumn("asks", F.transform(asks, lambda q: F.struct(q["y"].alias("y"), q["out"].alias("out"), digit(q["y"], F.col("ct")).alias("dy")))).drop("cs", "ct", "y1", "y2"), "order-nodes")
    q = d.select("g", "axis", "x", "dx", F.explode("asks").alias("q")).select("g", "axis", "x", "dx", "q.*")
    # Whole blocks: counts of points by block, summed over lower blocks of both coordinates.
    have = d.groupBy("g", "axis", "ds", "dt").agg(F.count("*").alias("n"))
    want = q.groupBy("g", "axis", "dx", "dy", "out").agg(F.count("*").alias("w"))
    column = have.withColumn("d", F.explode(F.sequence(F.col("dt") + 1, F.lit(blocks)))).groupBy("g", "axis", "ds", "d").agg(F.sum("n").alias("n"))
    lower = Window.partitionBy("g", "axis", "d").orderBy("ds")
    column = column.withColumns({"n": F.sum("n").over(lower), "next": F.coalesce(F.lead("ds").over(lower), F.lit(blocks))})
    # n points lie in blocks up to ds of s, for all dx in (ds, next].
    whole = column.select("g", "axis", F.col("d").alias("dy"), F.explode(F.sequence(F.col("ds") + 1, F.greatest("next", F.col("ds") + 1))).alias("dx"), "n")
    whole = want.join(whole.hint("merge"), ["g", "axis", "dx", "dy"]).groupBy("g", "axis", "out").agg(F.sum(F.col("w") * F.col("n")).alias("n"))
    # The block of x holds points left of x; the block of y, from lower blocks of s, points below y.
    row = lambda part, block, point, a, b, out: (F.xxhash64("g", "axis", F.lit(part), block).alias("k"), F.lit(part).cast("bigint").alias("part"), "g", "axis", F.lit(point).cast("bigint").alias("point"), a.cast("double").alias("a"), b.alias("b"), out.cast("bigint").alias("out"))
    zero = F.lit(0)
    inside = d.select(*row(0, F.col("ds"), 1, F.col("s"), F.col("t"), zero)).unionByName(q.select(*row(0, F.col("dx"), 0, F.col("x"), F.col("y"), F.col("out"))))
    inside = inside.unionByName(d.select(*row(1, F.col("dt"), 1, F.col("ds"), F.col("t"), zero))).unionByName(q.select(*row(1, F.col("dy"), 0, F.col("dx"), F.col("y"), F.col("out"))))
    inside = inside.repartition(parts, "k", "part").sortWithinPartitions("k", "part").mapInArrow(_inside, "g bigint, axis bigint, out bigint, n bigint")
    total = whole.select("g", "axis", F.col("out").cast("bigint").alias("out"), "n").unionByName(inside).groupBy("g", "axis").agg(*(F.sum(F.when(F.col("out") == i, F.col("n")).otherwise(0)).alias(f"o{i}") for i in range(4)))
    return total.select("g", "axis", F.col("o3").alias("far"), (F.col("o2") - F.col("o1") + F.col("o0")).alias("both"), F.col("o0").alias("same"))


def order_counts(rows: DataFrame, key: str, axes: dict[str, tuple[Column, Column]], eps_s: float, eps_t: float, most: int = MOST) -> DataFrame:
    """key, n and, for each axis (name: s, t), name_far, name_both, name_same: how many pairs of the key's rows lie apart in s, in s and t, and in the same direction.

    A null or nan value is apart from none. Keys may be null.
    """
    ids = rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("g", F.xxhash64(F.col(key), F.col(key).isNull()))
    value = F.array(*(F.struct(F.lit(i).cast("bigint").alias("axis"), s.cast("double").alias("s"), t.cast("double").alias("t")) for i, (s, t) in enumerate(axes.values())))
    flat = rows.select(F.xxhash64(F.col(key), F.col(key).isNull()).alias("g"), F.explode(value).alias("v")).select("g", "v.*")
    ids = keep(ids, "order-groups")
    large = ids.where(F.col("n") > most).select("g", "n")
    top = large.agg(F.max("n")).first()[0]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = flat if top is None else flat.join(large.select("g").hint("shuffle_hash"), "g", "left_anti")
    found = small.repartition(parts, "g", "axis").sortWithinPartitions("g", "axis").mapInArrow(_small((eps_s, eps_t)), "g bigint, axis bigint, far bigint, both bigint, same bigint")
    if top is not None:
        blocks = min(BLOCKS, max(2, -(-2 * top // most)))
        found = found.unionByName(_large(flat.join(large.select("g").hint("shuffle_hash"), "g", "left_semi"), (eps_s, eps_t), blocks))
    wide = found.groupBy("g").agg(*(F.coalesce(F.sum(F.when(F.col("axis") == i, F.col(c))), F.lit(0)).alias(f"{name}_{c}") for i, name in enumerate(axes) for c in ("far", "both", "same")))
    return ids.join(wide.hint("shuffle_hash"), "g").drop("g")
