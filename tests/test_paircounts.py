"""Pair order counted without pairs, against all pairs."""

import random

import numpy as np
import pytest

from reachlake.operators import layout, paircounts


def test_bounds_agree_with_the_subtraction():
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 1, 500), rng.normal(0, 1e9, 500), rng.normal(0, 1e-7, 500), [0.0, 1e-6, -1e-6, 5.0, 1e300]])
    for eps in (1e-6, 0.25, 0.0):
        low, high = paircounts.within_from(v, eps), paircounts.within_from(v, eps, above=True)
        assert (v - low <= eps).all() and (v - np.nextafter(low, -np.inf) > eps).all()
        assert (high - v > eps).all() and (np.nextafter(high, -np.inf) - v <= eps).all()


def test_dominance_counts():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 17, 64, 300):
        px, py, qx, qy = rng.integers(0, 20, n) * 1.0, rng.integers(0, 20, n) * 1.0, rng.integers(-1, 22, 50) * 1.0, np.append(rng.integers(-1, 22, 49) * 1.0, np.inf)
        want = [int(((px < a) & (py < b)).sum()) for a, b in zip(qx, qy, strict=True)]
        assert paircounts.dominated(px, py, qx, qy).tolist() == want


def plain(rows, eps):
    out = {}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        if len(own) < 2:
            continue
        c = [0] * 8
        sign = lambda a, b: 0 if a is None or b is None else (b - a > eps) - (b - a < -eps)
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                for at, (s, t) in enumerate(((2, 3), (4, 5))):
                    x, y = sign(a[s], b[s]), sign(a[t], b[t])
                    c[4 * at] += x == 0
                    c[4 * at + 1] += x != 0 and y == 0
                    c[4 * at + 2] += x != 0 and y != 0
                    c[4 * at + 3] += x != 0 and x == y
        out[k] = tuple(c)
    return out


@pytest.mark.parametrize("most", [1 << 17, 40, 7])
def test_retention_against_all_pairs(spark, most):
    """Ties, differences at the tolerance, nulls, a null key, a single node; layouts in one task and in blocks."""
    rng = random.Random(most)
    rows = []
    for k, n in ((1, 1), (2, 2), (3, 150), (4, 90), (None, 60), (5, 50)):
        for i in range(n):
            value = lambda: rng.choice([None] + [rng.randrange(8) / 4 + rng.choice([0, 0, 1e-6, 2e-6, 5e-7])] * 9) if k != 5 else 1.0
            rows.append((k, i, value(), value(), value() if k != 4 else rng.gauss(0, 1), value() if k != 4 else rng.gauss(0, 1)))
    d = spark.createDataFrame(rows, "layout_id int, node_id int, sx double, tx double, sy double, ty double").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in layout.pairwise_retention(d, most=most).collect()}
    assert got == plain(rows, 1e-6)


def test_one_layout_of_many_nodes(spark):
    """300,000 nodes in blocks: as many pairs as there are, and those of a shifted copy of the order."""
    from pyspark.sql import functions as F

    n = 300_000
    d = spark.range(n).select(F.lit(1).alias("layout_id"), F.col("id").alias("node_id"), F.col("id").cast("double").alias("sx"), F.pmod(F.col("id") + 100_000, F.lit(n)).cast("double").alias("tx"), F.lit(0.0).alias("sy"), F.col("id").cast("double").alias("ty"))
    r = layout.pairwise_retention(d).first()
    pairs = n * (n - 1) // 2
    assert (r.lr_source_excluded, r.lr_layout_excluded, r.lr_base, r.lr_kept) == (0, 0, pairs, pairs - 200_000 * 100_000)
    assert (r.ud_source_excluded, r.ud_layout_excluded, r.ud_base, r.ud_kept) == (pairs, 0, 0, 0)


def test_keep_first_of_long_chains_and_large_names(spark):
    """A chain of 10,000 rows, and names of more pairs than a task takes: as the plain walk, in few rounds, whatever the order runs along."""
    import math

    from reachlake.operators import spatial

    rng = random.Random(4)
    step = 4 / 96000
    rows = [(i, "chain", i * step, 0.0) for i in range(10_000)]
    d = spark.createDataFrame(rows, "pos int, name string, lon double, lat double").repartition(4)
    assert sorted(r.pos for r in spatial.dedupe_near(d).select("pos").collect()) == list(range(0, 10_000, 2))
    some = [(x, "zig" if x % 3 else "zag", rng.random() * 300 * step, rng.random() * 3 * step) for x in range(700)]
    line = list(range(300))
    rng.shuffle(line)
    some += [(1000 + k, "line", at * step, 0.0) for k, at in enumerate(line)]
    kept = []
    for pos, name, lon, lat in sorted(some):
        if not any(n == name and math.hypot((lon - a) * 96000, (lat - b) * 111000) <= 5 for _, n, a, b in kept):
            kept.append((pos, name, lon, lat))
    d = spark.createDataFrame(some, "pos int, name string, lon double, lat double").repartition(4)
    for most in (1 << 17, 60):
        assert sorted(r.pos for r in spatial.dedupe_near(d, most=most).select("pos").collect()) == [r[0] for r in kept]


def test_keep_first_of_a_dense_name_makes_no_pairs(spark):
    """60,000 rows of one name within 20 m (1.8e9 pairs), fixed rows among them, whole and by squares with rows that wait: as the plain walk; rows without coordinates stay."""
    import math

    from pyspark.sql import functions as F

    from reachlake.operators import spatial

    rng = random.Random(8)
    rows = [(i, "x", rng.random() * 20 / 96000, rng.random() * 20 / 111000, i % 5000 == 7) for i in range(60_000)]
    rows += [(60_000 + i, "y", rng.random() * 300 / 96000, rng.random() * 90 / 111000, i % 50 == 7) for i in range(3000)]
    rows += [(70_000, "x", None, 0.0, False), (70_001, "x", math.nan, 0.0, False), (70_002, None, 0.0, 0.0, False), (70_003, "x", math.inf, 0.0, False)]
    kept = []
    for pos, name, lon, lat, fixed in rows[:63_000]:
        if fixed or not any(n == name and math.hypot((lon - a) * 96000, (lat - b) * 111000) <= 5 for _, n, a, b in kept):
            kept.append((pos, name, lon, lat))
    want = [r[0] for r in kept] + [70_000, 70_001, 70_002, 70_003]
    d = spark.createDataFrame(rows, "pos int, name string, lon double, lat double, fixed boolean").repartition(3)
    for most in (1 << 20, 2000):
        at = d if most > 2000 else d.where("pos >= 60000 OR pos % 8 = 0 OR fixed").withColumn("pos", F.struct("name", "pos"))
        got = sorted((r.pos if most > 2000 else r.pos.pos) for r in spatial.dedupe_near(at, fixed=F.col("fixed"), most=most).select("pos").collect())
        if most > 2000:
            assert got == want
        else:
            again = []
            for pos, name, lon, lat, fixed in (r for r in rows[:63_000] if r[0] >= 60_000 or r[0] % 8 == 0 or r[4]):
                if fixed or not any(n == name and math.hypot((lon - a) * 96000, (lat - b) * 111000) <= 5 for _, n, a, b in again):
                    again.append((pos, name, lon, lat))
            assert got == [r[0] for r in again] + want[-4:]


def test_keep_first_with_equal_orders(spark):
    """Rows of one order are decided together, also where they come in several batches."""
    from reachlake.operators import spatial

    step = 4 / 96000
    rows = [(1, "a", 0.0, 0.0), (2, "a", step, 0.0), (2, "a", 9 * step, 0.0), (3, "a", 10 * step, 0.0), (3, "a", 30 * step, 0.0)]
    d = spark.createDataFrame(rows, "pos int, name string, lon double, lat double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("1", "2", "3", "100"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert sorted(r.pos for r in spatial.dedupe_near(d).select("pos").collect()) == [1, 3, 3]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_ranks_of_a_hot_key(spark):
    """One analysis with most rows, a null one, ties in the score: the same numbers as by a window, and no partition with more than its share."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from reachlake.operators import ranks, selection

    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), rng.choice(["a", "a", "a", "b"]), f"p{i:05d}", rng.choice([None, 1.0, 2.0]), float(rng.randrange(50))) for i in range(4000)]
    d = spark.createDataFrame(rows, "analysis_id int, ring_id string, poi_id string, rating double, travel_time_s double").withColumn("importance", F.lit(None).cast("double")).repartition(5)
    order = [F.desc_nulls_last("rating"), "travel_time_s", "poi_id"]
    want = {r.poi_id: r.n for r in d.withColumn("n", F.row_number().over(Window.partitionBy("analysis_id", "ring_id").orderBy(*order))).collect()}
    got = ranks.ranked(d, ["analysis_id", "ring_id"], order, "n", most=500)
    assert {r.poi_id: r.n for r in got.collect()} == want
    q = {"a": 30, "b": 10}
    a, b = (sorted(r.poi_id for r in selection.select_by_quota(d, q, most=m).where("is_selected").collect()) for m in (500, 1 << 20))
    assert a == b and len(a) > 60
    for f in (lambda m: selection.time_visual_model(d, most=m), lambda m: selection.matrix_batches(d, 100, most=m), lambda m: selection.number_rows(d, "analysis_id", "poi_id", most=m)):
        assert sorted(map(str, f(500).collect())) == sorted(map(str, f(1 << 20).collect()))
    stored = spark.read.parquet(max(__import__("glob").glob(f"{spark.conf.get('spark.checkpoint.dir')}/*/rank-rows-*"), key=__import__("os").path.getmtime))
    sizes = [r["count"] for r in stored.groupBy(F.shiftright("_rank_at", 33)).count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 2 * sorted(sizes)[1]


def test_percentiles_of_a_hot_key(spark):
    """As by aggregates that hold all values: ties, nulls, even and odd numbers, a null key, one row."""
    from pyspark.sql import functions as F

    from reachlake.operators import publish, tiles

    rng = random.Random(2)
    d = spark.createDataFrame([(rng.choice([1, 1, 1, 2, None]), rng.choice([0.05, 0.5, 3.0, 60.0, rng.random() * 50, None])) for _ in range(1500)] + [(3, 7.0)], "k int, area double").repartition(5)
    a, b = (sorted(map(tuple, tiles.area_stats(d, "k", most=m).select("k", "n", "area_min", "area_max", "p10", "median", "p90", "below_1", "above_40").collect()), key=str) for m in (200, 1 << 20))
    assert len(a) == 4 and all(x[0] == y[0] and x[1:] == pytest.approx(y[1:], rel=1e-12) for x, y in zip(a, b, strict=True))
    acc = d.select(F.col("k").alias("analysis_id"), F.monotonically_increasing_id().cast("string").alias("poi_id"), (F.col("area") * 20).alias("duration_s"), (F.col("area") * 7).alias("distance_m"))
    a, b = (sorted(map(tuple, publish.distribution(acc, most=m).collect()), key=str) for m in (200, 1 << 20))
    assert len(a) == 4 and a == b
