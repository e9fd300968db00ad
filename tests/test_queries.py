"""Every query with SQL against DuckDB, and the rest against brute force."""

import pytest
from pyspark.sql import functions as F

from reachlake.plans import queries
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    compare(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


def test_queries_without_sql(spark):
    """Tiles conserve area and adjacency is between neighbours; fingerprints ignore row order."""
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"e3_round_robin_exact", "c10_dedupe_near", "k2_tile_polygons", "k7_tile_adjacency", "d23_area_stats"}
    t = queries.QUERIES["k2_tile_polygons"](spark, SF).groupBy("analysis_id", "range_minutes").agg(F.sum("area").alias("a"))
    p = queries.QUERIES["h11_area_perimeter"](spark, SF)
    assert all(abs(r.a - r.area) < 1e-7 for r in t.join(p, ["analysis_id", "range_minutes"]).collect())
    for r in queries.QUERIES["k7_tile_adjacency"](spark, SF).collect():
        assert abs(r.row1 - r.row2) + abs(r.col1 - r.col2) == 1
    assert queries.QUERIES["d23_area_stats"](spark, SF).count() == 25


def test_dedupe_near_query_against_brute_force(spark):
    import math

    rows = sorted(tuple(r) for r in queries.run_sql(spark, SF.replace("0.001", "0.01"), queries._NAMED).collect())
    kept = []
    for pos, name, lon, lat in rows:
        if not any(n == name and math.hypot((lon - a) * 96000, (lat - b) * 111000) <= 5 for _, n, a, b in kept):
            kept.append((pos, name, lon, lat))
    got = queries.QUERIES["c10_dedupe_near"](spark, SF.replace("0.001", "0.01"))
    assert sorted(r.pos for r in got.collect()) == [r[0] for r in kept] and len(kept) < len(rows)


def test_dedupe_near_query_makes_no_pairs(spark, tmp_path):
    """Sixty times the orders: the rows of the plain walk, and what is written on the way is less than the rows, which have more pairs than that."""
    import glob
    import math

    orders = spark.read.parquet(f"{SF}/orders.parquet")
    n = orders.count()
    orders.crossJoin(spark.range(60).withColumnRenamed("id", "copy")).withColumn("o_orderkey", F.col("o_orderkey") + n * F.col("copy")).drop("copy").write.parquet(f"{tmp_path}/orders.parquet")
    kept, names, pairs = [], {}, 0
    rows = sorted(tuple(r) for r in queries.run_sql(spark, str(tmp_path), queries._NAMED).collect())
    near = lambda a, b: math.hypot((a[2] - b[2]) * 96000, (a[3] - b[3]) * 111000) <= 5
    for r in rows:
        before = names.setdefault(r[1], [])
        close = [(o, stays) for o, stays in before if near(r, o)]
        pairs += len(close)
        stays = not any(s for _, s in close)
        before.append((r, stays))
        kept += [r[0]] * stays
    stored = lambda: set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/{spark.sparkContext.applicationId}/near-*"))
    old = stored()
    got = queries.QUERIES["c10_dedupe_near"](spark, str(tmp_path))
    assert sorted(r.pos for r in got.collect()) == kept
    assert sum(spark.read.parquet(p).count() for p in stored() - old) <= len(rows) < pairs


def test_exact_round_robin_query_against_the_rule(spark):
    from tests.test_operators import plain_round_robin

    by = {}
    for r in queries.matches(spark, SF).collect():
        by.setdefault(r.analysis_id, []).append((r.analysis_id, r.ring_id, r.top_id, r.poi_id))
    want = {a: plain_round_robin(sorted(rows), 100) for a, rows in by.items()}
    got = {}
    for r in queries.QUERIES["e3_round_robin_exact"](spark, SF).orderBy("position").collect():
        got.setdefault(r.analysis_id, []).append(r.poi_id)
    assert got == want


def test_results_do_not_depend_on_row_order(spark):
    """The same rows in other partitions give the same selection."""
    from reachlake.operators import selection

    v = queries.view(spark, SF, "v_score")
    a, b = (selection.select_by_quota(x, queries.QUOTAS).where("is_selected").select("analysis_id", "poi_id").collect() for x in (v, v.repartition(13).orderBy(F.rand(3))))
    assert sorted(a) == sorted(b)


def test_flagship_scans_only_needed_columns(spark):
    plan = queries.QUERIES["flagship_ring_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "o_comment" not in plan
