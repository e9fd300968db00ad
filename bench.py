"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from reachlake.plans import queries as Q  # noqa: E402

HEADLINE = ("flagship_ring_counts", "c2_assign_rings", "c5_publish", "e2_select_by_quota", "d5_category_rollup", "c12_pairwise_retention", "d15_direction_metrics", "b3_classify_features", "k5_adaptive_tiles", "d21_ledger_totals", "c14_nearest_gap", "g1_merge_piece_results", "k2_tile_polygons")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    times, rows = {}, {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the first run compiles
            t = time.time()
            rows[name] = len(Q.QUERIES[name](spark, sf_dir).toPandas())
            best = min(time.time() - t, best or 1e9)
        times[name] = round(best, 3)
    n_poi = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    n_node = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    rate = {"flagship_points_per_s": round(n_poi / times["flagship_ring_counts"]), "publish_rows_per_s": round(n_poi / times["c5_publish"]), "quota_rows_per_s": round(n_poi / times["e2_select_by_quota"]), "pair_nodes_per_s": round(n_node / times["c12_pairwise_retention"])}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "rows": rows, "rates": rate, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
