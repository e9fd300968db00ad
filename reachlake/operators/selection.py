"""Ranked selection: quotas, fair limits, batches, display ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import keep
from .overlay import _meet
from .ranks import MOST, ranked
from .spatial import dedupe_near, points_in_polygons


def score_of(*columns: str) -> Column:
    """First of the columns that is a number."""
    return F.coalesce(*(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns))


def select_by_quota(eligible: DataFrame, quotas: dict[str, int], columns: tuple[str, ...] = ("rating", "importance"), most: int = MOST) -> DataFrame:
    """Adds rank and is_selected: per analysis and ring by score (missing last), time, id; rings are not back-filled."""
    quota = F.lit(0)
    for ring, n in quotas.items():
        quota = F.when(F.col("ring_id") == ring, n).otherwise(quota)
    order = [F.desc_nulls_last("score"), "travel_time_s", "poi_id"]
    return ranked(eligible.withColumn("score", score_of(*columns)), ["analysis_id", "ring_id"], order, "rank", most).withColumn("is_selected", F.col("rank") <= quota)


def nested_presets(small: DataFrame, large: DataFrame) -> DataFrame:
    """One row: how many rows selected in small are not in large, and whether none is."""
    keys = ["analysis_id", "poi_id"]
    return small.where("is_selected").join(large.where("is_selected").select(*keys), keys, "left_anti").agg(F.count("*").alias("missing")).withColumn("nested", F.col("missing") == 0)


def match_order(matches: DataFrame) -> DataFrame:
    """Adds position: by ring_id, top_id, hierarchy (arrays compare place by place) and poi_id in each analysis."""
    return ranked(matches, ["analysis_id"], ["ring_id", "top_id", "hierarchy", "poi_id"], "position")


def round_robin_limit(matches: DataFrame, n: int, exact: bool = False) -> DataFrame:
    """At most n rows an analysis, dealt over (ring_id, top_id) groups in order, rows of a group by (hierarchy, if there is one, poi_id).

    Fair mode takes every group's first row, then every second row, ... Exact mode steps a counter through the groups that are left
    and takes it modulo their number, also after a group has left, so a group may be passed over; an analysis of
    n rows or fewer keeps its match order. Only group sizes meet in Python there.
    """
    groups = ["analysis_id", "ring_id", "top_id"]
    order = ["hierarchy", "poi_id"] if "hierarchy" in matches.columns else ["poi_id"]
    first = matches.withColumn("rn", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    first = first.where(F.col("rn") <= n)  # no group gives more rows; each map task keeps n of a group at most
    if not exact:
        w = Window.partitionBy("analysis_id").orderBy("rn", "ring_id", "top_id")
        return first.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).drop("rn")

    def deal(pdf):
        import pandas as pd

        sizes = [(r.ring_id, r.top_id, int(r.n)) for r in pdf.sort_values(["ring_id", "top_id"]).itertuples()]
        if sum(k for _, _, k in sizes) <= n:
            turns = [(ring, top, i) for ring, top, k in sizes for i in range(1, k + 1)]
        else:
            taken, live, turns = [0] * len(sizes), list(range(len(sizes))), []
            while len(turns) < n:
                at = len(turns) % len(live)
                g = live[at]
                taken[g] += 1
                turns.append((*sizes[g][:2], taken[g]))
                if taken[g] == sizes[g][2]:
                    del live[at]
        return pd.DataFrame([(pdf.analysis_id.iloc[0], *t, i) for i, t in enumerate(turns, 1)], columns=["analysis_id", "ring_id", "top_id", "rn", "position"])

    kind = matches.schema["analysis_id"].dataType.simpleString()
    plan = matches.groupBy(*groups).agg(F.count("*").alias("n")).groupBy("analysis_id").applyInPandas(deal, f"analysis_id {kind}, ring_id string, top_id string, rn int, position int")
    return first.join(plan.hint("merge"), [*groups, "rn"]).drop("rn")


def limit_per_analysis(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy("analysis_id").orderBy(*order))).where(F.col("position") <= n)


def selection_stats(selected: DataFrame) -> DataFrame:
    """Per analysis: matched, returned, truncated."""
    return selected.groupBy("analysis_id").agg(F.count("*").alias("matched"), F.count_if("is_selected").alias("returned")).withColumn("truncated", F.col("returned") < F.col("matched"))


def time_visual_model(df: DataFrame, most: int = MOST) -> DataFrame:
    """font_size by time rank in the analysis (12 + 14 (1 - rank/(n-1))^0.75) and opacity by rank in the ring (1 to 0.55)."""
    order = ["travel_time_s", "poi_id"]
    ring = ["analysis_id", "ring_id"]
    sizes = keep(df.groupBy(*ring).agg(F.count("*").alias("_m")), "ring-sizes")
    whole = sizes.groupBy("analysis_id").agg(F.sum("_m").alias("_n"))
    d = ranked(ranked(df, ["analysis_id"], order, "_i", most), ring, order, "_j", most)
    d = _meet(d, _meet(sizes, whole, ["analysis_id"], "merge"), ring, "merge").withColumns({"_i": F.col("_i") - 1, "_j": F.col("_j") - 1})
    font = 12 + 14 * F.pow(1 - F.col("_i") / F.greatest(F.col("_n") - 1, F.lit(1)), F.lit(0.75))
    return d.withColumns({"font_size": F.round(font, 6), "opacity": F.round(1 - 0.45 * F.col("_j") / F.greatest(F.col("_m") - 1, F.lit(1)), 6)}).drop("_i", "_n", "_j", "_m")


def matrix_batches(poi: DataFrame, size: int = 500, most: int = MOST) -> DataFrame:
    """Batches of ids in order: (analysis_id, batch, poi_ids, n, fingerprint)."""
    d = ranked(poi, ["analysis_id"], ["poi_id"], "_number", most).withColumn("batch", F.floor((F.col("_number") - 1) / size)).drop("_number")
    b = d.groupBy("analysis_id", "batch").agg(F.array_sort(F.collect_list("poi_id")).alias("poi_ids"))
    return b.withColumns({"n": F.size("poi_ids"), "fingerprint": F.sha2(F.array_join("poi_ids", "|"), 256)})


def validate_batches(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Per planned batch: ok, missing, wrong-profile or wrong-order."""
    r = results.select("batch_id", F.col("profile").alias("_profile"), F.col("poi_ids").alias("_ids"))
    j = plan.join(r.hint("merge"), "batch_id", "left")
    why = F.when(F.col("_ids").isNull(), "missing").when(F.col("profile") != F.col("_profile"), "wrong-profile").when(F.col("poi_ids") != F.col("_ids"), "wrong-order").otherwise("ok")
    return j.select("batch_id", why.alias("verdict"))


def number_rows(df: DataFrame, key: str, *order: str, most: int = MOST) -> DataFrame:
    """Stable numbers from 1 in each key."""
    return ranked(df, [key], list(order), "number", most)


def dedupe_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in a total order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def merge_pieces(results: DataFrame, pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, counts) of plans whose pieces are all complete and not truncated.

    Rows without an id stay; of rows with the same (source, source_id) in a plan the first in (piece, pos) stays. merge_piece_results
    also tests the outer polygon and near-duplicate names.
    """
    r = _publishable(results, pieces)
    key = F.coalesce("source_id", F.concat(F.lit("row:"), F.col("piece").cast("string"), F.lit(":"), F.col("pos").cast("string")))
    r = r.withColumn("_key", key)
    first = dedupe_first(r, ["plan_id", "source", "_key"], "piece", "pos").drop("_key")
    counts = r.groupBy("plan_id").agg(F.count("*").alias("raw"), F.countDistinct("source", "_key").alias("merged")).withColumn("duplicate", F.col("raw") - F.col("merged"))
    return first, counts


def _publishable(results: DataFrame, pieces: DataFrame) -> DataFrame:
    bad = pieces.where("not complete or truncated").select("plan_id").distinct()
    return results.join(bad.hint("merge"), "plan_id", "left_anti")


def merge_piece_results(results: DataFrame, pieces: DataFrame, outer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, counts: plan_id, raw, outside, duplicate, merged) of plans whose pieces are all complete and not truncated.

    results: plan_id, piece, pos (unique in a piece), source, source_id, name, lon, lat; outer: plan_id, edges, box. In (piece, pos) order: a row without
    valid coordinates or not covered by its plan's outer polygon is outside; one whose (source, source_id) is there
    is a duplicate; one without an id is a duplicate if a row that stays has its name within 5 m.
    """
    r = _publishable(results, pieces).withColumns({"_o": F.struct("piece", "pos"), "source_id": F.nullif("source_id", F.lit(""))})
    ok = F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)
    hit = points_in_polygons(r.where(ok), outer, on=("plan_id",))
    inside = keep(hit, "merge-inside")
    # Rows with an id: the first of each; rows without one go on as they are.
    first = inside.where("source_id is not null").groupBy("plan_id", "source", "source_id").agg(F.min("_o").alias("_o"))
    named = inside.where("source_id is not null").join(first.hint("merge"), ["plan_id", "source", "source_id", "_o"], "left_semi")
    both = keep(named.unionByName(inside.where("source_id is null")), "merge-ids")
    scope = F.concat(F.col("plan_id").cast("string"), F.lit(":"), F.coalesce("name", F.lit("")))
    rows = dedupe_near(both.withColumns({"_name": scope, "_at": F.struct("plan_id", "piece", "pos")}), name="_name", order="_at", fixed=F.col("source_id").isNotNull())
    rows = keep(rows.drop("_name", "_at", "_o"), "merge-rows")
    count = lambda d, name: d.groupBy("plan_id").agg(F.count("*").alias(name))
    counts = count(r, "raw").join(count(inside, "_in").hint("merge"), "plan_id", "left").join(count(rows, "merged").hint("merge"), "plan_id", "left").na.fill(0, ["_in", "merged"])
    return rows, counts.select("plan_id", "raw", (F.col("raw") - F.col("_in")).alias("outside"), (F.col("_in") - F.col("merged")).alias("duplicate"), "merged")


def merge_batches(plan: DataFrame, results: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, summary) of matrix batches by plan_id.

    plan: plan_id, batch_id, profile, status, poi_ids; results: batch_id, profile, poi_ids; rows: batch_id, poi_id, status, band. A plan is published only
    if every batch is completed or a cache hit, came back in order and is of the plan's profile; else its reason is
    partial_matrix_batches, batch_result_order_mismatch or cross_profile_accessibility (of its first such batch).
    """
    r = results.select("batch_id", F.col("profile").alias("_profile"), F.col("poi_ids").alias("_ids"))
    b = plan.join(r.hint("merge"), "batch_id", "left")
    why = (
        F.when(~F.coalesce(F.col("status").isin("completed", "cache-hit"), F.lit(False)), "partial_matrix_batches")
        .when(~F.coalesce(F.col("poi_ids") == F.col("_ids"), F.lit(False)), "batch_result_order_mismatch")
        .when(~F.coalesce(F.col("profile") == F.col("_profile"), F.lit(False)), "cross_profile_accessibility")
    )
    verdict = b.withColumn("why", why).groupBy("plan_id").agg(F.min_by("why", F.when(F.col("why").isNotNull(), F.col("batch_id"))).alias("reason"))
    good = plan.select("plan_id", "batch_id").join(verdict.where("reason is null").hint("merge"), "plan_id", "left_semi")
    merged = rows.join(good.hint("merge"), "batch_id").drop("batch_id")
    band = F.col("band") == "matrix-out-of-range"
    n = merged.groupBy("plan_id").agg(F.count("*").alias("destinations"), *(F.count_if(F.col("status") == s).alias(s) for s in ("ok", "unreachable", "invalid")), F.count_if(band).alias("out_of_range"))
    summary = verdict.join(n.hint("merge"), "plan_id", "left")
    conserved = F.col("reason").isNull() & (F.col("destinations") == F.col("ok") + F.col("unreachable") + F.col("invalid"))
    return merged, summary.withColumn("publishable", F.coalesce(conserved, F.lit(False)))


def filter_visible(df: DataFrame, column: str, values: list[str] | None) -> DataFrame:
    """Rows whose column is one of the values; None shows all."""
    return df if values is None else df.where(F.col(column).isin(list(values)))


def sample_rows(df: DataFrame, n: int, keys: list[str], *order: str) -> DataFrame:
    """The first n rows of each key in order, for audits."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_i") <= n).drop("_i")


def guard_area(analysis: DataFrame, most_km2: float = 45.0) -> DataFrame:
    """status area-limit where area_km2 is above the limit, else ok."""
    return analysis.withColumn("status", F.when(F.col("area_km2") > most_km2, "area-limit").otherwise("ok"))


def provider_coverage(df: DataFrame, seen: str = "source_id") -> DataFrame:
    """Per analysis: received, deduplicated, a count by reason (unnamed, invalid), matched and returned rows.

    Columns reason (null is valid), is_match, is_selected. Ids are counted once through a grouping by id first.
    """
    by = df.groupBy("analysis_id", F.coalesce(F.col(seen), F.lit("")).alias("_id")).agg(
        F.count("*").alias("n"), F.count_if(F.col("reason") == "name-missing").alias("unnamed"), F.count_if(F.col("reason").isNotNull() & (F.col("reason") != "name-missing")).alias("invalid"),
        F.max(F.col("reason").isNull() & F.col("is_match")).alias("m"), F.max(F.col("reason").isNull() & F.col("is_selected")).alias("s"),
    )
    return by.groupBy("analysis_id").agg(F.sum("n").alias("received"), F.count_if(F.col("_id") != "").alias("deduplicated"), F.sum("unnamed").alias("unnamed"), F.sum("invalid").alias("invalid"), F.count_if("m").alias("matched"), F.count_if("s").alias("returned"))


def merge_preview(results: DataFrame, preview: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): an analysis's rows are replaced by its preview rows if it has any, and rings are counted anew.

    Both have analysis_id, ring_id, poi_id, warning; distinct warnings of both sides are united in counts.
    """
    has = preview.select("analysis_id").distinct()
    rows = results.join(has.hint("merge"), "analysis_id", "left_anti").unionByName(preview)
    warn = results.unionByName(preview).groupBy("analysis_id").agg(F.array_sort(F.collect_set("warning")).alias("warnings"))
    return rows, rows.groupBy("analysis_id", "ring_id").agg(F.count("*").alias("n")).join(warn.hint("merge"), "analysis_id")
