"""Category paths: trees, rollups, distributions, filters and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_hierarchy(df: DataFrame, *levels: str) -> DataFrame:
    """An ordered path from level columns; a null level ends the path's own entry only."""
    return df.withColumn("hierarchy", F.array_compact(F.array(*levels)))


def assemble_poi(poi: DataFrame, path: DataFrame, alternates: DataFrame) -> DataFrame:
    """poi with hierarchy (path: poi_id, depth, category_id; by depth) and alternates (poi_id, category_id; sorted); none is an empty array."""
    none = F.array().cast("array<string>")
    p = path.groupBy("poi_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "category_id"))), lambda x: x["category_id"]).alias("hierarchy"))
    a = alternates.groupBy("poi_id").agg(F.array_sort(F.collect_set("category_id")).alias("alternates"))
    d = poi.join(p.hint("merge"), "poi_id", "left").join(a.hint("merge"), "poi_id", "left")
    return d.withColumns({c: F.coalesce(c, none) for c in ("hierarchy", "alternates")})


def filter_categories(poi: DataFrame, requested: Column) -> DataFrame:
    """Rows whose path meets the requested ids; an empty request takes all."""
    return poi.where((F.size(requested) == 0) | F.arrays_overlap("hierarchy", requested))


def expand_category_filter(requests: DataFrame, mapping: DataFrame) -> DataFrame:
    """(analysis_id, groups): requested ids through mapping (category_id, group_id), unknown ids dropped."""
    r = requests.select("analysis_id", F.explode("requested").alias("category_id"))
    g = r.join(mapping.hint("merge"), "category_id").groupBy("analysis_id").agg(F.array_sort(F.collect_set("group_id")).alias("groups"))
    return requests.select("analysis_id").distinct().join(g.hint("merge"), "analysis_id", "left").withColumn("groups", F.coalesce("groups", F.array().cast("array<string>")))


def unknown_categories(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Requested ids that no node has."""
    return requests.select("analysis_id", F.explode("requested").alias("category_id")).distinct().join(nodes.select("category_id").distinct().hint("merge"), "category_id", "left_anti")


def path_edges(poi: DataFrame) -> DataFrame:
    """(category_id, parent_id, top_id, depth) for every place on every path, repeats removed."""
    e = poi.select("hierarchy", F.posexplode("hierarchy").alias("depth", "category_id"))
    parent = F.when(F.col("depth") > 0, F.get("hierarchy", F.col("depth") - 1))
    return e.select("category_id", parent.alias("parent_id"), F.col("hierarchy")[0].alias("top_id"), "depth").distinct()


def category_nodes(poi: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, conflicts): one row a category, and those seen under two parents or top levels."""
    by = path_edges(poi).groupBy("category_id").agg(F.min("parent_id").alias("parent_id"), F.min("top_id").alias("top_id"), F.min("depth").alias("depth"), F.countDistinct(F.struct(F.coalesce("parent_id", F.lit("")), "top_id")).alias("n"))
    return by.drop("n"), by.where("n > 1").select("category_id", F.col("n").alias("n_parents"))


def category_stats(poi: DataFrame) -> DataFrame:
    """Rows for each node on a path."""
    return poi.select(F.explode("hierarchy").alias("category_id")).groupBy("category_id").agg(F.count("*").alias("n"))


def category_distributions(poi: DataFrame, top: str = "top_id", basic: str = "basic_id", primary: str = "primary_id") -> DataFrame:
    """Counts by each of three levels in one pass; null ids are dropped."""
    d = poi.groupingSets([[top], [basic], [primary]], top, basic, primary).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    kind = F.when(F.col("g") == 3, "top").when(F.col("g") == 5, "basic").otherwise("primary")
    return d.select(kind.alias("level"), F.coalesce(top, basic, primary).alias("category_id"), "n").where("category_id is not null")


def category_rollup(matches: DataFrame) -> DataFrame:
    """Per analysis and node: matched, returned (is_selected), ring counts as a map, children, depth, is_leaf.

    matches: analysis_id, ring_id, hierarchy, is_selected. Counts are summed by (analysis, node, ring) before maps and sets
    are built, so these hold one entry a ring or child.
    """
    e = matches.select("analysis_id", "ring_id", "is_selected", "hierarchy", F.posexplode("hierarchy").alias("depth", "category_id"))
    e = e.select("analysis_id", "category_id", "depth", "ring_id", "is_selected", F.get("hierarchy", F.col("depth") + 1).alias("child"))
    rings = e.groupBy("analysis_id", "category_id", "ring_id").agg(F.count("*").alias("n"), F.count_if("is_selected").alias("s"), F.min("depth").alias("depth"), F.collect_set("child").alias("kids"))
    return rings.groupBy("analysis_id", "category_id").agg(
        F.sum("n").alias("matched"), F.sum("s").alias("returned"), F.min("depth").alias("depth"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("ring_id", "n")))).alias("ring_counts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("kids")))).alias("children"),
    ).withColumn("is_leaf", F.size("children") == 0)


def ring_category_counts(matches: DataFrame, rings: list[str], category: str = "top_id") -> DataFrame:
    """Wide counts: a row for each analysis and category, a column a ring."""
    return matches.groupBy("analysis_id", category).pivot("ring_id", rings).count().na.fill(0, rings)


def category_children(nodes: DataFrame) -> DataFrame:
    """Sorted children of every node; leaves have none."""
    kids = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("category_id")).agg(F.array_sort(F.collect_set("category_id")).alias("children"))
    return nodes.select("category_id").distinct().join(kids.hint("merge"), "category_id", "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def top_children(nodes: DataFrame, counts: DataFrame, n: int = 8) -> DataFrame:
    """The n largest children of each parent; ties by id."""
    w = Window.partitionBy("parent_id").orderBy(F.desc("n"), "category_id")
    return nodes.where("parent_id is not null").join(counts.hint("merge"), "category_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("parent_id", "category_id", "n", "rank")


def title_case(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def label_categories(df: DataFrame, labels: DataFrame, column: str = "category_id") -> DataFrame:
    """label: the known one, else the id in title case."""
    return df.join(labels.select(F.col("category_id").alias(column), F.col("label").alias("_known")), column, "left").withColumn("label", F.coalesce("_known", title_case(F.col(column)))).drop("_known")


def map_provider_category(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """group_id: of the first category id that the catalog (category_id, group_id) knows, else the first known group id."""
    pairs = df.select("row_id", F.posexplode("category_ids").alias("pos", "category_id")).join(catalog.hint("merge"), "category_id")
    first = pairs.groupBy("row_id").agg(F.min_by("group_id", "pos").alias("g1"))
    groups = df.select("row_id", F.posexplode("group_ids").alias("pos", "group_id")).join(catalog.select("group_id").distinct().hint("merge"), "group_id").groupBy("row_id").agg(F.min_by("group_id", "pos").alias("g2"))
    return df.join(first.hint("merge"), "row_id", "left").join(groups.hint("merge"), "row_id", "left").withColumn("group_id", F.coalesce("g1", "g2")).drop("g1", "g2")


def valid_path(hierarchy: Column) -> Column:
    """Not empty, no blanks, no repeats."""
    return F.coalesce((F.size(hierarchy) > 0) & F.forall(hierarchy, lambda x: F.trim(x) != "") & (F.size(F.array_distinct(hierarchy)) == F.size(hierarchy)), F.lit(False))


def deepest_valid_ancestor(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """For (row_id, hierarchy): the longest prefix whose edges are all in nodes (category_id, parent_id)."""
    e = paths.select("row_id", "hierarchy", F.posexplode("hierarchy").alias("depth", "category_id")).withColumn("parent_id", F.when(F.col("depth") > 0, F.get("hierarchy", F.col("depth") - 1)))
    n = nodes.select(F.col("category_id").alias("c"), F.col("parent_id").alias("p"), F.lit(True).alias("known"))
    j = e.join(n.hint("merge"), (F.col("category_id") == F.col("c")) & F.col("parent_id").eqNullSafe(F.col("p")), "left")
    broken = F.min(F.when(F.col("known").isNull(), F.col("depth")))
    d = j.groupBy("row_id", "hierarchy").agg(F.coalesce(broken, F.size("hierarchy")).alias("valid_depth"))
    return d.withColumn("ancestor", F.get("hierarchy", F.col("valid_depth") - 1))
