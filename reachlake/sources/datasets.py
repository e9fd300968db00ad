"""Datasets and result files: idempotent publish, fingerprints, response records, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.publish import set_hashes
from ..operators.tiles import morton

#: Bits of a coordinate in the order by place.
PLACE_BITS = 20


def content_fingerprint(df: DataFrame) -> DataFrame:
    """One row, whatever the row order: count and two sums of hashes of the rows' JSON texts, in which repeated rows count."""
    return df.agg(F.count("*").alias("n"), *set_hashes(F.to_json(F.struct(*df.columns))))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each input file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def by_place(df: DataFrame) -> DataFrame:
    """Rows (lon, lat) range-partitioned and sorted along a Z curve, so that a file and a row group are a small area; rows without a place come first."""
    side = 1 << PLACE_BITS
    step = lambda c, low, span: F.least(F.lit(side - 1), F.greatest(F.lit(0), F.floor((F.col(c) - low) / span * side))).cast("bigint")
    z = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), morton(step("lon", -180, 360), step("lat", -90, 180), PLACE_BITS))
    return df.withColumn("_z", z).repartitionByRange("_z").sortWithinPartitions("_z").drop("_z")


def publish_dataset(df: DataFrame, path: str, dataset_id: str, release: str, replace: bool = False, region_id: str | None = None, places: bool = False) -> str:
    """Write rows under dataset_id: "unchanged" for equal content, an error for other content without replace, else "published".

    Rows go to a folder of their own for each content; the registry row that names it is the commit, and older folders of the
    dataset are deleted after it. A writer that dies before leaves the old content in place, one that dies after
    leaves folders that no reader of the registry takes (read_dataset). No rows are content like any other. With `places`, rows (lon, lat) are laid out by place and a
    table of each file's bounds is written beside them for read_box.
    """
    spark = df.sparkSession
    fp = content_fingerprint(df).first()
    mark = f"{fp['n']}-{fp['fp_a']}-{fp['fp_b']}"
    registry, rows = f"{path}/registry", f"{path}/rows/dataset_id={dataset_id}"
    if _exists(spark, registry):
        old = spark.read.parquet(registry).where(F.col("dataset_id") == dataset_id).first()
        if old and old["release"] == release and old["fingerprint"] == mark:
            return "unchanged"
        if old and not replace:
            raise ValueError(f"dataset {dataset_id} has other content; pass replace=True")
    (by_place(df) if places else df).write.mode("overwrite").parquet(f"{rows}/content={mark}")
    if places:
        bounds = [f(c).alias(f"{n}_{c}") for c in ("lon", "lat") for n, f in (("least", F.min), ("most", F.max))]
        files = spark.read.schema(df.schema).parquet(f"{rows}/content={mark}").groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(*bounds, F.count("*").alias("n"))
        files.write.mode("overwrite").parquet(f"{path}/places/dataset_id={dataset_id}/content={mark}")
    row = spark.createDataFrame([(dataset_id, release, region_id, mark, int(fp["n"]), True)], "dataset_id string, release string, region_id string, fingerprint string, n_rows bigint, ready boolean")
    row.write.partitionBy("dataset_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(registry)
    folder = spark._jvm.org.apache.hadoop.fs.Path(rows)
    for x in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder):
        if x.getPath().getName() != f"content={mark}":
            _delete(spark, f"{rows}/{x.getPath().getName()}")
    return "published"


def read_dataset(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """The rows that the registry names for dataset_id."""
    row = spark.read.parquet(f"{path}/registry").where(F.col("dataset_id") == dataset_id).first()
    if row is None:
        raise ValueError(f"no dataset {dataset_id}")
    return spark.read.parquet(f"{path}/rows/dataset_id={dataset_id}/content={row['fingerprint']}")


def read_box(spark: SparkSession, path: str, dataset_id: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """The dataset's rows in a box, bounds included. Of a dataset published with places only files that reach into the box are opened, and of these the row groups that do."""
    row = spark.read.parquet(f"{path}/registry").where(F.col("dataset_id") == dataset_id).first()
    if row is None:
        raise ValueError(f"no dataset {dataset_id}")
    content = f"dataset_id={dataset_id}/content={row['fingerprint']}"
    rows = spark.read.parquet(f"{path}/rows/{content}")
    if _exists(spark, f"{path}/places/{content}"):
        fit = (F.col("least_lon") <= east) & (F.col("most_lon") >= west) & (F.col("least_lat") <= north) & (F.col("most_lat") >= south)
        names = [r["file"] for r in spark.read.parquet(f"{path}/places/{content}").where(fit).select("file").collect()]  # as many as files are read
        rows = spark.read.schema(rows.schema).parquet(*(f"{path}/rows/{content}/{n}" for n in names)) if names else rows.where("false")
    return rows.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def list_ready_datasets(registry: DataFrame) -> DataFrame:
    """Datasets that are ready, by release, region and id."""
    return registry.where("ready").orderBy("release", "region_id", "dataset_id")


def read_response_records(spark: SparkSession, root: str, schema: str, names: str = "*.json") -> DataFrame:
    """JSON records of all folders under root whose file names fit; unreadable files are left out."""
    d = spark.read.schema(f"{schema}, _corrupt_record string").option("recursiveFileLookup", True).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", names).json(root)
    return d.where("_corrupt_record is null").drop("_corrupt_record")


def geojson_lines(points: DataFrame, properties: list[str]) -> tuple[DataFrame, DataFrame]:
    """(lines, rejected): a GeoJSON feature text for each valid point, and the rows that have none with a reason."""
    ok = F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)
    valid = F.coalesce(ok, F.lit(False))
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    line = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))
    return points.where(valid).select(line.alias("value")), points.where(~valid).withColumn("reason", F.lit("invalid-coordinates"))


def write_geojson_features(points: DataFrame, properties: list[str], path: str) -> None:
    geojson_lines(points, properties)[0].write.text(path)


def _geometry_text(polygon) -> Column:
    """GeoJSON text of a polygon column: Polygon for one part, MultiPolygon for more; rings are closed."""
    ring = lambda r: F.transform(F.when(F.element_at(r, -1) == r[0], r).otherwise(F.concat(r, F.slice(r, 1, 1))), lambda v: F.array(v["x"], v["y"]))
    parts = F.transform(polygon, lambda p: F.transform(p, ring))
    text = lambda kind, coordinates: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), F.to_json(coordinates), F.lit("}"))
    return F.when(F.size(polygon) == 1, text("Polygon", parts[0])).otherwise(text("MultiPolygon", parts))


def _feature_text(ident, geometry, properties: list) -> Column:
    return F.concat(F.lit('{"type":"Feature","id":'), F.to_json(F.array(ident)).substr(F.lit(2), F.length(F.to_json(F.array(ident))) - 2), F.lit(',"properties":'), F.to_json(F.struct(*properties)), F.lit(',"geometry":'), geometry, F.lit("}"))


def ring_features(rings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(analysis_id, value: a GeoJSON feature a ring; rejected) of rings (analysis_id, ring_id, inner_minutes, outer_minutes, polygon).

    Rings without a polygon have no feature; one with a vertex out of bounds is rejected. A null ring_id becomes ring- and the outer minutes.
    """
    d = rings.where(F.size("polygon") > 0)
    inside = lambda v: F.coalesce(v["x"].between(-180, 180) & v["y"].between(-90, 90), F.lit(False))
    ok = F.forall(F.flatten(F.flatten("polygon")), inside) & F.forall(F.flatten("polygon"), lambda r: F.size(r) > 2)
    ident = F.coalesce("ring_id", F.concat(F.lit("ring-"), F.col("outer_minutes").cast("string")))
    value = _feature_text(ident, _geometry_text(F.col("polygon")), [ident.alias("ringId"), F.col("inner_minutes").alias("innerRangeMinutes"), F.col("outer_minutes").alias("outerRangeMinutes")])
    return d.where(ok).select("analysis_id", value.alias("value")), d.where(~ok).withColumn("reason", F.lit("invalid-coordinates"))


def centre_features(centres: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of centres (analysis_id, label, lon, lat), with the id analysis-center; a null label is empty."""
    ok = F.coalesce(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90), F.lit(False))
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    value = _feature_text(F.lit("analysis-center"), point, [F.coalesce("label", F.lit("")).alias("label")])
    return centres.where(ok).select("analysis_id", value.alias("value")), centres.where(~ok).withColumn("reason", F.lit("invalid-coordinates"))


def nested_results(published: DataFrame) -> DataFrame:
    """One document an analysis; rows are gathered by ring first. An analysis's document has to fit a row."""
    rings = published.groupBy("analysis_id", "ring_id").agg(F.array_sort(F.collect_list(F.struct("poi_id", "travel_time_s", "distance_m"))).alias("pois"))
    rings = rings.withColumn("n", F.size("pois"))
    return rings.groupBy("analysis_id").agg(F.array_sort(F.collect_list(F.struct("ring_id", "n", "pois"))).alias("rings"), F.sum("n").alias("poi_count")).withColumn("schema_version", F.lit("2.0"))


def write_results(published: DataFrame, path: str) -> None:
    """Result documents as JSON lines, one an analysis."""
    nested_results(published).write.json(path)
