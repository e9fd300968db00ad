"""Place features: readers, flattening, reject reasons, reports."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import address_text, choose_name, filled, merge_tags, provider_name
from ..lineage import keep
from ..operators.publish import finite

GEOMETRY = "struct<type:string,coordinates:array<double>>"
PROPERTIES = (
    "struct<id:string,GERS_ID:string,version:string,names:struct<primary:string,common:map<string,string>>,"
    "taxonomy:struct<hierarchy:array<string>,primary:string,alternates:array<string>>,basic_category:string,operating_status:string,confidence:string,"
    "addresses:array<struct<freeform:string,value:string,locality:string,street:string,postcode:string>>>"
)
ONE = f"type:string,id:string,version:string,geometry:{GEOMETRY},properties:{PROPERTIES}"
FILE = f"struct<{ONE},features:array<struct<{ONE}>>>"
#: gers_id apart, as names that differ in case only can't share a struct.
LOWER = "struct<properties:struct<gers_id:string>,features:array<struct<properties:struct<gers_id:string>>>>"
FIELDS = ("type", "id", "gers_id", "version", "geometry", "properties")


def features_of(text: Column, options: dict | None = None) -> Column:
    """Array of the features of a JSON text: a FeatureCollection, an array of features, or one feature."""
    listed = F.trim(text).startswith("[")
    whole = F.when(listed, F.concat(F.lit('{"features":'), text, F.lit("}"))).otherwise(text)

    def make(a: Column, b: Column) -> Column:
        return F.struct(a["type"].alias("type"), a["id"].alias("id"), b["properties"]["gers_id"].alias("gers_id"), a["version"].alias("version"), a["geometry"].alias("geometry"), a["properties"].alias("properties"))

    both = F.struct(F.from_json(whole, FILE, options or {}).alias("a"), F.from_json(whole, LOWER, options or {}).alias("b"))
    return F.transform(F.array(both), lambda x: F.when(x["a"]["features"].isNull(), F.array(make(x["a"], x["b"]))).otherwise(F.zip_with(x["a"]["features"], x["b"]["features"], make)))[0]


def parse_features(lines: DataFrame, column: str = "line") -> DataFrame:
    """Adds type, id, gers_id, version, geometry and properties from a column with one feature's JSON text, which is parsed once a row."""
    one = F.from_json(F.col(column), f"struct<{ONE}>")
    # The generator keeps the parse from being repeated in every column that is taken out of it.
    d = lines.withColumn("_f", F.explode(F.array(one))).withColumn("_g", F.when(F.col("_f.id").isNull(), F.get_json_object(F.col(column), "$.properties.gers_id")))
    return d.select("*", *(F.col("_g").alias(c) if c == "gers_id" else F.col(f"_f.{c}").alias(c) for c in FIELDS)).drop("_f", "_g")


def _read(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    """Lines or whole files with _pos: file, start of the block that was read, and row in it, which are in reading order however blocks are packed."""
    d = spark.read.option("wholetext", whole).text(path)
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return d.withColumn("_pos", F.struct(*place))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """A FeatureCollection, an array of features or one feature per file; files are read in parallel."""
    d = _read(spark, path, True).select("_pos", F.posexplode(features_of(F.col("value"))).alias("i", "f"))
    return d.select("_pos", "i", *(F.col(f"f.{c}").alias(c) for c in FIELDS))


def read_geojsonl(spark: SparkSession, path: str) -> DataFrame:
    """One feature per line: blank lines and lines that are not objects are skipped, bad JSON fails."""
    d = _read(spark, path, False).where(F.trim("value").startswith("{")).select("_pos", F.explode(F.slice(features_of(F.when(F.trim("value").startswith("{"), F.col("value")), {"mode": "FAILFAST"}), 1, 1)).alias("f"))
    return d.select("_pos", F.lit(0).alias("i"), *(F.col(f"f.{c}").alias(c) for c in FIELDS))


@F.pandas_udf(T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.DoubleType()))]))
def wkb_point(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Point of WKB bytes (either byte order, Z or SRID allowed); null coordinates for anything else."""

    def decode(b):
        try:
            order = "<" if b[0] == 1 else ">"
            (kind,) = struct.unpack_from(f"{order}I", b, 1)
            at = 9 if kind & 0x20000000 else 5
            if (kind & 0xFFFF) % 1000 == 1:
                return list(struct.unpack_from(f"{order}dd", b, at))
        except (TypeError, IndexError, struct.error):
            pass
        return None

    for s in batches:
        c = s.map(decode)
        yield pd.DataFrame({"type": c.map(lambda x: "Point" if x is not None else None), "coordinates": c})


@F.pandas_udf(T.BinaryType())
def point_wkb(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Little-endian WKB of points; null if a coordinate is."""
    for lon, lat in batches:
        yield pd.Series([None if x != x or y != y else struct.pack("<BIdd", 1, 1, x, y) for x, y in zip(lon, lat, strict=True)], dtype=object)


def read_geoparquet(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    """Features of Parquet with a WKB point column: other columns are the properties; a geometry that can't be decoded is null."""
    d = spark.read.parquet(path).withColumn("_pos", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("block"), F.lit(0).cast("bigint").alias("row")))
    there = {c.lower(): c for c in d.columns}
    known = [f.name for f in T._parse_datatype_string(PROPERTIES).fields if f.name.lower() in there and f.name != "id"]
    properties = F.from_json(F.to_json(F.struct(*(F.col(there[k.lower()]).alias(k) for k in known))), PROPERTIES) if known else F.lit(None).cast(PROPERTIES)
    g = wkb_point(F.col(geometry))
    text = lambda k: F.col(there[k]).cast("string") if k in there else F.lit(None).cast("string")
    return d.select("_pos", F.lit(0).alias("i"), F.lit("Feature").alias("type"), F.col(there["id"]).alias("id") if "id" in there else F.lit(None).cast("string").alias("id"), text("gers_id").alias("gers_id"), text("version").alias("version"), F.when(g["coordinates"].isNotNull(), g).alias("geometry"), properties.alias("properties"))


def write_geoparquet(points: DataFrame, path: str) -> None:
    """Rows with lon and lat as Parquet with a WKB point column `geometry` in their place."""
    points.withColumn("geometry", point_wkb("lon", "lat")).drop("lon", "lat").write.parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Reader by suffix."""
    if path.endswith((".parquet", ".geoparquet")):
        return read_geoparquet(spark, path)
    return read_geojsonl(spark, path) if path.endswith((".jsonl", ".geojsonl", ".ndjson")) else read_geojson(spark, path)


def flatten_features(features: DataFrame, preferred: list[str] = ()) -> DataFrame:
    """source_id (with its fallbacks), poi_id, lon, lat, name, address, path columns and raw quality fields."""
    p = F.col("properties")
    common = F.transform(F.map_entries(p["names"]["common"]), lambda e: F.struct(e["value"].alias("value"), e["key"].alias("locale"), F.lit(False).alias("primary")))
    names = F.concat(F.array(F.struct(p["names"]["primary"].alias("value"), F.lit("").alias("locale"), F.lit(True).alias("primary"))), F.coalesce(common, F.array().cast("array<struct<value:string,locale:string,primary:boolean>>")))
    point = F.col("geometry.type") == "Point"
    sid = F.coalesce(filled(F.col("id")), filled(p["id"]), filled(p["GERS_ID"]), filled(F.col("gers_id")))
    return features.select(
        *(c for c in features.columns if c not in FIELDS),
        sid.alias("source_id"), F.concat(F.lit("overture:"), sid).alias("poi_id"),
        F.when(point, finite(F.get("geometry.coordinates", F.lit(0)))).alias("lon"), F.when(point, finite(F.get("geometry.coordinates", F.lit(1)))).alias("lat"),
        choose_name(names, list(preferred)).alias("name"), address_text(p["addresses"]).alias("address"),
        p["taxonomy"]["hierarchy"].alias("hierarchy"), p["taxonomy"]["primary"].alias("primary_id"), F.coalesce(p["taxonomy"]["alternates"], F.array().cast("array<string>")).alias("alternates"),
        filled(p["basic_category"]).alias("basic_id"), p["operating_status"].alias("operating_status"), finite(p["confidence"]).alias("confidence"), F.coalesce(p["version"], F.col("version")).alias("version"),
    )


def bbox_filter(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows whose lon and lat columns lie in the box, boundary included; on stored columns the scan skips what lies outside."""
    return df.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def taxonomy_valid() -> Column:
    h, alt = F.col("hierarchy"), F.col("alternates")
    return F.coalesce(
        (F.size(h) > 0) & F.forall(h, lambda x: F.trim(x) != "") & (F.size(F.array_distinct(h)) == F.size(h)) & (F.get(h, F.size(h) - 1) == F.col("primary_id")) & ~F.arrays_overlap(h, alt),
        F.lit(False),
    )


def classify_features(flat: DataFrame, bbox: tuple[float, float, float, float], order: list[str], min_confidence: float | None = None, allow_missing: bool = True, exclude_closed: bool = True) -> DataFrame:
    """Adds reject_reason: the first failing test, null if none.

    Order: id, duplicate, geometry, bbox, name, taxonomy, closed, confidence. A repeated id is judged before validity, so
    an invalid first copy hides a valid second one. Rows are parsed once and written; the first copy of an id is found by an
    aggregate over ids and order alone and met in a join that a hot id can be split in.
    """
    flat = keep(flat, "features")
    first = flat.where("source_id is not null").groupBy("source_id").agg(F.min(F.struct(*order)).alias("_first"))
    d = flat.join(first.hint("merge"), "source_id", "left")
    w, s, e, n = bbox
    inside = F.col("lon").between(w, e) & F.col("lat").between(s, n)
    closed = F.lower(F.coalesce("operating_status", F.lit(""))).isin("permanently_closed", "closed") if exclude_closed else F.lit(False)
    low = F.lit(False) if min_confidence is None else F.coalesce(F.col("confidence") < min_confidence, F.lit(not allow_missing))
    reason = (
        F.when(F.col("source_id").isNull(), "missing-id").when(F.struct(*order) != F.col("_first"), "duplicate-id")
        .when(F.col("lon").isNull() | F.col("lat").isNull() | ~F.col("lon").between(-180, 180) | ~F.col("lat").between(-90, 90), "invalid-geometry")
        .when(~inside, "outside-bbox").when(filled(F.col("name")).isNull(), "missing-name").when(~taxonomy_valid(), "invalid-taxonomy").when(closed, "closed").when(low, "low-confidence")
    )
    return d.withColumn("reject_reason", reason).drop("_first")


def import_report(classified: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row: rows read, accepted, a count for each reason, presence counts, taxonomy rate and ready."""
    reasons = ("missing-id", "duplicate-id", "invalid-geometry", "outside-bbox", "missing-name", "invalid-taxonomy", "closed", "low-confidence")
    reached = F.col("reject_reason").isNull() | F.col("reject_reason").isin("closed", "low-confidence")
    d = classified.agg(
        F.count("*").alias("n_read"), F.count_if(F.col("reject_reason").isNull()).alias("accepted"),
        *(F.count_if(F.col("reject_reason") == r).alias(r.replace("-", "_")) for r in reasons),
        F.count_if(F.col("basic_id").isNotNull()).alias("with_basic"), F.count_if(F.col("confidence").isNotNull()).alias("with_confidence"), F.count_if(reached).alias("taxonomy_valid"),
    )
    rate = F.when(F.col("n_read") > 0, F.col("taxonomy_valid") / F.col("n_read")).otherwise(0.0)
    return d.withColumn("taxonomy_rate", rate).withColumn("ready", F.col("taxonomy_rate") >= threshold)


def normalize_provider_features(df: DataFrame) -> DataFrame:
    """reason for provider features: type, lon, lat, kind, ident, name columns; null reason is valid."""
    lon, lat = finite(F.col("lon")), finite(F.col("lat"))
    reason = (
        F.when(F.coalesce(F.col("type"), F.lit("")) != "Feature", "not-feature").when(F.coalesce(F.col("gtype"), F.lit("")) != "Point", "point-missing")
        .when(F.col("lon").isNull() | F.col("lat").isNull(), "coordinates-missing").when(lon.isNull() | lat.isNull(), "coordinates-invalid")
        .when(~lon.between(-180, 180) | ~lat.between(-90, 90), "coordinates-out-of-range").when(F.col("ident").isNull(), "stable-id-missing").when(filled(F.col("name")).isNull(), "name-missing")
    )
    return df.withColumn("reason", reason)


def with_provider_names(df: DataFrame, properties: str = "properties", tags: str = "osm_tags") -> DataFrame:
    """Puts tags over properties (maps of text) and adds ident (osm_id), kind (osm_type), name and name_locale from the result."""
    d = df.withColumn(properties, merge_tags(F.col(properties), F.col(tags)))
    of = lambda *keys: F.coalesce(*(filled(F.try_element_at(properties, F.lit(k))) for k in keys))
    d = d.withColumns({"ident": of("osm_id", "osmId"), "kind": of("osm_type", "osmType"), "_n": provider_name(F.col(properties))})
    return d.withColumns({"name": F.col("_n.name"), "name_locale": F.col("_n.locale")}).drop("_n")
