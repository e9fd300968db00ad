"""Text and record expressions: names, addresses, ids, hashes, units, rate-limit headers."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def filled(c: Column) -> Column:
    """Trimmed text, or null if blank."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def choose_name(names: Column, preferred: list[str]) -> Column:
    """From array<struct<value, locale, primary>>: the first preferred locale that prefixes one, else the primary, else the first."""
    ok = F.filter(names, lambda n: filled(n["value"]).isNotNull())
    norm = lambda x: F.lower(F.replace(F.coalesce(x, F.lit("")), F.lit("_"), F.lit("-")))
    picks = [_by_locale(ok, norm, want.lower().replace("_", "-")) for want in preferred]
    picks.append(F.get(F.filter(ok, lambda n: n["primary"]), F.lit(0))["value"])
    picks.append(F.get(ok, F.lit(0))["value"])
    return F.trim(F.coalesce(*picks))


def _by_locale(names: Column, norm, want: str) -> Column:
    return F.get(F.filter(names, lambda n: norm(n["locale"]).startswith(want)), F.lit(0))["value"]


def address_text(addresses: Column) -> Column:
    """First address: its freeform text, else value, locality, street or postcode."""
    a = F.get(addresses, F.lit(0))
    return F.coalesce(*(filled(a[k]) for k in ("freeform", "value", "locality", "street", "postcode")))


def _normal(values):
    """Arrow strings in Unicode NFKC."""
    return pa.array([s if s is None or s.isascii() else unicodedata.normalize("NFKC", s) for s in values.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def nfkc(values: pa.Array) -> pa.Array:
    """Unicode NFKC; Spark has no built-in form."""
    return _normal(values)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("locale", T.StringType())])))
def nfkc_names(names: pa.Array) -> pa.Array:
    """Names with their values in NFKC: one call for all candidates of a row, as each call may cost a Python process a task."""
    flat = names.flatten()
    value, locale = flat.flatten()
    counts = pc.fill_null(pc.list_value_length(names), 0)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts.to_numpy(zero_copy_only=False))]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([_normal(value), locale.cast(pa.string())], ["value", "locale"]))


def clean_name(c: Column, normalise: bool = True) -> Column:
    """Spaces collapsed; null for a URL alone, digits (seven or more) with nothing but phone marks, and bare or osm-marked numbers."""
    x = F.trim(F.regexp_replace(nfkc(c) if normalise else c, r"\s+", " "))
    url = x.rlike(r"(?i)^(?:https?://\S+|www\.\S+)$")
    phone = F.regexp_replace(x, r"[\s()+\-./]", "").rlike(r"^\d{7,}$")
    bare = x.rlike(r"(?i)^(?:osm[_-]?(?:node|way|relation)?[:#-]?)?\d+$")
    return F.when((x != "") & ~url & ~phone & ~bare, x)


#: Name tags in order with their locales, and languages of a nested map in order.
NAME_TAGS = (("name:zh", "zh-CN"), ("name:zh-CN", "zh-CN"), ("name", None), ("name:en", "en"))
NAME_LANGUAGES = ("zh-CN", "zh", "en", "default")


def provider_name(properties: Column, normalise: bool = True) -> Column:
    """Struct of name and locale from a map of tags: the first tag with a clean name; a tag's value may be a JSON map by language."""
    pick = lambda value, locale: F.struct(value.alias("value"), F.lit(locale).cast("string").alias("locale"))
    picks = []
    for tag, locale in NAME_TAGS:
        value = F.try_element_at(properties, F.lit(tag))
        nested = F.when(value.startswith("{"), F.from_json(value, "map<string,string>"))
        picks.append(F.when(nested.isNull(), F.array(pick(value, locale))).otherwise(F.array(*(pick(F.try_element_at(nested, F.lit(n)), n) for n in NAME_LANGUAGES))))
    names = F.filter(F.flatten(F.array(*picks)), lambda n: n["value"].isNotNull())
    clean = F.transform(nfkc_names(names) if normalise else names, lambda n: F.struct(clean_name(n["value"], False).alias("name"), n["locale"].alias("locale")))
    return F.get(F.filter(clean, lambda n: n["name"].isNotNull()), F.lit(0))


def merge_tags(properties: Column, tags: Column) -> Column:
    """The map of properties with tags put over it."""
    none = F.array().cast("array<struct<key:string,value:string>>")
    own = F.coalesce(F.map_entries(tags), none)
    kept = F.filter(F.coalesce(F.map_entries(properties), none), lambda e: ~F.exists(own, lambda t: t["key"] == e["key"]))
    return F.map_from_entries(F.concat(kept, own))


#: Letters whose full case folding is not the lower case of their upper case, and their foldings.
_FOLDS = {"ς": "σ", "ı": "\ue000"}


def case_fold(c: Column) -> Column:
    """Full case folding: the sharp s is two letters, ligatures come apart, the final sigma is a sigma, the dotless i stays one. By way of upper case, where letters that differ in case
    only are one; Cherokee letters come out in lower case."""
    held = F.replace(c, F.lit("ı"), F.lit(_FOLDS["ı"]))
    high = F.replace(F.upper(held), F.lit("ς"), F.lit("Σ"))  # without a step between, the optimizer takes lower(upper(c)) for lower(c)
    return F.replace(F.replace(F.lower(high), F.lit("ς"), F.lit(_FOLDS["ς"])), F.lit(_FOLDS["ı"]), F.lit("ı"))


def name_key(c: Column) -> Column:
    """Case-folded, white space collapsed."""
    return F.regexp_replace(F.trim(case_fold(c)), r"\s+", " ")


def stable_id(kind: Column, ident: Column) -> Column:
    return F.when(ident.isNotNull(), F.concat(F.lit("ors-poi:"), F.coalesce(filled(kind), F.lit("osm")), F.lit(":"), ident.cast("string")))


def duration_text(seconds: Column) -> Column:
    s = F.round(seconds).cast("bigint")
    return F.when(seconds >= 0, F.when(s < 60, F.format_string("%d 秒", s)).otherwise(F.format_string("%d 分 %d 秒", F.floor(s / 60).cast("bigint"), s % 60)))


def distance_text(metres: Column) -> Column:
    return F.when(metres >= 0, F.when(metres < 1000, F.format_string("%d m", F.round(metres).cast("bigint"))).otherwise(F.format_string("%.1f km", metres / 1000)))


def fnv1a32(c: Column) -> Column:
    """FNV-1a over UTF-16 units (a character beyond the basic plane is two), as eight hex digits."""
    points = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("bigint"))
    high, low = (lambda p: F.lit(0xD800) + F.shiftright(p - 0x10000, 10)), (lambda p: F.lit(0xDC00) + (p - 0x10000).bitwiseAND(0x3FF))
    units = F.flatten(F.transform(points, lambda p: F.when(p > 0xFFFF, F.array(high(p), low(p))).otherwise(F.array(p))))
    h = F.aggregate(units, F.lit(2166136261).cast("bigint"), lambda a, x: (a.bitwiseXOR(x) * 16777619).bitwiseAND(4294967295))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def number_text(c: Column) -> Column:
    """A double at seven decimals, halves away from zero; null stays null."""
    return F.when(c.isNotNull(), F.format_string("%.7f", c))


def identity(*columns: Column) -> Column:
    """SHA-256 of columns joined by a bar, null empty; give doubles as number_text so that engines agree."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)


def label_box(c: Column, font: Column) -> Column:
    """Struct of width and height of a label: characters above code point 255 take 1 em, spaces 0.36, others 0.58; 8 more, at least 18."""
    wide = F.length(F.regexp_replace(c, r"[\x{0}-\x{FF}]", ""))
    space = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    units = wide * 1.0 + space * 0.36 + (F.length(c) - wide - space) * 0.58
    return F.struct(F.greatest(F.lit(18), F.ceil(units * font + 8)).cast("int").alias("width"), F.ceil(font * 1.34 + 4).cast("int").alias("height"))


def coordinate_text(c: Column) -> Column:
    """Struct of lon and lat of a "lon,lat" text within bounds, else null."""
    parts = F.split(F.trim(c), r"\s*[,，]\s*", -1)
    lon, lat = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when((F.size(parts) == 2) & lon.between(-180, 180) & lat.between(-90, 90), F.struct(lon.alias("lon"), lat.alias("lat")))


def header_int(c: Column) -> Column:
    """Digits-only whole number up to 1e10, else null."""
    x = F.trim(c)
    return F.when(x.rlike(r"^[0-9]{1,11}$"), F.when(x.try_cast("bigint") <= 10_000_000_000, x.try_cast("bigint")))


def header_reset(c: Column, now: Column) -> Column:
    """Timestamp of a reset header: an epoch (>= 1e9), seconds from now, or an HTTP date; else null."""
    n = header_int(c)
    return F.when(n >= 1_000_000_000, F.timestamp_seconds(n)).when(n.isNotNull(), F.timestamp_seconds(F.unix_timestamp(now) + n)).otherwise(F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'")))


def quota_status(code: Column, remaining: Column) -> Column:
    return F.when(code == 429, "rate-limited").when(code == 403, "forbidden").when(remaining.isNull(), "unknown").when(remaining <= 0, "exhausted").otherwise("ok")


def stale(retrieved: Column, ttl_seconds: Column, now: Column) -> Column:
    """Older than its time to live; 0 never is."""
    return (ttl_seconds > 0) & (F.unix_timestamp(now) - F.unix_timestamp(retrieved) > ttl_seconds)
