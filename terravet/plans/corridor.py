"""Facility corridor integration: buckets, summaries and two-source comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.text import blank, keyword_hint


def in_bbox(lon: Column, lat: Column, box: dict | None = None) -> Column:
    b = box or P.CORRIDOR_BBOX
    x, y = lon.try_cast("double"), lat.try_cast("double")
    return F.coalesce(x.between(b["lon_min"], b["lon_max"]) & y.between(b["lat_min"], b["lat_max"]), F.lit(False))


def bucket(status: Column, lon: Column, lat: Column, box: dict | None = None) -> Column:
    ok = blank(status) == "ok"
    return (F.when(ok & in_bbox(lon, lat, box), "in").when(ok, "out").otherwise("not_geocoded"))


def standard_columns(df: DataFrame, address: list[str] | None = None) -> DataFrame:
    """Adds ``_lon _lat _status _addr``; the address is the first non-empty candidate."""
    first = lambda names: F.coalesce(
        *[F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if n in df.columns], F.lit(""))
    out = df
    for name, source in (("_lon", ["lon_wgs84"]), ("_lat", ["lat_wgs84"]), ("_status", ["geocode_status"]),
                         ("_addr", address or P.ADDRESS_COLUMNS)):
        if name not in df.columns:
            out = out.withColumn(name, first(source))
    return out


def facility_summary(points: DataFrame, box: dict | None = None, check: bool = True) -> DataFrame:
    """Counts per category, with the conservation checks as part of the plan."""
    b = bucket(F.col("status"), F.col("lon"), F.col("lat"), box)
    out = points.withColumn("__b", b).groupBy("category").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("__b") == "in").alias("corridor_in"),
        F.count_if(F.col("__b") == "out").alias("corridor_out"),
        F.count_if(F.col("__b") == "not_geocoded").alias("not_geocoded"),
        F.count_if(F.col("status") == "ok").alias("geocoded_ok"))
    if check:
        held = ((F.col("corridor_in") + F.col("corridor_out") == F.col("geocoded_ok"))
                & (F.col("geocoded_ok") + F.col("not_geocoded") == F.col("total")))
        out = out.filter(F.assert_true(held, F.lit("bucket counts do not add up")).isNull())
    return out


def status_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def poi_counts(poi: DataFrame) -> DataFrame:
    return poi.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def filter_poi(poi: DataFrame, class_word: str, box: dict | None = None) -> DataFrame:
    return poi.filter(F.contains(blank(F.col("type")), F.lit(class_word)) & in_bbox(F.col("lon"), F.col("lat"), box))


def compare_sources(summary: DataFrame, poi: DataFrame) -> DataFrame:
    """Directory counts beside the point-library count of the same category."""
    counted = poi_counts(poi).withColumnRenamed("n", "poi_count")
    return summary.join(counted, "category", "left").withColumn("poi_count", F.coalesce("poi_count", F.lit(0)))


def corridor_points(*directories: DataFrame, box: dict | None = None) -> DataFrame:
    """Points of all directories that lie in the corridor."""
    kept = [d.filter(bucket(F.col("status"), F.col("lon"), F.col("lat"), box) == "in") for d in directories]
    out = kept[0]
    for d in kept[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def hinted(points: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Place-word hint for the rows that could not be geocoded."""
    return points.filter(F.col("status") != "ok").withColumn(
        "hint", keyword_hint(F.col("address"), words or P.CORRIDOR_KEYWORDS))


def integrate(points: DataFrame, poi: DataFrame, box: dict | None = None) -> DataFrame:
    return compare_sources(facility_summary(points, box), poi)
