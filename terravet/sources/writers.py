"""Sinks: CSV, GeoJSON points, summaries, registries, packet index.

Row sinks are written in parallel, one file per partition.  The JSON wrappers
hold one document and are meant for results that are small by nature (a registry
or a summary).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.text import blank


def csv_frame(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fixed column order, everything as text, missing values empty."""
    return df.select(*[blank(F.col(c).cast("string")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def write_csv(df: DataFrame, columns: Sequence[str], path: str) -> None:
    csv_frame(df, columns).write.mode("overwrite").option("emptyValue", "").csv(path, header=True)


def candidate_frame(candidates: DataFrame) -> DataFrame:
    hits = F.array_join("topic_hits", "|") if dict(candidates.dtypes)["topic_hits"].startswith("array") else F.col("topic_hits")
    return csv_frame(candidates.withColumn("topic_hits", hits), P.CANDIDATE_CSV_COLUMNS)


def point_features(df: DataFrame, lon: str = "lon", lat: str = "lat", properties: Sequence[str] = ("category", "label", "name", "address", "source_row")) -> DataFrame:
    """One GeoJSON feature text per point."""
    props = F.struct(*[blank(F.col(p).cast("string")).alias(p) for p in properties if p in df.columns])
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon).cast("double"), F.col(lat).cast("double")).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry"))).alias("value"))


def write_geojson(df: DataFrame, meta: dict[str, str], path: str, lines: bool = True, **kw) -> None:
    """Points as GeoJSON: newline-delimited features (parallel) or one collection document."""
    rows = point_features(df, **kw)
    if not lines:
        head = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in meta.items()]))
        rows = rows.agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("f")).select(F.concat(
            F.lit('{"type":"FeatureCollection","metadata":'), head, F.lit(',"features":['), F.col("f"), F.lit("]}")).alias("value"))
    rows.write.mode("overwrite").text(path)


def summary_document(counts: DataFrame, **fields: Column | str | int) -> DataFrame:
    """One JSON row of (kind, value, n) counts and extra fields."""
    pairs = counts.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("m"))
    listed = pairs.agg(F.array_sort(F.collect_list(F.struct("kind", "m"))).alias("k"))
    packed = listed.select(F.map_from_entries(F.transform("k", lambda e: F.struct(
        e["kind"].alias("kind"), F.map_from_entries(e["m"]).alias("m")))).alias("counts"))
    extra = [v.alias(k) if isinstance(v, Column) else F.lit(v).alias(k) for k, v in fields.items()]
    return packed.select(F.to_json(F.struct(*extra, "counts")).alias("value"))


def write_summary(counts: DataFrame, path: str, **fields) -> None:
    summary_document(counts, **fields).write.mode("overwrite").text(path)


def registry_document(rows: DataFrame, updated: str, order: str = "source_id") -> DataFrame:
    """Versioned wrapper around the registry rows."""
    cols = [order, *[c for c in rows.columns if c != order]]
    return rows.agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("sources")).select(F.to_json(F.struct(
        F.lit(P.REGISTRY_SCHEMA_VERSION).alias("schema_version"), F.lit(updated).alias("updated_date"), "sources")).alias("value"))


def write_registry(rows: DataFrame, path: str, updated: str) -> None:
    registry_document(rows, updated).write.mode("overwrite").text(path)


def publication_document(counts: DataFrame, roles: DataFrame, updated: str) -> DataFrame:
    """Registry summary for publication: counts and at most k rows per role."""
    packed = summary_document(counts).select(F.col("value").alias("c"))
    listed = roles.groupBy("role").agg(F.array_sort(F.collect_list(F.struct("rank", "source_id", "title"))).alias("rows")).agg(
        F.map_from_entries(F.collect_list(F.struct("role", "rows"))).alias("r"))
    return listed.select(F.concat(F.lit('{"updatedDate":"'), F.lit(updated), F.lit('","summary":'), packed.scalar(), F.lit(',"roles":'), F.to_json("r"), F.lit("}")).alias("value"))


def publish_registry(counts: DataFrame, roles: DataFrame, path: str, updated: str) -> None:
    publication_document(counts, roles, updated).write.mode("overwrite").text(path)


def write_packet_index(packets: DataFrame, path: str) -> None:
    packets.select("path", "title", "author", "status", "can_enter_formal_review").write.mode("overwrite").json(path)
