"""Scans: layers, documents, points, notices, package files, token tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import indicators as I
from ..functions import text as X
from ..functions import web as W
from ..plans.corridor import standard_columns


def file_uri(c: Column) -> Column:
    """One spelling of local paths: ``/a``, ``file:/a`` and ``file:///a`` are the same file."""
    return F.regexp_replace(c, "^(file:)?/+", "file:///")


def read_texts(spark: SparkSession, path) -> DataFrame:
    """Whole text files with their path; a byte-order mark is dropped."""
    return spark.read.text(path, wholetext=True).select(
        file_uri(F.col("_metadata.file_path")).alias("file"), F.regexp_replace("value", r"^\uFEFF", "").alias("text"))


def parse_layers(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features and issues of GeoJSON texts (file, text).

    One row per feature; a missing id becomes ``feature-<index>``; a geometry
    that cannot be read gives an issue row and the scan goes on.
    """
    doc = F.try_parse_json("text")
    parsed = files.select("file", doc.alias("d"))
    broken = parsed.filter(F.col("d").isNull()).select("file", F.lit(None).cast("string").alias("feature_id"), F.lit("LAYER_JSON").alias("check_id"))
    items = F.try_variant_get("d", "$.features", "array<variant>")
    rows = parsed.select("file", F.posexplode(items).alias("pos", "f"))
    get = lambda p, t="string": F.try_variant_get("f", p, t)
    features = rows.select(
        "file", "pos", F.coalesce(F.nullif(get("$.id"), F.lit("")), F.concat(F.lit("feature-"), F.col("pos"))).alias("feature_id"),
        get("$.type").alias("feature_type"), get("$.geometry.type").alias("geom_type"),
        F.to_json(F.try_variant_get("f", "$.properties", "variant")).alias("properties"),
        F.to_json(F.try_variant_get("f", "$.geometry", "variant")).alias("geometry"))
    features = features.withColumn("polys", G.rings_from_geojson(F.col("geometry")))
    known = F.col("geom_type").isin("Point", "LineString", "MultiPoint", "MultiLineString", "Polygon", "MultiPolygon")
    bad = F.col("geometry").isNull() | ~F.coalesce(known, F.lit(False)) | (
        F.col("geom_type").isin("Polygon", "MultiPolygon") & (F.coalesce(F.size("polys"), F.lit(0)) < 1))
    bad = bad | F.coalesce(F.exists("polys", lambda p: F.size(p) < 1), F.col("geom_type").isin("Polygon", "MultiPolygon"))
    issues = features.filter(bad).select("file", "feature_id", F.lit("GEOMETRY_PARSE").alias("check_id")).unionByName(broken)
    return features.filter(~bad), issues


def read_layers(spark: SparkSession, path, expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Layer files; ``expected`` (file) adds a row for each file that is missing."""
    files = read_texts(spark, path)
    features, issues = parse_layers(files)
    if expected is not None:
        gone = expected.select(file_uri(F.col("file")).alias("file")).join(files.select("file"), "file", "left_anti").select(
            "file", F.lit(None).cast("string").alias("feature_id"), F.lit("GEOMETRY_FILE_MISSING").alias("check_id"))
        issues = issues.unionByName(gone)
    return features, issues


def read_json_docs(spark: SparkSession, path) -> DataFrame:
    """JSON documents as VARIANT; a document that cannot be parsed is null."""
    return read_texts(spark, path).withColumn("doc", F.try_parse_json("text"))


def read_points_csv(spark: SparkSession, path, address: Sequence[str] | None = None) -> DataFrame:
    return standard_columns(spark.read.csv(path, header=True), list(address) if address else None)


def read_markdown(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, meta pairs, body) of documents with front matter."""
    return df.select(key, F.inline(F.array(X.front_matter(F.col(text)))))


def query_lines(df: DataFrame, col: str = "value") -> DataFrame:
    line = X.strip(X.blank(F.col(col)))
    return df.select(line.alias("query")).filter((F.col("query") != "") & ~F.col("query").startswith("#")).distinct().orderBy("query")


def read_lines(spark: SparkSession, path) -> DataFrame:
    return query_lines(spark.read.text(path))


def read_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, description, meta pairs, visible text and links of stored pages."""
    return pages.select("*", F.inline(F.array(W.page_metadata(F.col(html)))), W.page_links(W._visible(F.col(html))).alias("links"))


def osm_lines(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Line features of a road network; ways with fewer than two known nodes are dropped.

    A way holds at most a few thousand nodes, so its ordered points fit one row.
    """
    refs = ways.select("way_id", F.posexplode("nodes").alias("pos", "node_id"))
    found = refs.join(nodes.select("node_id", "lon", "lat"), "node_id").groupBy("way_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p")).filter(F.size("p") >= 2)
    line = found.select("way_id", F.transform("p", lambda q: G.pt(q["lon"], q["lat"])).alias("points"))
    return ways.drop("nodes").join(line, "way_id")


def package_files(spark: SparkSession, path, recursive: bool = True) -> DataFrame:
    """Files with length and sha256 of their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def list_package(spark: SparkSession, path, generated: str = "exhibit.json") -> DataFrame:
    """Relative file list of packages; the generated exhibit file at the top is left out."""
    root = str(path).rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return relative_listing(files, root, generated)


def relative_listing(files: DataFrame, root: str, generated: str = "exhibit.json") -> DataFrame:
    at = F.locate(root, F.col("path"))
    rel = F.substr(F.col("path"), at + len(root) + 1)
    return files.select(rel.alias("path"), "length").filter(
        (F.col("path") != generated) & ~F.col("path").rlike(r"(^|/)\.DS_Store$"))


def open_notices(notices: DataFrame, done: DataFrame) -> DataFrame:
    """Notices with an archive link that are not in the done list."""
    number = F.coalesce(F.nullif(I.notice_no(F.col("landid")), F.lit("")), F.col("landid"))
    return notices.filter(X.blank(F.col("memo2")) != "").withColumn("notice_no", number).join(
        done.select("notice_no"), "notice_no", "left_anti")


def read_notices(spark: SparkSession, path, done: DataFrame) -> DataFrame:
    return open_notices(spark.read.json(path, multiLine=True), done)


def read_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """Items of token tables; a text with a line of another form gives none."""
    return df.select(key, F.posexplode(I.tokens_of(F.col(text))).alias("seq", "t")).select(key, "seq", "t.y", "t.x", "t.text")


def dimension(docs: DataFrame, items: Column | None = None) -> DataFrame:
    """Id-keyed rows of dimension documents (doc VARIANT), blank ids dropped."""
    one = docs.select(F.explode(items).alias("doc")) if items is not None else docs.select("doc")
    rows = one.select(X.strip(F.try_variant_get("doc", "$.id", "string")).alias("id"), F.try_variant_get("doc", "$.title", "string").alias("title"))
    return rows.filter(X.blank(F.col("id")) != "")


def read_dim(spark: SparkSession, path, list_key: str | None = None) -> DataFrame:
    """Scenario files (one object each) or a file with a list such as ``tracks``."""
    docs = read_json_docs(spark, path)
    return dimension(docs, F.try_variant_get("doc", f"$.{list_key}", "array<variant>") if list_key else None)


def metric_values(doc: Column, key: str) -> Column:
    """Value of a metric in the flat, entry, nested or list layout; booleans are no numbers."""
    def number(path):
        v = F.try_variant_get(doc, path, "variant")
        return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.try_variant_get(doc, path, "double"))
    rows = F.try_variant_get(doc, "$", "array<variant>")
    listed = F.filter(F.transform(rows, lambda m: F.coalesce(
        F.when(F.try_variant_get(m, "$.metric", "string") == key, F.try_variant_get(m, "$.value", "double")),
        F.try_variant_get(m, f"$.{key}", "double"))), lambda v: v.isNotNull())
    return F.coalesce(number(f"$.{key}.value"), number(f"$.{key}"), number(f"$.metrics.{key}.value"), number(f"$.metrics.{key}"), F.get(listed, F.lit(0)))


def matrix_entries(doc: Column) -> Column:
    """Rows of a matrix document: a list, or the list under entries or requirements."""
    return F.coalesce(*[F.try_variant_get(doc, p, "array<variant>") for p in ("$", "$.entries", "$.requirements")])


def enum_codes(doc: Column) -> Column:
    """Codes of an enum document in any of its layouts."""
    rows = F.coalesce(*[F.try_variant_get(doc, p, "array<variant>") for p in ("$", "$.codes", "$.types", "$.classes", "$.layers")])
    keys = F.map_keys(F.try_variant_get(doc, "$", "map<string,variant>"))
    return F.coalesce(F.transform(rows, lambda r: F.coalesce(F.try_variant_get(r, "$.code", "string"), F.lit(""))), keys)
