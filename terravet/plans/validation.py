"""Deterministic package validation: all file-level checks in one issue table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks as K
from ..operators import documents as D

COLUMNS = ["submission", "area", "check_id", "severity", "detail"]


def _shape(df: DataFrame, area: str, severity: str | None = None, detail: str = "detail") -> DataFrame:
    sev = F.lit(severity) if severity else F.col("severity")
    return df.select(F.col("submission").cast("string").alias("submission"), F.lit(area).alias("area"), F.col("check_id"),
                     sev.alias("severity"), F.col(detail).cast("string").alias("detail"))


def validate(tables: dict[str, DataFrame], **options) -> DataFrame:
    """Union of the checks whose tables are given.

    Tables: proposals (submission, text), changelogs, files (submission, path, length),
    listed and stored (manifest paths and file hashes), manifests, features, metrics,
    requirements, standards, depths, self_checks, risks, concepts with scenarios, images,
    reports (submission, html), drawings (submission, content).  With ``submissions`` the
    required files and matrix entries of a submission without any row are reported too.
    """
    t, parts, every = tables, [], tables.get("submissions")

    def add(df, area, severity=None, detail="detail"):
        parts.append(_shape(df, area, severity, detail))

    if "proposals" in t:
        add(D.check_front_matter(t["proposals"], "submission", "text"), "front_matter", "error")
        add(D.scan_hard_risk(t["proposals"], "submission", "text").withColumn("check_id", F.lit("HARD_RISK")), "content", detail="reason")
        add(D.scan_soft_risk(t["proposals"], "submission", "text").withColumn("check_id", F.lit("SOFT_RISK")), "content", detail="reason")
        if "images" in t:
            add(D.check_images(t["proposals"], "submission", "text", t["images"]), "images", "error")
        if "required_sections" in options:
            add(D.check_sections(t["proposals"], "submission", "text", options["required_sections"]), "sections", "error")
    if "changelogs" in t:
        add(D.check_changelog(t["changelogs"], "submission", "text"), "changelog")
    if "files" in t:
        add(K.check_sizes(t["files"], ["submission"]), "files", "error", "path")
    if "listed" in t:
        add(K.check_manifest_files(t["listed"], t["stored"], options.get("required_files", K.P.REQUIRED_PACKAGE_FILES), every), "manifest", "error", "path")
    if "manifests" in t:
        add(K.check_manifest(t["manifests"]), "manifest")
    if "features" in t:
        add(K.check_features(t["features"], ["submission"]), "features", "error")
        if options.get("feature_enums"):
            bad = K.check_value_lists(t["features"], ["submission", "pos"], options["feature_enums"])
            add(bad.withColumn("check_id", F.concat(F.lit("ENUM_"), F.upper("field"))), "features", "error", "value")
        if "parts" in t["features"].columns:
            add(K.check_coords(t["features"], ["submission"]).withColumn("check_id", F.lit("COORDINATES")), "features", "error", "geom_type")
    if "metrics" in t:
        add(K.check_metric_rows(t["metrics"], ["submission", "pos"]), "metrics", "error")
    for name, check in (("requirements", K.check_requirements), ("standards", K.check_standards), ("depths", K.check_depth)):
        if name in t:
            add(check(t[name], submissions=every, **options.get(name, {})), name, "error")
    if "self_checks" in t:
        add(K.check_selfcheck(t["self_checks"], ["submission"]), "self_check", "error")
    if "risks" in t:
        add(K.check_risks(t["risks"], ["submission"]), "risks")
    if "concepts" in t:
        add(K.check_concepts(t["concepts"], ["submission"], t["scenarios"]), "concepts")
    if "reports" in t:
        add(D.scan_report_html(t["reports"], "submission", "html"), "report", "error")
    if "drawings" in t:
        empty = t["drawings"].filter(K.empty_pdf(F.col("content"))).select("submission", F.lit("EMPTY_DRAWING").alias("check_id"), F.lit("").alias("detail"))
        add(empty, "drawings", "error")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verdict(issues: DataFrame, submissions: DataFrame) -> DataFrame:
    """ok per submission: no error among its issues."""
    n = issues.groupBy("submission").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return submissions.select(F.col("submission").cast("string").alias("submission")).distinct().join(n, "submission", "left").select(
        "submission", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"), (F.coalesce("errors", F.lit(0)) == 0).alias("ok"))
