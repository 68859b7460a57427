"""Rule checks over package tables.  Each returns issue or outcome rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.text import WS, blank, let, pattern_hits, strip, words
from ..scale import first_in_group, later_duplicates
from .rows import for_all, issue, list_issues, rule_rows


def with_each(df: DataFrame, table: DataFrame) -> DataFrame:
    """Every row of ``df`` beside every row of a parameter table.

    The parameter table becomes one array, read as a scalar subquery; the rows
    are unfolded in place, so neither side is shuffled.
    """
    packed = table.agg(F.collect_list(F.struct(*table.columns)).alias("__rows"))
    return df.select("*", F.inline(packed.scalar()))


def nonblank(c: Column) -> Column:
    return F.length(F.regexp_replace(blank(c), f"{WS}+", "")) > 0


# ---- presence, enums, formats ---------------------------------------------------------

def require_fields(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    gaps = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]))
    return df.select(*keys, F.explode(gaps).alias("field"))


def require_text(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    gaps = F.array_compact(F.array(*[F.when(~nonblank(F.col(c)), F.lit(c)) for c in cols]))
    return df.select(*keys, F.explode(gaps).alias("field"))


def check_enum(df: DataFrame, keys: Sequence[str], col: str, codes: DataFrame) -> DataFrame:
    """Rows whose value is set but is not in the code table."""
    known = codes.select(F.col(codes.columns[0]).cast("string").alias("value")).distinct()
    return (df.select(*keys, F.col(col).cast("string").alias("value")).filter(blank(F.col("value")) != "")
            .join(known, "value", "left_anti"))


def check_land_use_code(features: DataFrame, keys: Sequence[str], codes: DataFrame) -> DataFrame:
    """Missing code and unknown code are both violations."""
    known = codes.select(F.col(codes.columns[0]).cast("string").alias("land_use_code"), F.lit(True).alias("__known")).distinct()
    reason = F.when(blank(F.col("land_use_code")) == "", "missing").when(F.col("__known").isNull(), "unknown")
    return (features.select(*keys, F.col("land_use_code").cast("string").alias("land_use_code"))
            .join(known, "land_use_code", "left").select(*keys, "land_use_code", reason.alias("reason"))
            .filter("reason IS NOT NULL"))


def check_value_lists(df: DataFrame, keys: Sequence[str], dims: dict[str, Sequence[str]],
                      allow_empty: bool = True) -> DataFrame:
    """Several columns against their value lists in one pass, inside the row."""
    bad = []
    for col, values in dims.items():
        outside = ~F.coalesce(F.col(col).cast("string").isin(list(values)), F.lit(False))
        if allow_empty:
            outside = outside & (blank(F.col(col).cast("string")) != "")
        bad.append(F.when(outside, F.struct(F.lit(col).alias("field"), F.col(col).cast("string").alias("value"))))
    return df.select(*keys, F.inline(F.array_compact(F.array(*bad))))


def check_registry_enums(reg: DataFrame, keys: Sequence[str]) -> DataFrame:
    return check_value_lists(reg, keys, P.REGISTRY_ENUMS, allow_empty=False)


def check_format(df: DataFrame, keys: Sequence[str], col: str, pattern: str, nullable: bool = False) -> DataFrame:
    wrong = ~F.coalesce(F.col(col).rlike(pattern), F.lit(nullable))
    return df.filter(wrong).select(*keys, F.col(col).alias("value"))


def string_array_ok(c: Column) -> Column:
    return F.coalesce((F.size(c) > 0) & F.forall(c, nonblank), F.lit(False))


def check_string_array(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    bad = F.array_compact(F.array(*[F.when(~string_array_ok(F.col(c)), F.lit(c)) for c in cols]))
    return df.select(*keys, F.explode(bad).alias("field"))


def check_registry_cross(reg: DataFrame, keys: Sequence[str]) -> DataFrame:
    status, formal, access = F.col("review_status"), F.col("usable_for_formal"), F.col("public_access_status")
    return rule_rows(reg, keys, [
        ((status == "approved") & (access == "restricted_or_unknown"), "RESTRICTED_APPROVED", "", "error"),
        ((formal == "yes") & ~F.coalesce(status == "approved", F.lit(False)), "FORMAL_NOT_APPROVED", "", "error"),
        ((formal == "yes") & (F.col("authority_level") == "PROVISIONAL_REPOSITORY"), "PROVISIONAL_REPOSITORY_FORMAL", "", "error"),
        ((formal == "yes") & (status == "provisional"), "PROVISIONAL_FORMAL", "", "error"),
        (access.isin("public_url", "public_local_snapshot") & ~F.col("url").startswith("http"), "PUBLIC_URL_NOT_HTTP", "", "error"),
        (F.length(strip(blank(F.col("license_summary")))) < 5, "LICENSE_TOO_SHORT", "", "error"),
        (status == "needs_review", "NEEDS_REVIEW", "", "warning")])


def safe_path(c: Column) -> Column:
    return let(F.replace(strip(blank(c)), F.lit("\\"), F.lit("/")), lambda p: (
        (p != "") & ~F.contains(p, F.lit("://")) & ~p.startswith("/") & ~F.array_contains(F.split(p, "/"), "..")))


def check_registry(reg: DataFrame, keys: Sequence[str], position: str = "pos") -> DataFrame:
    """All registry rules as (keys, check_id, detail)."""
    def rows(df, check_id, detail):
        return df.select(*keys, F.lit(check_id).alias("check_id"), detail.alias("detail"))
    duplicates = later_duplicates(reg.filter("source_id IS NOT NULL"), ["source_id"], position)
    local = reg.filter(F.col("public_access_status").isin("cleared_for_repo", "provisional_repository") & ~safe_path(F.col("url")))
    out = rows(require_fields(reg, keys, P.REGISTRY_REQUIRED), "FIELD_MISSING", F.col("field"))
    for part in (
        rows(check_registry_enums(reg, keys), "ENUM", F.col("field")),
        rows(check_format(reg, keys, "source_id", P.REGISTRY_ID_PATTERN), "ID_FORM", blank(F.col("value"))),
        rows(check_format(reg, keys, "accessed_date", P.DATE_PATTERN), "ACCESSED_DATE", blank(F.col("value"))),
        rows(check_format(reg, keys, "published_date", P.DATE_PATTERN, True), "PUBLISHED_DATE", F.col("value")),
        rows(check_string_array(reg, keys, ["allowed_uses", "prohibited_uses", "topics"]), "STRING_ARRAY", F.col("field")),
        rows(check_registry_cross(reg, keys), "CROSS", F.col("check_id")),
        rows(local, "LOCAL_PATH", F.col("url")), rows(duplicates, "DUPLICATE_ID", F.col("source_id"))):
        out = out.unionByName(part)
    return out


def check_source_index(src: DataFrame, keys: Sequence[str], files: DataFrame | None = None,
                       extra: str | None = None, position: str = "pos") -> DataFrame:
    """Rules of the public source index; ``extra`` is a map of further fields."""
    path, url = F.col("path"), F.col("url")
    gaps = list_issues(F.array_compact(F.array(*[F.when(~nonblank(F.col(c)), F.lit(c)) for c in P.INDEX_REQUIRED])),
                       "FIELD_MISSING", lambda v: v)
    more = [gaps]
    if extra:
        unknown = F.array_except(F.map_keys(F.col(extra)), words([*P.INDEX_REQUIRED, "path", "url"]))
        more.append(F.coalesce(list_issues(unknown, "UNSUPPORTED_FIELD", lambda v: v), F.array().cast(
            "array<struct<check_id:string,severity:string,detail:string>>")))
    out = rule_rows(src, keys, [
        ((blank(F.col("id")) != "") & ~F.col("id").rlike(P.INDEX_ID_PATTERN), "ID_FORM", F.col("id")),
        ((blank(F.col("type")) != "") & ~F.col("type").isin(P.INDEX_TYPES), "TYPE", F.col("type")),
        ((blank(F.col("public_status")) != "") & ~F.col("public_status").isin(P.INDEX_STATUSES), "PUBLIC_STATUS", F.col("public_status")),
        ((blank(path) == "") & (blank(url) == ""), "PATH_OR_URL", ""),
        (path.isNotNull() & ~safe_path(path), "UNSAFE_PATH", path),
        (url.isNotNull() & ~url.startswith("https://"), "URL_NOT_HTTPS", url)], *more)
    dup = later_duplicates(src.filter(blank(F.col("id")) != ""), ["id"], position)
    out = out.unionByName(dup.select(*keys, F.lit("DUPLICATE_ID").alias("check_id"), F.lit("major").alias("severity"),
                                     F.col("id").alias("detail")))
    if files is not None:
        absent = src.filter(path.isNotNull() & safe_path(path)).join(files.select("path").distinct(), "path", "left_anti")
        out = out.unionByName(absent.select(*keys, F.lit("PATH_MISSING").alias("check_id"), F.lit("major").alias("severity"),
                                            F.col("path").alias("detail")))
    return out


# ---- metrics ----------------------------------------------------------------------------

def in_limit(v: Column, low: Column, high: Column) -> Column:
    return F.coalesce(v >= low, F.lit(True)) & F.coalesce(v <= high, F.lit(True))


def _rules_beside_metrics(submissions: DataFrame, metrics: DataFrame, rules: DataFrame) -> DataFrame:
    values = metrics.select("submission", "metric", F.col("value"))
    return with_each(submissions.select("submission").distinct(), rules).join(values, ["submission", "metric"], "left")


def check_bounds(submissions: DataFrame, metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (rule_id, metric, min_val, max_val); an absent metric is skipped."""
    both = _rules_beside_metrics(submissions, metrics, rules)
    outcome = (F.when(F.col("value").isNull(), "SKIP")
               .when(in_limit(F.col("value"), F.col("min_val"), F.col("max_val")), "PASS").otherwise("FAIL"))
    return both.select("submission", "rule_id", "metric", "value", outcome.alias("outcome"))


def check_area_tolerance(submissions: DataFrame, metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (rule_id, metric, declared, tolerance_pct); a missing named metric fails."""
    both = _rules_beside_metrics(submissions, metrics, rules)
    delta = F.abs(F.col("value") - F.col("declared")) / F.col("declared") * 100
    outcome = (F.when(F.col("declared").isNull(), "SKIP").when(F.col("value").isNull(), "FAIL")
               .when(delta <= F.coalesce("tolerance_pct", F.lit(5.0)), "PASS").otherwise("FAIL"))
    return both.select("submission", "rule_id", "metric", delta.alias("delta_pct"), outcome.alias("outcome"))


def check_metric_rows(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    status, value = F.col("status"), F.col("value")
    return rule_rows(metrics, keys, [
        (~F.coalesce(status.isin("known", "unknown", "not_applicable"), F.lit(False)), "METRIC_STATUS", blank(status)),
        ((status == "unknown") & value.isNotNull(), "UNKNOWN_WITH_VALUE", ""),
        ((status == "unknown") & (blank(F.col("reason")) == ""), "UNKNOWN_WITHOUT_REASON", ""),
        ((status == "known") & value.isNull(), "KNOWN_WITHOUT_VALUE", ""),
        ((F.col("unit") == "ratio") & ~value.between(0, 1), "RATIO_RANGE", "")])


def check_units(packages: DataFrame, keys: Sequence[str]) -> DataFrame:
    ok = (F.col("length_unit") == "m") & (F.col("area_unit") == "sqm")
    return rule_rows(packages, keys, [(~F.coalesce(ok, F.lit(False)), "UNITS", "")])


def check_metric_claims(metrics: DataFrame, files: DataFrame) -> DataFrame:
    """Known metrics need a formula and at least one source file that exists."""
    known = metrics.filter("status = 'known'")
    cited = known.select("submission", "metric", F.explode("source_files").alias("path"))
    backed = cited.join(files.select("submission", "path").distinct(), ["submission", "path"], "left_semi").select(
        "submission", "metric").distinct().withColumn("__backed", F.lit(True))
    reason = (F.when(~nonblank(F.col("formula")), "no_formula")
              .when(F.col("__backed").isNull(), "no_source_file"))
    return known.join(backed, ["submission", "metric"], "left").select(
        "submission", "metric", reason.alias("reason")).filter("reason IS NOT NULL")


# ---- features -----------------------------------------------------------------------------

def check_provisional(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    p = features.filter("geometry_role = 'provisional_constraint'")
    reason = (F.when(~F.col("official_boundary").eqNullSafe(F.lit(False)), "official_boundary")
              .when(blank(F.col("boundary_precision")) == "", "boundary_precision"))
    return p.select(*keys, reason.alias("reason")).filter("reason IS NOT NULL")


def check_locked(features: DataFrame, keys: Sequence[str], locked: Sequence[str],
                 allowed: Sequence[str] = ("SITE_BOUNDARY", "KEY_AREA")) -> DataFrame:
    return features.filter(F.col("layer").isin([x for x in locked if x not in set(allowed)])).select(*keys, "layer")


def check_layer_names(features: DataFrame, keys: Sequence[str], valid: Sequence[str], exempt: str = "KEY_AREA") -> DataFrame:
    layer = F.col("layer")
    return features.filter((blank(layer) != "") & ~layer.isin(list(valid)) & ~layer.startswith(exempt)).select(*keys, "layer")


def check_required_layers(files: DataFrame, layers: Sequence[str], aliases: dict[str, str] | None = None,
                          optional: Sequence[str] = ("SITE_BOUNDARY",),
                          submissions: DataFrame | None = None) -> DataFrame:
    """Layers per submission, from one aggregate over the file list."""
    aliases = P.CANONICAL_LAYER_FILES if aliases is None else aliases
    name = F.element_at(F.split("path", "/"), -1)
    flags = [F.bool_or(name.isin([f"{x.lower()}.geojson", aliases.get(x, f"{x.lower()}.geojson")])).alias(f"l{i}")
             for i, x in enumerate(layers)]
    seen = for_all(files.groupBy("submission").agg(*flags), submissions)
    gap = lambda keep: F.array_compact(F.array(*[
        F.when(~F.col(f"l{i}"), F.lit(x)) for i, x in enumerate(layers) if (x in optional) == keep]) if any(
        (x in optional) == keep for x in layers) else F.array().cast("array<string>"))
    missing, skipped = gap(False), gap(True)
    outcome = (F.when(F.size(missing) > 0, "FAIL").when(
        (F.size(skipped) > 0) & (F.size(skipped) == len(layers)), "SKIP").otherwise("PASS"))
    return seen.select("submission", outcome.alias("outcome"), F.array_join(missing, ", ").alias("missing"),
                       F.array_join(skipped, ", ").alias("skipped"))


def check_heights(features: DataFrame, keys: Sequence[str], fields: Sequence[str] = P.HEIGHT_FIELDS,
                  low: float = 1.0, high: float = 500.0) -> DataFrame:
    raw = F.coalesce(*[F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields])
    num = raw.try_cast("double")
    reason = (F.when(raw.isNull(), "missing").when(num.isNull(), "not_a_number")
              .when((num < low) | (num > high), "out_of_range"))
    return features.select(*keys, raw.alias("value"), reason.alias("reason")).filter("reason IS NOT NULL")


def check_roads(features: DataFrame, min_roads: int = 3) -> DataFrame:
    lines = F.count_if(F.col("geom_type").isin("LineString", "MultiLineString"))
    return features.groupBy("submission").agg(lines.alias("road_lines")).withColumn(
        "outcome", F.when(F.col("road_lines") < min_roads, "FAIL").otherwise("PASS"))


def check_coords(features: DataFrame, keys: Sequence[str], parts: str = "parts") -> DataFrame:
    """Geometry kind, coordinate ranges and closed rings; ``parts`` is an array of point arrays."""
    p = F.col(parts)
    in_range = F.forall(p, lambda r: F.forall(r, lambda q: F.coalesce(
        q["x"].between(-180, 180) & q["y"].between(-90, 90), F.lit(False))))
    rings = (F.size(p) > 0) & F.forall(p, lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)))
    lines = (F.size(p) > 0) & F.forall(p, lambda r: F.size(r) >= 2)
    point = (F.size(p) == 1) & (F.size(p[0]) == 1)
    kind = F.col("geom_type")
    ok = (F.when(kind == "Point", point).when(kind.isin("LineString", "MultiLineString"), lines)
          .when(kind.isin("Polygon", "MultiPolygon"), rings).otherwise(F.lit(False)))
    return features.filter(~F.coalesce(ok & in_range, F.lit(False))).select(*keys, "geom_type")


def check_features(features: DataFrame, group: Sequence[str], position: str = "pos",
                   required: Sequence[str] = ("id", "layer", "source_type", "confidence", "geometry_role")) -> DataFrame:
    """Feature type, id presence and uniqueness, required properties."""
    keys = [*group, position]
    gaps = list_issues(F.array_compact(F.array(*[F.when(blank(F.col(c).cast("string")) == "", F.lit(c)) for c in required])),
                       "PROPERTY_MISSING", lambda v: v)
    rows = rule_rows(features, keys, [
        (~F.coalesce(F.col("feature_type") == "Feature", F.lit(False)), "NOT_A_FEATURE", ""),
        (blank(F.col("feature_id")) == "", "ID_MISSING", "")], gaps)
    dup = later_duplicates(features.filter(blank(F.col("feature_id")) != ""), [*group, "feature_id"], position)
    return rows.unionByName(dup.select(*keys, F.lit("DUPLICATE_ID").alias("check_id"), F.lit("major").alias("severity"),
                                       F.col("feature_id").alias("detail")))


def boundary_class() -> Column:
    official, role = F.col("official_boundary"), F.col("geometry_role")
    source, confidence = F.col("source_type"), blank(F.col("confidence"))
    trusted = (official.eqNullSafe(F.lit(True)) & (role == "official_constraint") & source.isin(P.TRUSTED_BOUNDARY_SOURCES)
               & ~confidence.isin("low", "unknown", ""))
    provisional = (official.eqNullSafe(F.lit(False)) & (role == "provisional_constraint")
                   & source.isin(P.PROVISIONAL_BOUNDARY_SOURCES) & ~confidence.isin("unknown", ""))
    return F.when(trusted, "official").when(provisional, "provisional").otherwise("other")


def choose_boundary(features: DataFrame, group: Sequence[str], layer: str = "SITE_BOUNDARY") -> DataFrame:
    """First official boundary, else first provisional one, by file and position."""
    kept = features.filter(F.col("layer") == layer).withColumn("boundary_class", boundary_class()).filter(
        "boundary_class <> 'other'")
    return first_in_group(kept, group, [F.col("boundary_class") == "provisional", F.col("layer_file"), F.col("pos")])


def choose_key_areas(features: DataFrame, group: Sequence[str], ids: Sequence[str], layer: str = "KEY_AREA",
                     allow_provisional: bool = True) -> DataFrame:
    """First file whose official areas cover all ids, else first such provisional file."""
    kept = features.filter((F.col("layer") == layer) & F.col("area_id").isin(list(ids))).withColumn(
        "mode", boundary_class()).filter("mode <> 'other'")
    covering = kept.groupBy(*group, "layer_file", "mode").agg(F.collect_set("area_id").alias("seen")).filter(
        F.size("seen") == len(set(ids))).drop("seen")
    if not allow_provisional:
        covering = covering.filter("mode = 'official'")
    chosen = first_in_group(covering, group, [F.col("mode") == "provisional", F.col("layer_file")])
    return kept.join(chosen, [*group, "layer_file", "mode"])


def check_scope_order(scopes: DataFrame, group: Sequence[str], order: Sequence[str] = P.SCOPE_ORDER) -> DataFrame:
    """Three levels in the fixed order with strictly falling areas."""
    n = len(order)
    picked = [F.max(F.when(F.col("pos") == i, F.struct("scope_id", "area_sqm"))).alias(f"s{i}") for i in range(n)]
    levels = scopes.groupBy(*group).agg(F.count(F.lit(1)).alias("levels"), *picked)
    ids_ok, falling = F.col("levels") == n, F.col("levels") == n
    for i, name in enumerate(order):
        ids_ok = ids_ok & (F.col(f"s{i}.scope_id") == name)
        if i:
            falling = falling & (F.col(f"s{i - 1}.area_sqm") > F.col(f"s{i}.area_sqm"))
    return levels.select(*group, F.coalesce(ids_ok, F.lit(False)).alias("order_ok"),
                         F.coalesce(falling, F.lit(False)).alias("areas_fall"))


# ---- files and paths --------------------------------------------------------------------

def _ext(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(\.[^./]*)$", 1))


def check_sizes(files: DataFrame, group: Sequence[str], total: int = P.MAX_TOTAL_BYTES) -> DataFrame:
    """Per-file size limits by class, and one row per change set beyond the total."""
    p = F.split("path", "/")
    n, third = F.size(p), F.coalesce(F.get(p, F.lit(3)), F.lit(""))
    size = F.col("length")
    over = rule_rows(files, [*group, "path"], [
        (F.col("path").endswith(".md") & (size > P.MAX_MARKDOWN_BYTES), "SIZE", "markdown"),
        (F.col("path").endswith(".json") & (size > P.MAX_JSON_BYTES), "SIZE", "json"),
        (F.col("path").endswith(".geojson") & (size > P.MAX_GEOJSON_BYTES), "SIZE", "geojson"),
        ((n >= 5) & (third == "assets") & (size > P.MAX_ASSET_BYTES), "SIZE", "assets"),
        ((n == 5) & (third == "drawings") & (size > P.MAX_DRAWING_BYTES), "SIZE", "drawings"),
        ((n == 5) & (third == "report") & F.col("path").endswith(".html") & (size > P.MAX_HTML_BYTES), "SIZE", "html"),
        ((n == 5) & (third == "visual") & (F.get(p, F.lit(4)) == "index.html") & (size > P.MAX_HTML_BYTES), "SIZE", "html"),
        ((n >= 6) & (third == "visual") & (F.get(p, F.lit(4)) == "assets") & (size > P.MAX_ASSET_BYTES), "SIZE", "visual")])
    sums = files.groupBy(*group).agg(F.sum("length").alias("n")).filter(F.col("n") > total)
    return over.unionByName(sums.select(*group, F.lit("").alias("path"), F.lit("TOTAL_SIZE").alias("check_id"),
                                        F.lit("major").alias("severity"), F.col("n").cast("string").alias("detail")))


def check_paths(changes: DataFrame, keys: Sequence[str], author: str = "author", bypass: str | None = None) -> DataFrame:
    """Ownership and placement of changed files: the first broken rule per path."""
    path, p = F.col("path"), F.split("path", "/")
    part = lambda i: F.coalesce(F.get(p, F.lit(i)), F.lit(""))
    n, who = F.size(p), F.col(author)
    free = F.coalesce(F.col(bypass), F.lit(False)) if bypass else F.lit(False)
    own = part(1)
    root_ok = (n == 4) & part(3).isin("proposal.md", "changelog.md", "risk.json", "spatial.json", "simulation.json",
                                      *P.PACKAGE_JSON_FILES)
    protected = F.lit(False)
    for prefix in P.PROTECTED_PREFIXES:
        protected = protected | path.startswith(prefix)
    assets, geometry = (n >= 5) & (part(3) == "assets"), (n == 5) & (part(3) == "geometry")
    drawings, report = (n == 5) & (part(3) == "drawings"), (n == 5) & (part(3) == "report")
    index = (n == 5) & (part(3) == "visual") & (part(4) == "index.html")
    visual = (n >= 6) & (part(3) == "visual") & (part(4) == "assets")
    outside = part(0) != "submissions"
    verdict = (F.when(protected, "REVIEW_ARTIFACT")
               .when(path.isin(P.MAINTAINER_FILES), F.when(~free, "MAINTAINER_ONLY"))
               .when(~free & path.isin(P.PROTECTED_FILES), "PROTECTED_FILE")
               .when(~free & (outside | (n < 2)), "OUTSIDE_SUBMISSIONS")
               .when(~free & (F.lower(own) != F.lower(who)), "NOT_OWNER")
               .when(outside, F.lit(None).cast("string"))
               .when(n < 4, "TOO_SHALLOW")
               .when(~own.rlike(P.LOGIN_PATTERN), "LOGIN_FORM")
               .when(~part(2).rlike(P.SLUG_PATTERN), "SLUG_FORM")
               .when(root_ok | index, F.lit(None).cast("string"))
               .when(assets, F.when(~_ext(path).isin(P.ASSET_EXTENSIONS), "ASSET_EXTENSION"))
               .when(geometry, F.when(~part(4).isin(P.GEOMETRY_FILES), "GEOMETRY_NAME"))
               .when(drawings, F.when(_ext(path) != ".pdf", "DRAWING_EXTENSION"))
               .when(report, F.when(~part(4).isin(P.REPORT_FILES), "REPORT_NAME"))
               .when(visual, F.when(~_ext(path).isin(P.VISUAL_ASSET_EXTENSIONS), "VISUAL_EXTENSION"))
               .otherwise("PLACEMENT"))
    return changes.select(*keys, "path", verdict.alias("check_id")).filter("check_id IS NOT NULL")


def empty_pdf(content: Column) -> Column:
    """Placeholder drawing: a page tree of zero, or a tiny file without a page."""
    def judge(t):
        return F.when(~t.startswith("%PDF"), False).when(t.rlike(r"/Count\s+0\b"), True).otherwise(
            ~t.rlike(r"/Type\s*/Page\b") & (F.length(t) < 2048))
    return let(F.decode(content, "ISO-8859-1"), judge)


def check_manifest(manifest: DataFrame, project: str | None = None) -> DataFrame:
    """Rules on the manifest header: one row per submission and broken rule."""
    state, kind = F.col("package_state"), F.col("package_type")
    rules = [
        (~F.coalesce(F.col("submission_stage") == "formal", F.lit(False)), "STAGE", blank(F.col("submission_stage")), "error"),
        (kind.isNull(), "PACKAGE_TYPE_ABSENT", "", "warning"),
        (kind != "professional_design_package", "PACKAGE_TYPE", kind, "error"),
        (state.isNull(), "PACKAGE_STATE_ABSENT", "", "warning"),
        (state == "scaffold", "SCAFFOLD", "", "error"),
        (~state.isin("scaffold", "ready_for_review"), "PACKAGE_STATE", state, "error"),
        (~F.coalesce(F.col("submission_type") == "ai_agent", F.lit(False)), "SUBMISSION_TYPE", "", "error"),
        (F.size("known_blockers") > 0, "KNOWN_BLOCKERS", "", "warning")]
    if project:
        rules.append((~F.coalesce(F.col("project_id") == project, F.lit(False)), "PROJECT", "", "error"))
    return rule_rows(manifest, ["submission"], rules)


def check_manifest_files(listed: DataFrame, files: DataFrame, required: Sequence[str] = P.REQUIRED_PACKAGE_FILES,
                         submissions: DataFrame | None = None) -> DataFrame:
    """Listed paths: unsafe, duplicate, absent, without hash or with another hash; required but unlisted."""
    def rows(df, check_id):
        return df.select("submission", "path", F.lit(check_id).alias("check_id"))
    safe = listed.filter(safe_path(F.col("path")))
    unique = first_in_group(safe, ["submission", "path"], [F.col("pos")])
    both = unique.join(files.select("submission", "path", F.col("sha256").alias("__sha")), ["submission", "path"], "left")
    verdict = (F.when(F.col("__sha").isNull(), "FILE_MISSING")
               .when((blank(F.col("sha256")) == "") & (F.col("path") != "manifest.json"), "HASH_MISSING")
               .when((blank(F.col("sha256")) != "") & (F.col("sha256") != F.col("__sha")), "HASH_MISMATCH"))
    judged = both.select("submission", "path", verdict.alias("check_id")).filter("check_id IS NOT NULL")
    flags = [F.coalesce(F.bool_or(F.col("path") == r), F.lit(False)).alias(f"r{i}") for i, r in enumerate(required)]
    gaps = for_all(safe.groupBy("submission").agg(*flags), submissions).select("submission", F.explode(F.array_compact(F.array(*[
        F.when(~F.col(f"r{i}"), F.lit(r)) for i, r in enumerate(required)]))).alias("path"))
    return (rows(listed.filter(~safe_path(F.col("path"))), "UNSAFE_PATH")
            .unionByName(rows(later_duplicates(safe, ["submission", "path"], "pos"), "DUPLICATE_PATH"))
            .unionByName(judged).unionByName(rows(gaps, "REQUIRED_UNLISTED")))


# ---- risk, concept and evidence tables -----------------------------------------------------

def _risk_texts(*texts: Column) -> list[Column]:
    joined = F.concat_ws("\n", *[blank(t) for t in texts])
    return [F.transform(pattern_hits(joined, P.HARD_RISK_PATTERNS), lambda r: issue("HARD_RISK", r, "error")),
            F.transform(pattern_hits(joined, P.SOFT_RISK_PATTERNS), lambda r: issue("SOFT_RISK", r, "warning"))]


def _length(c: str) -> Column:
    return F.length(strip(blank(F.col(c))))


def check_risks(risk: DataFrame, group: Sequence[str], known: Sequence[str] = P.RISK_DIMENSIONS) -> DataFrame:
    """``score`` is text as given; anything but an integer is a finding."""
    keys = [*group, "pos"]
    score = F.when(F.col("score").rlike(r"^-?\d+$"), F.col("score").cast("int"))
    valid = score.isNotNull()
    none = F.array().cast("array<struct<check_id:string,severity:string,detail:string>>")
    extra = [F.when(valid, x).otherwise(none) for x in _risk_texts(F.col("note"), F.col("mitigation"), F.col("human_review"))]
    rows = rule_rows(risk, keys, [
        (~F.coalesce(strip(F.col("id")).isin(list(known)), F.lit(False)), "RISK_UNKNOWN", blank(F.col("id")), "error"),
        (_length("label") == 0, "RISK_LABEL", "", "error"),
        (~valid, "RISK_SCORE_TYPE", "", "error"),
        (valid & ~score.between(1, 5), "RISK_SCORE_RANGE", "", "error"),
        (valid & (_length("note") < 8), "RISK_NOTE", "", "error"),
        (valid & (_length("mitigation") < 8), "RISK_MITIGATION", "", "error"),
        (valid & (score >= 4) & (_length("human_review") < 8), "RISK_HUMAN_REVIEW", "", "error")], *extra)
    dup = later_duplicates(risk.filter(F.col("id").isin(list(known))), [*group, "id"], "pos")
    return rows.unionByName(dup.select(*keys, F.lit("RISK_DUPLICATE").alias("check_id"), F.lit("error").alias("severity"),
                                       F.col("id").alias("detail")))


def check_concepts(items: DataFrame, group: Sequence[str], scenarios: DataFrame, limit: int = 24) -> DataFrame:
    """Concept-spatial items; ``geometry`` is a map of text, coordinates are not allowed."""
    keys = [*group, "pos"]
    geo = F.col("geometry")
    forbidden = F.coalesce(list_issues(F.array_except(F.map_keys(geo), words(["mode", "label"])), "CONCEPT_GEOMETRY_KEY",
                                       lambda v: v, "error"), F.array().cast("array<struct<check_id:string,severity:string,detail:string>>"))
    rows = rule_rows(items, keys, [
        (~blank(F.col("id")).rlike(P.SLUG_PATTERN), "CONCEPT_ID", blank(F.col("id")), "error"),
        (~F.coalesce(F.col("type").isin(P.CONCEPT_TYPES), F.lit(False)), "CONCEPT_TYPE", "", "error"),
        (_length("title") < 2, "CONCEPT_TITLE", "", "error"), (_length("summary") < 8, "CONCEPT_SUMMARY", "", "error"),
        (_length("source") < 2, "CONCEPT_SOURCE", "", "error"),
        (~F.coalesce(F.col("public_level").isin(P.PUBLIC_LEVELS), F.lit(False)), "CONCEPT_LEVEL", "", "error"),
        (F.col("public_level") == "provisional", "CONCEPT_PROVISIONAL", "", "warning"),
        (geo.isNull(), "CONCEPT_GEOMETRY", "", "error"),
        (geo.isNotNull() & ~F.coalesce(geo["mode"] == "concept", F.lit(False)), "CONCEPT_MODE", "", "error"),
        (geo.isNotNull() & (F.length(strip(blank(geo["label"]))) < 2), "CONCEPT_PLACE", "", "error")],
        forbidden, *_risk_texts(F.col("title"), F.col("summary"), F.col("source"), geo["label"]))
    dup = later_duplicates(items.filter(blank(F.col("id")).rlike(P.SLUG_PATTERN)), [*group, "id"], "pos")
    many = items.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    linked = items.select(*keys, F.explode("linked_scenarios").alias("detail")).join(
        scenarios.select(F.col(scenarios.columns[0]).alias("detail")).distinct(), "detail", "left_anti")
    shape = lambda df, check, detail: df.select(
        *keys, F.lit(check).alias("check_id"), F.lit("error").alias("severity"), detail.alias("detail"))
    return (rows.unionByName(shape(dup, "CONCEPT_DUPLICATE", F.col("id")))
            .unionByName(shape(many.withColumn("pos", F.lit(None).cast(items.schema["pos"].dataType)), "CONCEPT_TOO_MANY",
                               F.col("n").cast("string")))
            .unionByName(shape(linked, "CONCEPT_SCENARIO", F.col("detail"))))


def _coverage(matrix: DataFrame, col: str, required: Sequence[str], submissions: DataFrame | None) -> DataFrame:
    flags = [F.coalesce(F.bool_or(F.col(col) == r), F.lit(False)).alias(f"r{i}") for i, r in enumerate(required)]
    return for_all(matrix.groupBy("submission").agg(*flags), submissions).select(
        "submission", F.lit(None).cast(matrix.schema["pos"].dataType).alias("pos"), F.lit("NOT_COVERED").alias("check_id"),
        F.lit("major").alias("severity"), F.explode(F.array_compact(F.array(*[
            F.when(~F.col(f"r{i}"), F.lit(r)) for i, r in enumerate(required)]))).alias("detail"))


def _arrays(cols: Sequence[str]) -> Column:
    return list_issues(F.array_compact(F.array(*[F.when(~string_array_ok(F.col(c)), F.lit(c)) for c in cols])),
                       "STRING_ARRAY", lambda v: v)


def check_requirements(matrix: DataFrame, required: Sequence[str] = P.REQUIRED_TASK_IDS,
                       arrays: Sequence[str] = P.REQUIREMENT_ARRAYS,
                       submissions: DataFrame | None = None) -> DataFrame:
    rows = rule_rows(matrix, ["submission", "pos"], [
        (blank(F.col("requirement_id")) == "", "ID_MISSING", ""),
        (~F.col("mandatory").eqNullSafe(F.lit(True)), "NOT_MANDATORY", "")], _arrays(arrays))
    return rows.unionByName(_coverage(matrix, "requirement_id", required, submissions))


def check_standards(matrix: DataFrame, required: Sequence[str] = P.REQUIRED_STANDARD_IDS,
                    arrays: Sequence[str] = P.EVIDENCE_ARRAYS,
                    submissions: DataFrame | None = None) -> DataFrame:
    status = F.col("review_status")
    rows = rule_rows(matrix, ["submission", "pos"], [
        (blank(F.col("standard_id")) == "", "ID_MISSING", ""),
        (~nonblank(F.col("requirement_zh")), "TEXT_MISSING", "requirement_zh"),
        (~nonblank(F.col("professional_dimension")), "TEXT_MISSING", "professional_dimension"),
        (~nonblank(F.col("evidence_summary_zh")), "TEXT_MISSING", "evidence_summary_zh"),
        (~F.coalesce(status.isin("addressed", "data_gap", "not_applicable"), F.lit(False)), "STATUS", blank(status)),
        (F.col("mandatory").eqNullSafe(F.lit(True)) & ~status.eqNullSafe(F.lit("addressed")), "MANDATORY_NOT_ADDRESSED", "")],
        _arrays(arrays))
    return rows.unionByName(_coverage(matrix, "standard_id", required, submissions))


def check_depth(matrix: DataFrame, required: Sequence[str] = P.REQUIRED_DEPTH_IDS,
                arrays: Sequence[str] = P.EVIDENCE_ARRAYS,
                    submissions: DataFrame | None = None) -> DataFrame:
    rows = rule_rows(matrix, ["submission", "pos"], [
        (blank(F.col("item_id")) == "", "ID_MISSING", ""),
        (~nonblank(F.col("title_zh")), "TEXT_MISSING", "title_zh"),
        (~nonblank(F.col("professional_dimension")), "TEXT_MISSING", "professional_dimension"),
        (~nonblank(F.col("evidence_summary_zh")), "TEXT_MISSING", "evidence_summary_zh"),
        (~F.col("required").eqNullSafe(F.lit(True)), "NOT_REQUIRED", ""),
        (~F.col("status").eqNullSafe(F.lit("complete")), "NOT_COMPLETE", blank(F.col("status")))], _arrays(arrays))
    return rows.unionByName(_coverage(matrix, "item_id", required, submissions))


def check_selfcheck(checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    result, severity = F.col("result"), F.col("severity")
    return rule_rows(checks.withColumnRenamed("severity", "__sev"), keys, [
        (~F.coalesce(result.isin("pass", "fail", "unknown", "not_applicable"), F.lit(False)), "RESULT", blank(result)),
        (~F.coalesce(F.col("__sev").isin("blocking", "major", "minor", "info"), F.lit(False)), "SEVERITY", blank(F.col("__sev"))),
        ((result == "fail") & (F.col("__sev") == "blocking"), "BLOCKING_FAIL", blank(F.col("check")))])


def check_publication(entries: DataFrame, packages: DataFrame, position: str = "pos") -> DataFrame:
    """Publication registry: forms, implications and the hash of the reviewed package."""
    keys = ["path"]
    is_true = lambda c: F.col(c).eqNullSafe(F.lit(True))
    published, featured = is_true("published"), is_true("featured")
    flags = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("published", "featured", "rights_reviewed")]))
    dates = F.array_compact(F.array(*[F.when(F.try_to_date(F.when(F.col(c).rlike(P.DATE_PATTERN), F.col(c)), "yyyy-MM-dd").isNull(), F.lit(c))
                                      for c in ("reviewed_at", "selected_at")]))
    reasons = F.array_compact(F.array(*[F.when(_length(c) < 5, F.lit(c)) for c in ("selection_reason_zh", "selection_reason_en")]))
    tier = F.col("quality_tier")
    rows = rule_rows(entries, keys, [
        (~F.coalesce(F.col("review_status").isin("approved_for_publication", "not_approved"), F.lit(False)), "REVIEW_STATUS", ""),
        (~F.coalesce(tier.isin("qualified", "featured"), F.lit(False)), "QUALITY_TIER", ""),
        (~blank(F.col("reviewed_by")).rlike(P.LOGIN_PATTERN), "REVIEWER_FORM", ""),
        (~blank(F.col("reviewed_package_sha256")).rlike("^[0-9a-f]{64}$"), "SHA_FORM", ""),
        (~F.col("path").rlike("^submissions/[^/]+/[^/]+/?$"), "PATH_FORM", ""),
        (featured & ~published, "FEATURED_NOT_PUBLISHED", ""),
        (published & (F.col("review_status") != "approved_for_publication"), "PUBLISHED_NOT_APPROVED", ""),
        (published & ~is_true("rights_reviewed"), "RIGHTS_NOT_REVIEWED", ""),
        (featured & (tier != "featured"), "FEATURE_TIER", ""),
        (F.col("featured").eqNullSafe(F.lit(False)) & (tier == "featured"), "TIER_WITHOUT_FEATURE", "")],
        list_issues(flags, "FLAG_MISSING", lambda v: v), list_issues(dates, "DATE_FORM", lambda v: v),
        list_issues(reasons, "REASON_SHORT", lambda v: v))
    live = entries.filter(published).join(packages.select("path", F.col("sha256").alias("__sha")), "path", "left")
    stale = live.select("path", F.when(F.col("__sha").isNull(), "PACKAGE_MISSING").when(
        F.col("__sha") != F.col("reviewed_package_sha256"), "SHA_STALE").alias("check_id")).filter("check_id IS NOT NULL")
    dup = later_duplicates(entries, ["path"], position).select("path", F.lit("DUPLICATE_PATH").alias("check_id"))
    tail = stale.unionByName(dup).select("path", "check_id", F.lit("major").alias("severity"), F.lit("").alias("detail"))
    return rows.unionByName(tail)


def classify_pixels(px: DataFrame, legend: Sequence[tuple[str, int, int, int, int]], white: int = 60) -> DataFrame:
    """Pixels within the tolerance of a legend colour; near-white ones are dropped.

    The legend is a handful of colours, so the test is an array inside the row
    and a pixel may fall into several classes.
    """
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    coloured = F.abs(r - 255) + F.abs(g - 255) + F.abs(b - 255) > white
    matches = F.array_compact(F.array(*[F.when(
        (F.abs(r - lr) <= tol) & (F.abs(g - lg) <= tol) & (F.abs(b - lb) <= tol), F.lit(name))
        for name, lr, lg, lb, tol in legend]))
    return px.filter(coloured).withColumn("class", F.explode(matches))


def plausible(land: Column, floor: Column) -> Column:
    """Land 1e3..5e5, floor 1e3..2e6 and not a year, at most three decimals."""
    lf, ff = land.try_cast("double"), floor.try_cast("double")
    decimals = lambda c: F.length(F.regexp_extract(blank(c), r"\.([^.]*)$", 1)) <= 3
    return F.coalesce(lf.between(1000, 500000) & ff.between(1000, 2000000) & ~ff.between(1950, 2030)
                      & decimals(land) & decimals(floor), F.lit(False))
