"""Rule tables: extraction from policy documents, evaluation, and the report."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import checks as K
from ..operators import joins as J
from ..operators import overlay as O
from ..scale import top_k
from ..sources.readers import enum_codes
from . import isolation

RULE_SCHEMA = ("constraint_id string, name string, check_type string, check_function string, params string, "
               "severity string, category string, enabled boolean")


# ---- extraction ---------------------------------------------------------------------------------

def _rule(cid: Column, name: Column, function: str, params: Column, severity: str, category: str, check_type: str = "CODE") -> Column:
    return F.struct(cid.alias("constraint_id"), name.alias("name"), F.lit(check_type).alias("check_type"), F.lit(function).alias("check_function"),
                    params.alias("params"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(True).alias("enabled"))


def _texts(path: str) -> Column:
    return F.try_variant_get("doc", path, "array<string>")


def _rows(path: str) -> Column:
    return F.coalesce(F.try_variant_get("doc", path, "array<variant>"), F.array().cast("array<variant>"))


def _s(v: Column, key: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{key}", "string"), F.lit(""))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def _emit(docs: DataFrame, kind: str, rules: Sequence[Column], many: Sequence[Column] = ()) -> DataFrame:
    every = F.array_compact(F.array(*rules)) if rules else None
    for m in many:
        every = m if every is None else F.concat(every, m)
    return docs.filter((F.col("kind") == kind) & F.col("doc").isNotNull()).select("policy", F.inline(every))


def _area_rule(prefix: str, id_key: str):
    return lambda s: F.when(F.try_variant_get(s, "$.area_sqm", "double") > 0, _rule(
        F.concat(F.lit(prefix), _s(s, id_key)), F.concat(F.lit("area_tolerance_"), _s(s, id_key)), "verify_area_tolerance",
        _json(declared_area_sqm=F.try_variant_get(s, "$.area_sqm", "double"), tolerance_pct=F.lit(5.0), scope_label=_s(s, "label_zh")), "high", "spatial"))


def from_design_brief(docs: DataFrame) -> DataFrame:
    crs = _rule(F.lit("C-COORD-001"), F.lit("area_calculation_crs"), "verify_crs_used", F.lit('{"required_epsg":4548}'), "critical", "spatial")
    return _emit(docs, "design_brief", [crs], [F.array_compact(F.transform(_rows("$.official_scope_levels"), _area_rule("C-AREA-", "scope_id"))),
                                               F.array_compact(F.transform(_rows("$.key_areas"), _area_rule("C-AREA-KEY-", "area_id")))])


def from_design_space(docs: DataFrame) -> DataFrame:
    req, locked, edit, bad = (_texts(f"$.{k}") for k in ("required_submission_layers", "locked_layers", "editable_layers", "forbidden_claims"))
    none = F.array().cast("array<string>")
    policy = F.try_variant_get("doc", "$.geometry_policy", "variant").isNotNull()
    one = lambda cond, *a: F.when(cond, _rule(*a))
    return _emit(docs, "allowed_design_space", [
        one(F.size(req) > 0, F.lit("C-LAYER-001"), F.lit("required_layers_present"), "verify_required_layers", _json(required_layers=req), "critical", "spatial"),
        one(F.size(locked) > 0, F.lit("C-LAYER-002"), F.lit("locked_layers_untouched"), "verify_locked_layers", _json(locked_layers=locked), "critical", "spatial"),
        one(F.size(edit) > 0, F.lit("C-LAYER-003"), F.lit("all_features_in_known_layers"), "verify_layer_names",
            _json(valid_layers=F.array_sort(F.array_distinct(F.concat(edit, F.coalesce(locked, none))))), "high", "spatial"),
        one(policy, F.lit("C-GEO-001"), F.lit("features_within_boundary"), "verify_features_within_boundary", _json(generated_layers=F.coalesce(edit, none)), "critical", "spatial"),
        one(policy, F.lit("C-GEO-002"), F.lit("no_gaps_in_land_use"), "verify_land_use_coverage", F.lit("{}"), "critical", "spatial"),
        one(policy, F.lit("C-GEO-003"), F.lit("no_land_use_overlap"), "verify_no_land_use_overlap", F.lit("{}"), "critical", "spatial"),
        one(F.size(bad) > 0, F.lit("C-TEXT-FORBIDDEN"), F.lit("no_forbidden_claims"), "grep_forbidden_patterns", _json(forbidden_patterns=bad), "critical", "compliance")])


def from_taskbook(docs: DataFrame) -> DataFrame:
    bad = _texts("$.boundary_clause.forbidden_final_conclusions_zh")
    tasks = F.transform(_rows("$.required_agent_tasks"), lambda t: _rule(
        F.concat(F.lit("C-TASK-"), F.replace(_s(t, "requirement_id"), F.lit("."), F.lit("-"))), F.concat(F.lit("task_coverage_"), _s(t, "requirement_id")),
        "verify_task_coverage", _json(requirement_id=_s(t, "requirement_id"), title_zh=_s(t, "title_zh")), "critical", "compliance"))
    charter = F.transform(_rows("$.co_creation_charter"), lambda c: _rule(
        F.concat(F.lit("C-CHARTER-"), F.replace(_s(c, "principle_id"), F.lit("."), F.lit("-"))), F.concat(F.lit("charter_"), _s(c, "principle_id")),
        "llm_charter_check", _json(principle_id=_s(c, "principle_id")), "high", "compliance", "LLM"))
    wording = X.blank(F.try_variant_get("doc", "$.boundary_clause.required_wording_zh", "string"))
    return _emit(docs, "agent_taskbook", [
        F.when(F.size(bad) > 0, _rule(F.lit("C-TEXT-BOUNDARY-001"), F.lit("no_forbidden_final_conclusions"), "grep_forbidden_patterns", _json(forbidden_patterns=bad), "critical", "compliance")),
        F.when(wording != "", _rule(F.lit("C-TEXT-BOUNDARY-002"), F.lit("required_wording_present"), "verify_required_wording",
                                    _json(required_phrases=X.words(P.REQUIRED_PHRASES)), "critical", "compliance"))], [tasks, charter])


def from_planning_limits(docs: DataFrame) -> DataFrame:
    """A bound needs both ends; controls marked missing must be documented."""
    bounds = F.map_entries(F.try_variant_get("doc", "$.schema_sanity_bounds_not_planning_approval", "map<string,variant>"))
    number = lambda v, k: F.try_variant_get(v, f"$.{k}", "double")
    sane = F.transform(F.filter(bounds, lambda e: number(e["value"], "min").isNotNull() & number(e["value"], "max").isNotNull()), lambda e: _rule(
        F.concat(F.lit("C-SANITY-"), e["key"]), F.concat(F.lit("sanity_bound_"), e["key"]), "verify_sanity_bounds",
        _json(metric_key=e["key"], min_val=number(e["value"], "min"), max_val=number(e["value"], "max")), "high", "metric"))
    controls = F.map_entries(F.try_variant_get("doc", "$.official_planning_controls", "map<string,variant>"))
    gone = F.transform(F.filter(controls, lambda e: _s(e["value"], "status") == "missing"), lambda e: e["key"])
    rule = F.when(F.size(gone) > 0, _rule(F.lit("C-ASSUMPTIONS-001"), F.lit("missing_controls_documented"), "verify_missing_controls_documented",
                                          _json(missing_controls=F.array_sort(gone)), "high", "compliance"))
    empty = F.array().cast("array<struct<constraint_id:string,name:string,check_type:string,check_function:string,params:string,severity:string,category:string,enabled:boolean>>")
    return _emit(docs, "planning_limits", [rule], [F.coalesce(sane, empty)])


def from_source_registry(docs: DataFrame) -> DataFrame:
    ids = F.transform(F.filter(_rows("$.sources"), lambda s: _s(s, "usable_for_formal") == "provisional_only"), lambda s: _s(s, "source_id"))
    return _emit(docs, "source_registry", [F.when(F.size(ids) > 0, _rule(
        F.lit("C-SOURCE-001"), F.lit("no_provisional_source_upgrade"), "verify_source_authority",
        _json(provisional_source_ids=ids, formal_required_fields=X.words(P.FORMAL_FIELDS)), "critical", "compliance"))])


def from_enums(docs: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """One rule per enum document; the target column is named outright."""
    fields = fields or {"land_use_codes": "land_use_code", "building_types": "building_type", "road_classes": "road_class"}
    parts = None
    for kind, column in fields.items():
        codes = enum_codes(F.col("doc"))
        one = _emit(docs, kind, [F.when(F.size(codes) > 0, _rule(F.lit(f"C-ENUM-{kind}"), F.lit(f"valid_{kind}"), "verify_enum_values", _json(
            enum_name=F.lit(kind), valid_codes=codes, target_geojson_field=F.lit(column)), "high", "spatial"))])
        parts = one if parts is None else parts.unionByName(one)
    return parts


def from_boundaries(docs: DataFrame) -> DataFrame:
    wanted = F.filter(_rows("$.features"), lambda f: (_s(f, "properties.layer") == "SITE_BOUNDARY")
                      & F.try_variant_get(f, "$.properties.official_boundary", "boolean").eqNullSafe(F.lit(False)))
    return _emit(docs, "provisional_boundaries", [], [F.transform(wanted, lambda f: _rule(
        F.concat(F.lit("C-BOUNDARY-PROV-"), _s(f, "properties.id")), F.concat(F.lit("provisional_boundary_marked_"), _s(f, "properties.id")),
        "verify_provisional_marking", F.lit('{"geometry_role":"provisional_constraint","official_boundary":false}'), "critical", "spatial"))])


EXTRACTORS = [from_design_brief, from_design_space, from_taskbook, from_planning_limits, from_source_registry, from_enums, from_boundaries]


def extract_rules(docs: DataFrame) -> DataFrame:
    """Rules of policy documents (policy, kind, doc VARIANT): union of all extractors."""
    out = EXTRACTORS[0](docs)
    for f in EXTRACTORS[1:]:
        out = out.unionByName(f(docs), allowMissingColumns=True)
    return out


# ---- evaluation -----------------------------------------------------------------------------------

Tables = dict[str, DataFrame]
Checker = Callable[[Tables, DataFrame], DataFrame]
OUT = ["submission", "constraint_id", "outcome", "detail", "evidence"]


def _params(rules: DataFrame, schema: str) -> DataFrame:
    return rules.select("constraint_id", F.from_json("params", schema).alias("p")).select("constraint_id", "p.*")


def _grid(tables: Tables, rules: DataFrame) -> DataFrame:
    return K.with_each(tables["submissions"].select("submission"), rules)


def _judge(grid: DataFrame, bad: DataFrame, present: DataFrame | None, absent: str, label: str, k: int = 5) -> DataFrame:
    """Outcome per rule and submission: FAIL with a count and the first k findings as evidence.

    ``bad`` holds (submission, constraint_id, finding); ``present`` the
    submissions that have the file at all.
    """
    keys = ["submission", "constraint_id"]
    n = bad.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    head = top_k(bad, keys, [F.col("finding")], k).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("finding")), "\n").alias("__e"))
    out = grid.select(*keys).join(n, keys, "left").join(head, keys, "left")
    if present is not None:
        out = out.join(present.select("submission").distinct().withColumn("__p", F.lit(True)), "submission", "left")
    else:
        out = out.withColumn("__p", F.lit(True))
    outcome = F.when(F.col("__p").isNull(), absent).when(F.col("__n") > 0, "FAIL").otherwise("PASS")
    detail = F.when(F.col("__p").isNull(), "file missing").when(F.col("__n") > 0, F.concat("__n", F.lit(f" {label}"))).otherwise("")
    return out.select(*keys, outcome.alias("outcome"), detail.alias("detail"), F.when(F.col("__p").isNotNull(), X.blank(F.col("__e"))).otherwise("").alias("evidence"))


def _feature_check(schema: str, test: Callable[[], Column], finding: Callable[[], Column], label: str) -> Checker:
    def run(tables, rules):
        p = _params(rules, schema)
        hit = K.with_each(tables["features"], p).filter(test()).select("submission", "constraint_id", finding().alias("finding"))
        return _judge(_grid(tables, p.select("constraint_id")), hit, None, "SKIP", label)
    return run


def _where(what: Column) -> Column:
    return F.concat_ws(": ", F.concat_ws("#", "layer_file", "feature_id"), what)


def _required_layers(tables, rules):
    p = _params(rules, "required_layers array<string>, optional_layers array<string>")
    optional = F.coalesce("optional_layers", X.words(["SITE_BOUNDARY"]))
    alias = F.create_map(*[F.lit(x) for kv in P.CANONICAL_LAYER_FILES.items() for x in kv])
    need = _grid(tables, p).select("submission", "constraint_id", optional.alias("optional"), F.explode("required_layers").alias("layer"))
    names = need.select("*", F.explode(F.array_distinct(F.array(F.concat(F.lower("layer"), F.lit(".geojson")), F.coalesce(
        F.try_element_at(alias, F.col("layer")), F.concat(F.lower("layer"), F.lit(".geojson")))))).alias("name"))
    have = tables["files"].select("submission", F.element_at(F.split("path", "/"), -1).alias("name")).distinct()
    seen = names.join(have, ["submission", "name"], "left_semi").select("submission", "constraint_id", "layer").distinct()
    gone = need.join(seen, ["submission", "constraint_id", "layer"], "left_anti").filter(~F.array_contains("optional", F.col("layer")))
    return _judge(_grid(tables, p.select("constraint_id")), gone.select("submission", "constraint_id", F.col("layer").alias("finding")), None, "SKIP", "required layers missing")


def _area_tolerance(tables, rules):
    p = _params(rules, "declared_area_sqm double, tolerance_pct double, metric_key string").select(
        F.col("constraint_id").alias("rule_id"), F.col("metric_key").alias("metric"), F.col("declared_area_sqm").alias("declared"), "tolerance_pct")
    # A rule without a metric key is not guessed at: it has nothing to compare with.
    keyed = p.withColumn("declared", F.when(F.col("metric").isNotNull(), F.col("declared")))
    r = K.check_area_tolerance(tables["submissions"], tables["metrics"], keyed)
    return r.select("submission", F.col("rule_id").alias("constraint_id"), "outcome", F.when(F.col("outcome") == "FAIL", F.concat(
        F.lit("area off by "), F.coalesce(F.round("delta_pct", 1).cast("string"), F.lit("unknown")), F.lit("%"))).otherwise("").alias("detail"), X.blank(F.col("metric")).alias("evidence"))


def _sanity_bounds(tables, rules):
    p = _params(rules, "metric_key string, min_val double, max_val double").select(F.col("constraint_id").alias("rule_id"), F.col("metric_key").alias("metric"), "min_val", "max_val")
    r = K.check_bounds(tables["submissions"], tables["metrics"], p)
    return r.select("submission", F.col("rule_id").alias("constraint_id"), "outcome", F.when(F.col("outcome") == "FAIL", F.concat_ws(
        " ", "metric", F.lit("out of bounds"))).otherwise("").alias("detail"), F.concat_ws("=", "metric", F.col("value").cast("string")).alias("evidence"))


def _document_check(schema: str, findings: Callable[[], Column], label: str, absent: str, file: str = "proposal.md") -> Checker:
    def run(tables, rules):
        p = _params(rules, schema)
        docs = tables["docs"].filter(F.col("file") == file)
        hit = K.with_each(docs, p).select("submission", "constraint_id", F.explode(findings()).alias("finding"))
        return _judge(_grid(tables, p.select("constraint_id")), hit, docs, absent, label)
    return run


def _forbidden() -> Column:
    words = F.filter(F.flatten(F.transform("forbidden_patterns", lambda p: F.transform(F.split(p, "[、，,]"), X.strip))), lambda w: w != "")
    return F.filter(words, lambda w: F.contains(F.col("text"), w))


def _task_coverage(tables, rules):
    p = _params(rules, "requirement_id string")
    m = tables["matrix"].groupBy("submission", "requirement_id").agg(F.max("evidence_count").alias("__c"))
    g = _grid(tables, p).join(m, ["submission", "requirement_id"], "left")
    detail = F.when(F.col("__c").isNull(), "not covered").when(F.col("__c") == 0, "covered without evidence").otherwise("")
    return g.select("submission", "constraint_id", F.when(detail == "", "PASS").otherwise("FAIL").alias("outcome"), detail.alias("detail"), F.col("requirement_id").alias("evidence"))


def _controls_documented(tables, rules):
    p = _params(rules, "missing_controls array<string>")
    entry = tables["assumptions"].select("submission", F.lower(X.blank(F.col("entry"))).alias("__e"))
    seen = K.with_each(entry, p).select("submission", "constraint_id", F.explode(F.filter(
        "missing_controls", lambda c: F.contains(F.col("__e"), F.lower(c)))).alias("finding")).distinct()
    need = _grid(tables, p).select("submission", "constraint_id", F.explode("missing_controls").alias("finding"))
    return _judge(_grid(tables, p.select("constraint_id")), need.join(seen, ["submission", "constraint_id", "finding"], "left_anti"), None, "FAIL", "controls not documented")


def _source_authority(tables, rules):
    p = _params(rules, "provisional_source_ids array<string>, formal_required_fields array<string>")
    used = F.filter("formal_required_fields", lambda f: F.contains(F.lower(X.blank(F.col("row_text"))), f))
    hit = K.with_each(tables["sources"], p).filter(F.array_contains("provisional_source_ids", F.col("source_id")) & (F.size(used) > 0)).select(
        "submission", "constraint_id", F.concat_ws(": ", "source_id", used[0]).alias("finding"))
    return _judge(_grid(tables, p.select("constraint_id")), hit, tables["sources"], "SKIP", "provisional sources used formally")


def _crs_used(tables, rules):
    docs = tables["docs"].filter("file = 'metrics.json'")
    grid = _grid(tables, rules.select("constraint_id"))
    bad = K.with_each(docs.filter(~F.contains("text", F.lit("4548"))), rules.select("constraint_id")).select("submission", "constraint_id", F.lit("EPSG:4548 not named").alias("finding"))
    return _judge(grid, bad, docs, "SKIP", "metric files without the projection")


def _layer_rows(tables, layer):
    return tables["features"].filter(F.col("layer") == layer)


def _per_rule(tables, rules, bad: DataFrame, present: DataFrame | None, label: str, absent: str = "SKIP") -> DataFrame:
    """Rules without parameters: the same findings for each of them."""
    ids = rules.select("constraint_id")
    return _judge(_grid(tables, ids), K.with_each(bad.select("submission", "finding"), ids), present, absent, label)


def _within_boundary(tables, rules):
    from .spatial_review import not_contained
    p = _params(rules, "generated_layers array<string>")
    site = _layer_rows(tables, "SITE_BOUNDARY")
    out = not_contained(tables["features"].filter("layer <> 'SITE_BOUNDARY'"), site).join(tables["features"].select("submission", "feature_id", "layer"), ["submission", "feature_id"])
    hit = K.with_each(out, p).filter(F.array_contains("generated_layers", F.col("layer"))).select("submission", "constraint_id", F.concat_ws("/", "layer", "feature_id").alias("finding"))
    return _judge(_grid(tables, p.select("constraint_id")), hit, site, "FAIL", "features outside the site", 10)


def _coverage(tables, rules):
    land, site = _layer_rows(tables, "LAND_USE"), _layer_rows(tables, "SITE_BOUNDARY")
    gap = O.coverage(land, site, ["submission"]).filter("gap_area >= 1").select("submission", F.concat(F.lit("gap "), F.round("gap_area", 0).cast("bigint").cast("string")).alias("finding"))
    return _per_rule(tables, rules, gap, land.join(site.select("submission"), "submission", "left_semi"), "gaps in the land use")


def _overlap(tables, rules):
    land = _layer_rows(tables, "LAND_USE")
    pairs = O.overlap_pairs(land, ["submission"]).select("submission", F.concat_ws("-", "pos", "other_pos").alias("finding"))
    return _per_rule(tables, rules, pairs, land, "land-use overlaps")


def _geometry_valid(tables, rules):
    from .spatial_review import validity
    land = _layer_rows(tables, "LAND_USE")
    bad = validity(land, ["submission", "feature_id"]).select("submission", F.concat_ws(": ", "feature_id", "reason").alias("finding"))
    return _per_rule(tables, rules, bad, land, "invalid geometries")


def _land_use_codes(tables, rules):
    land = _layer_rows(tables, "LAND_USE")
    codes = tables.get("land_use_codes")
    if codes is None:
        codes = land.sparkSession.createDataFrame([(c,) for c in P.FALLBACK_LAND_USE_CODES], "code string")
    bad = K.check_land_use_code(land, ["submission", "feature_id"], codes).select("submission", F.concat_ws(": ", "feature_id", "reason").alias("finding"))
    return _per_rule(tables, rules, bad, land, "invalid land-use codes")


def _heights(tables, rules):
    b = _layer_rows(tables, "BUILDING_FOOTPRINT")
    bad = K.check_heights(b, ["submission", "feature_id"]).select("submission", F.concat_ws(": ", "feature_id", "reason").alias("finding"))
    return _per_rule(tables, rules, bad, b, "building heights")


def _roads(tables, rules):
    r = _layer_rows(tables, "ROAD_CENTERLINE")
    bad = K.check_roads(r).filter("outcome = 'FAIL'").select("submission", F.concat(F.lit("lines "), "road_lines").alias("finding"))
    return _per_rule(tables, rules, bad, r, "thin road networks")


def _green(tables, rules):
    f = tables["features"].withColumn("polys", F.array("rings"))
    g = A.check_green_ratio(f)
    bad = g.filter("outcome = 'FAIL'").select("submission", F.concat(F.lit("ratio "), F.round("ratio", 4).cast("string")).alias("finding"))
    return _per_rule(tables, rules, bad, g.filter("outcome <> 'SKIP'"), "green ratios out of range")


def _concepts(tables, rules):
    from ..operators.documents import scan_concepts
    docs = tables["docs"].filter("file = 'proposal.md'")
    bad = scan_concepts(docs, "submission", "text").filter("outcome = 'FAIL'").select("submission", F.col("missing").alias("finding"))
    return _per_rule(tables, rules, bad, docs, "concept gaps")


CHECKERS: dict[str, Checker] = {
    "verify_required_layers": _required_layers,
    "verify_features_within_boundary": _within_boundary,
    "verify_land_use_coverage": _coverage,
    "verify_no_land_use_overlap": _overlap,
    "verify_area_tolerance": _area_tolerance,
    "verify_provisional_marking": _feature_check(
        "boundary_precision_required boolean", lambda: (F.col("geometry_role") == "provisional_constraint") & (
            ~F.col("official_boundary").eqNullSafe(F.lit(False)) | (X.blank(F.col("boundary_precision")) == "")),
        lambda: _where(F.lit("provisional marking")), "features marked wrongly"),
    "verify_task_coverage": _task_coverage,
    "grep_forbidden_patterns": _document_check("forbidden_patterns array<string>", _forbidden, "forbidden claims", "FAIL"),
    "verify_required_wording": _document_check("required_phrases array<string>", lambda: F.filter(
        "required_phrases", lambda p: ~F.contains(F.col("text"), p)), "required phrases missing", "FAIL"),
    "verify_missing_controls_documented": _controls_documented,
    "verify_source_authority": _source_authority,
    "verify_sanity_bounds": _sanity_bounds,
    "verify_enum_values": _feature_check(
        "enum_name string, valid_codes array<string>, target_geojson_field string", lambda: _enum_bad(), lambda: _where(F.col("enum_name")), "values outside the code list"),
    "verify_crs_used": _crs_used,
    "verify_locked_layers": _feature_check(
        "locked_layers array<string>, allowed_layers array<string>", lambda: F.array_contains("locked_layers", F.col("layer")) & ~F.array_contains(
            F.coalesce("allowed_layers", X.words(["SITE_BOUNDARY", "KEY_AREA"])), F.col("layer")), lambda: _where(F.col("layer")), "features in locked layers"),
    "verify_layer_names": _feature_check(
        "valid_layers array<string>", lambda: (X.blank(F.col("layer")) != "") & ~F.array_contains("valid_layers", F.col("layer")) & ~F.col("layer").startswith("KEY_AREA"),
        lambda: _where(F.col("layer")), "features in unknown layers"),
    "check_land_use_classification": _land_use_codes,
    "check_three_lines_awareness": _concepts,
    "check_land_use_geometry_valid": _geometry_valid,
    "check_building_height": _heights,
    "check_road_network": _roads,
    "check_green_ratio": _green,
}


def _enum_bad() -> Column:
    fields = ["land_use_code", "building_type", "road_class"]
    value = F.lit(None).cast("string")
    for f in fields:
        value = F.when(F.col("target_geojson_field") == f, F.col(f).cast("string")).otherwise(value)
    return (X.blank(value) != "") & (F.size("valid_codes") > 0) & ~F.array_contains("valid_codes", value)


def add_rule(rules: DataFrame, extra: DataFrame) -> DataFrame:
    return rules.unionByName(extra, allowMissingColumns=True)


def set_enabled(rules: DataFrame, constraint_id: str, enabled: bool) -> DataFrame:
    return rules.withColumn("enabled", F.when(F.col("constraint_id") == constraint_id, F.lit(enabled)).otherwise(F.col("enabled")))


def evaluate(rules: DataFrame, tables: Tables, checkers: dict[str, Checker] | None = None,
             attempts: int = isolation.ATTEMPTS) -> DataFrame:
    """Outcome rows of all enabled CODE rules for all submissions.

    The rule table is a parameter table; which of the known checkers it uses is read
    once.  Each checker is one job over all its rules and submissions, and its rows are
    written.  Whatever a checker raises, while its plan is built or while it runs, gives ERROR
    rows for the rules and submissions it fails on (``isolation``); unknown names give SKIP rows.
    """
    known = CHECKERS if checkers is None else checkers
    active = rules.filter((F.col("check_type") == "CODE") & F.coalesce("enabled", F.lit(True)))
    registered = F.coalesce(F.col("check_function").isin(list(known)), F.lit(False))
    used = [r[0] for r in active.filter(registered).select("check_function").distinct().orderBy("check_function").collect()]

    def fixed(mine: DataFrame, outcome: str, text: Column, of: Tables = tables) -> DataFrame:
        return _grid(of, mine.select("constraint_id", text.alias("detail"))).select(
            "submission", "constraint_id", F.lit(outcome).alias("outcome"), "detail", F.lit("").alias("evidence"))

    def failed(mine: DataFrame, of: Tables, why: str) -> DataFrame:
        return fixed(mine, "ERROR", F.lit(why), of)
    unnamed = F.concat(F.lit("No checker registered for '"), X.blank(F.col("check_function")), F.lit("'"))
    jobs = [partial(isolation.run_checker, known[name], tables, active.filter(F.col("check_function") == name), OUT, failed, attempts)
            for name in used]
    out = fixed(active.filter(~registered), "SKIP", unnamed)
    for p in isolation.run_all(jobs):
        out = out.unionByName(p)
    labels = active.select("constraint_id", "name", "severity", "category")
    return out.join(labels, "constraint_id").withColumn("fingerprint", X.fingerprint(F.col("constraint_id"), F.col("detail")))


def all_failures(results: DataFrame, undeclared: DataFrame, unclaimed: DataFrame) -> DataFrame:
    """Failed and erroneous rules, undeclared metrics and unbacked metric claims in one table."""
    made = lambda df, prefix, detail: df.select("submission", F.concat(F.lit(prefix), "metric").alias("constraint_id"), F.lit("FAIL").alias("outcome"), detail.alias("detail"))
    return (results.filter(F.col("outcome").isin("FAIL", "ERROR")).select("submission", "constraint_id", "outcome", "detail")
            .unionByName(made(undeclared, "C-SANITY-", F.lit("undeclared")))
            .unionByName(made(unclaimed, "C-CLAIM-", F.col("reason"))))


def run(rules: DataFrame, overrides: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Overrides merged, rules evaluated, report per submission."""
    results = evaluate(J.apply_overrides(rules, overrides), tables)
    return results, A.rule_report(results)
