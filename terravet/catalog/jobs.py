"""Composite jobs: rules, reviews, gates, gallery, packets, resume, sinks."""

from pyspark.sql import functions as F

from .. import params as P
from ..functions import text as X
from ..operators import aggregates as A
from ..plans import reviews as R
from ..plans import rules as RU
from ..plans import validation as V
from ..sources import writers as W
from ..streaming import history as H
from . import bindings as B
from .checks import DIMS, FEAT_SPARK, FEAT_SQL, MET, MROW, metrics
from ..scale import literal_table
from .registry import query
from .rollups import ISS, REC, SC, gates
from .texts import WS

# ---- rules over submissions -------------------------------------------------------------------------
RULE = """(SELECT 'C' || n_nationkey AS constraint_id, n_name AS name, CASE WHEN n_nationkey % 7 = 6 THEN 'LLM' ELSE 'CODE' END AS check_type,
    CASE n_nationkey % 5 WHEN 0 THEN 'verify_sanity_bounds' WHEN 1 THEN 'verify_locked_layers' WHEN 2 THEN 'verify_layer_names' WHEN 3 THEN 'nope' ELSE 'verify_area_tolerance' END AS check_function,
    CASE WHEN n_nationkey % 2 = 0 THEN 'critical' ELSE 'high' END AS severity, 'cat' || (n_nationkey % 3) AS category, n_nationkey % 6 <> 5 AS enabled,
    CASE n_nationkey % 5 WHEN 0 THEN '{"metric_key":"AF","min_val":1000,"max_val":15100}' WHEN 1 THEN '{"locked_layers":["LOCK","KEY_AREA"]}' WHEN 2 THEN '{"valid_layers":["SITE_BOUNDARY","LAND_USE","LOCK"]}'
    WHEN 3 THEN '{}' ELSE '{"metric_key":"NO","declared_area_sqm":15000,"tolerance_pct":10}' END AS params FROM nation)"""
FEATS = "(SELECT 'S' || (p_partkey % 25) AS submission, p_partkey, CASE WHEN p_size = 4 AND p_partkey % 3 = 0 THEN 'LOCK' WHEN p_size = 6 AND p_partkey % 4 = 0 THEN 'ODD' ELSE 'LAND_USE' END AS layer FROM part)"
OUTCOME = f"""(SELECT s.submission, r.constraint_id, r.severity, r.category, CASE r.k % 5 WHEN 0 THEN CASE WHEN a.value IS NULL THEN 'SKIP' WHEN a.value BETWEEN 1000 AND 15100 THEN 'PASS' ELSE 'FAIL' END
    WHEN 1 THEN CASE WHEN EXISTS (SELECT 1 FROM {FEATS} f WHERE f.submission = s.submission AND layer = 'LOCK') THEN 'FAIL' ELSE 'PASS' END WHEN 2 THEN CASE WHEN EXISTS (SELECT 1 FROM {FEATS} f WHERE f.submission = s.submission AND layer = 'ODD') THEN 'FAIL' ELSE 'PASS' END
    WHEN 3 THEN 'SKIP' ELSE CASE WHEN n.value IS NULL THEN 'FAIL' WHEN abs(n.value - 15000) / 15000 * 100 <= 10 THEN 'PASS' ELSE 'FAIL' END END AS outcome
    FROM (SELECT DISTINCT submission FROM {MET}) s CROSS JOIN (SELECT *, CAST(substr(constraint_id, 2) AS INTEGER) AS k FROM {{rules}} WHERE check_type = 'CODE' AND enabled) r
    LEFT JOIN (SELECT * FROM {MET} WHERE metric = 'AF') a USING (submission) LEFT JOIN (SELECT * FROM {MET} WHERE metric = 'NO') n USING (submission))"""


def rule_tables(t):
    m = metrics(t)
    f = t.sql(f"SELECT * FROM {FEATS}").withColumn("layer_file", F.lit("x.geojson")).withColumn("feature_id", F.col("p_partkey").cast("string"))
    return {"submissions": m.select("submission").distinct(), "metrics": m, "features": f}


def rule_rows(t):
    return t.sql(f"SELECT * FROM {RULE}")


def _outcome(rules):
    return OUTCOME.replace("{rules}", rules)


@query("rule_evaluation", "J1", f"SELECT submission, constraint_id, severity, outcome FROM {_outcome(RULE)}")
def _(t):
    return RU.evaluate(rule_rows(t), rule_tables(t)).select("submission", "constraint_id", "severity", "outcome")


@query("checker_registry", "E1", f"SELECT submission, constraint_id, CASE WHEN CAST(substr(constraint_id, 2) AS INTEGER) % 5 = 0 THEN outcome WHEN CAST(substr(constraint_id, 2) AS INTEGER) % 5 = 4 THEN 'ERROR' ELSE 'SKIP' END AS outcome FROM {_outcome(RULE)}")
def _(t):
    def broken(tables, rules):
        return tables["absent"]
    chosen = {"verify_sanity_bounds": RU.CHECKERS["verify_sanity_bounds"], "verify_area_tolerance": broken}
    return RU.evaluate(rule_rows(t), rule_tables(t), chosen).select("submission", "constraint_id", "outcome")


FAULTY = """SELECT submission, constraint_id, CASE WHEN CAST(substr(constraint_id, 2) AS INTEGER) % 5 = 0 THEN outcome
    WHEN CAST(substr(constraint_id, 2) AS INTEGER) % 5 = 1 THEN 'ERROR' WHEN CAST(substr(constraint_id, 2) AS INTEGER) % 5 = 2 AND submission = 'S7' THEN 'ERROR'
    WHEN CAST(substr(constraint_id, 2) AS INTEGER) % 5 = 2 THEN 'PASS' WHEN constraint_id IN ('C4', 'C9') THEN 'ERROR'
    WHEN CAST(substr(constraint_id, 2) AS INTEGER) % 5 = 4 THEN 'PASS' ELSE 'SKIP' END AS outcome FROM """


@query("failing_checkers", "J1", FAULTY + _outcome(RULE))
def _(t):
    """One checker raises while it is built, one cannot cast a value of one submission, one divides by zero for two rules."""
    def raises(tables, rules):
        raise ValueError("no such mode")

    def passes(tables, rules, fault):
        grid = tables["submissions"].join(F.broadcast(rules.select("constraint_id")))
        return grid.select("submission", "constraint_id", F.when(fault > 0, "PASS").otherwise("FAIL").alias("outcome"),
                           F.lit("").alias("detail"), F.lit("").alias("evidence"))
    number = F.when(F.col("submission") == "S7", "xs").otherwise("1").cast("int")
    zero = F.lit(1) / F.when(F.col("constraint_id").isin("C4", "C9"), 0).otherwise(1)
    chosen = {"verify_sanity_bounds": RU.CHECKERS["verify_sanity_bounds"], "verify_locked_layers": raises,
              "verify_layer_names": lambda tables, rules: passes(tables, rules, number),
              "verify_area_tolerance": lambda tables, rules: passes(tables, rules, zero)}
    return RU.evaluate(rule_rows(t), rule_tables(t), chosen).select("submission", "constraint_id", "outcome")


OVERRIDDEN = f"(SELECT constraint_id, name, check_type, check_function, CASE WHEN constraint_id IN ('C0','C3','C9') THEN 'critical' ELSE severity END AS severity, category, CASE WHEN constraint_id = 'C9' THEN FALSE ELSE enabled END AS enabled, params FROM {RULE})"


@query("runtime_rule_edits", "E2", f"SELECT submission, constraint_id, outcome FROM {_outcome(OVERRIDDEN)} UNION ALL SELECT DISTINCT submission, 'C99', 'SKIP' FROM {MET}")
def _(t):
    rules = RU.set_enabled(rule_rows(t), "C9", False)
    extra = literal_table(t.spark, [("C99", "x", "CODE", "later", "low", "c", True, "{}")],
                          "constraint_id string, name string, check_type string, check_function string, severity string,"
                          " category string, enabled boolean, params string")
    return RU.evaluate(RU.add_rule(rules, extra), rule_tables(t)).select("submission", "constraint_id", "outcome")


REPORT = f"""SELECT submission, count(*) AS total, count(*) FILTER (WHERE outcome = 'PASS') AS passed, count(*) FILTER (WHERE outcome = 'FAIL') AS failed, count(*) FILTER (WHERE outcome = 'FAIL' AND severity = 'critical') AS critical_failures, count(*) FILTER (WHERE outcome = 'SKIP') AS skipped,
    count(*) FILTER (WHERE outcome = 'ERROR') AS errors, count(*) FILTER (WHERE outcome = 'FAIL') = 0 AS all_code_checks_pass, count(*) FILTER (WHERE outcome = 'FAIL' AND severity = 'critical') = 0 AS ready_for_review FROM {_outcome(OVERRIDDEN)} GROUP BY 1"""


@query("rule_run_report", "C2", REPORT)
def _(t):
    ov = literal_table(t.spark, [("C0", "critical", None), ("C3", "critical", None), ("C9", "critical", False)],
                       "constraint_id string, severity string, enabled boolean")
    return RU.run(rule_rows(t), ov, rule_tables(t))[1]


@query("all_failures", "U4", f"SELECT submission, constraint_id FROM {_outcome(RULE)} WHERE outcome IN ('FAIL','ERROR') UNION ALL SELECT s.submission, 'C-SANITY-zz' FROM (SELECT DISTINCT submission FROM {MET}) s UNION ALL SELECT submission, 'C-CLAIM-' || metric FROM {MET} WHERE n % 4 = 0")
def _(t):
    tb = rule_tables(t)
    undeclared = tb["submissions"].withColumn("metric", F.lit("zz"))
    unclaimed = tb["metrics"].filter("n % 4 = 0").select("submission", "metric", F.lit("no_formula").alias("reason"))
    return RU.all_failures(RU.evaluate(rule_rows(t), tb), undeclared, unclaimed).select("submission", "constraint_id")


POLICY_SQL = """SELECT n_name AS policy, unnest(['C-COORD-001', 'C-AREA-s' || n_nationkey, 'C-LAYER-001', 'C-LAYER-003', 'C-TASK-a-' || n_nationkey, 'C-TEXT-BOUNDARY-001', 'C-SANITY-h', 'C-ASSUMPTIONS-001', 'C-SOURCE-001', 'C-ENUM-road_classes', 'C-BOUNDARY-PROV-b' || n_nationkey, 'C-CHARTER-p-1']) AS constraint_id,
    unnest(['verify_crs_used','verify_area_tolerance','verify_required_layers','verify_layer_names','verify_task_coverage','grep_forbidden_patterns','verify_sanity_bounds','verify_missing_controls_documented','verify_source_authority','verify_enum_values','verify_provisional_marking','llm_charter_check']) AS check_function,
    unnest(['critical','high','critical','high','critical','critical','high','high','critical','high','critical','high']) AS severity FROM nation"""


def policy_docs(t):
    k = F.col("n_nationkey")
    fmt = lambda s: F.replace(F.lit(s), F.lit("@"), k.cast("string"))
    docs = {
        "design_brief": '{"official_scope_levels":[{"scope_id":"s@","area_sqm":12.5,"label_zh":"x"},{"scope_id":"t","label_zh":"y"}]}',
        "allowed_design_space": '{"required_submission_layers":["A"],"editable_layers":["B","A"]}',
        "agent_taskbook": '{"required_agent_tasks":[{"requirement_id":"a.@","title_zh":"t"}],"boundary_clause":{"forbidden_final_conclusions_zh":["z"]},"co_creation_charter":[{"principle_id":"p.1"}]}',
        "planning_limits": '{"schema_sanity_bounds_not_planning_approval":{"h":{"min":1,"max":@},"area":{"min":0}},"official_planning_controls":{"far":{"status":"missing"},"ok":{"status":"available"}}}',
        "source_registry": '{"sources":[{"source_id":"P@","usable_for_formal":"provisional_only"},{"source_id":"Q","usable_for_formal":"yes"}]}',
        "road_classes": '{"classes":[{"code":"r@"}]}', "land_use_codes": "not json",
        "provisional_boundaries": '{"features":[{"properties":{"id":"b@","layer":"SITE_BOUNDARY","official_boundary":false}},{"properties":{"id":"c","layer":"KEY_AREA","official_boundary":false}}]}'}
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), fmt(body).alias("text")) for kind, body in docs.items()])
    return t.nation.select(F.col("n_name").alias("policy"), F.inline(rows)).select("policy", "kind", F.try_parse_json("text").alias("doc"))


@query("rule_extraction", "C1", POLICY_SQL)
def _(t):
    return RU.extract_rules(policy_docs(t)).select("policy", "constraint_id", "check_function", "severity")


@query("rule_extractor_union", "U3", f"SELECT check_function, count(*) AS n FROM ({POLICY_SQL}) GROUP BY 1")
def _(t):
    return RU.extract_rules(policy_docs(t)).groupBy("check_function").agg(F.count(F.lit(1)).alias("n"))


# ---- reviews ----------------------------------------------------------------------------------------------

DOC_ID = "CAST(doc_id AS VARCHAR)"
STD = "(SELECT CAST(doc_id AS {s}) AS submission, CASE WHEN doc_id % 2 = 0 THEN 'ST-1' ELSE 'ST-2' END AS standard_id FROM documents)"
MKN = "(SELECT CAST(doc_id AS {s}) AS submission, 'm' || (doc_id % 7) AS metric, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE 'known' END AS status FROM documents)"


@query("professional_review", "C4", f"""SELECT {DOC_ID} AS submission, 'STANDARD_MATRIX_COVERAGE' AS check_id, 'major' AS severity, CASE WHEN doc_id % 2 = 0 THEN 'ST-2' ELSE 'ST-1' END AS detail FROM documents
    UNION ALL SELECT {DOC_ID}, 'DESIGN_DEPTH_COVERAGE', 'major', 'dp' FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT {DOC_ID}, 'STANDARD_PROPOSAL_REF', 'major', 'ST-2' FROM documents WHERE doc_id % 2 = 1
    UNION ALL SELECT {DOC_ID}, 'DEPTH_PROPOSAL_REF', 'major', 'dp' FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT {DOC_ID}, 'METRIC_PROPOSAL_REF', 'major', 'm' || (doc_id % 7) FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> doc_id % 7
    UNION ALL SELECT {DOC_ID}, 'DATA_PROPOSAL_REF', 'major', 'geometry/y.geojson' FROM documents UNION ALL SELECT {DOC_ID}, 'DATA_PROPOSAL_REF', 'major', 'geometry/x.geojson' FROM documents WHERE lang <> 'en'""")
def _(t):
    d = t.documents.select(F.col("doc_id").cast("string").alias("submission"), F.concat("text", F.lit(" [standard:ST-1] [metric:m"), F.col("doc_id") % 5, F.lit("] "), F.when(
        F.col("lang") == "en", "[data:geometry/x.geojson#a]").otherwise("")).alias("text"))
    depth = t.documents.filter("doc_id % 4 = 0").select(F.col("doc_id").cast("string").alias("submission"), F.lit("dp").alias("item_id"))
    return R.professional_review(d, t.sql(f"SELECT * FROM {STD.replace('{s}', 'STRING')}"), depth, t.sql(f"SELECT * FROM {MKN.replace('{s}', 'STRING')}"),
                                 ["ST-1", "ST-2"], ["dp"], ["geometry/x.geojson", "geometry/y.geojson"])


@query("visual_page_review", "C5", """SELECT CAST(page_id AS VARCHAR) AS submission, 'VISUAL_REQUIRED_SECTION_MISSING' AS check_id, 'major' AS severity, 'no such marker' AS detail FROM pages WHERE page_id % 10 <> 0
    UNION ALL SELECT CAST(page_id AS VARCHAR), 'VISUAL_HTML_MISSING', 'blocking', '' FROM pages WHERE page_id % 10 = 0 UNION ALL SELECT CAST(page_id AS VARCHAR), 'VISUAL_REMOTE_OR_ACTIVE_CONTENT', 'blocking', 'embedded frame' FROM pages WHERE page_id % 3 = 0 AND page_id % 10 <> 0
    UNION ALL SELECT CAST(page_id AS VARCHAR), 'VISUAL_METRIC_MISMATCH', 'major', 'a' FROM pages WHERE page_id % 4 = 0 AND page_id % 10 <> 0 UNION ALL SELECT CAST(page_id AS VARCHAR), 'VISUAL_METRIC_MISSING', 'major', 'b' FROM pages WHERE page_id % 10 <> 0""")
def _(t):
    k = F.col("page_id")
    html = F.concat("html", F.when(k % 3 == 0, "<IFRAME src=x>").otherwise(""), F.lit("<p data-metric='a' data-value='"), F.when(k % 4 == 0, "7.5").otherwise("7"), F.lit("'></p>"))
    pages = t.pages.select(k.cast("string").alias("submission"), F.when(k % 10 != 0, html).alias("html"))
    m = t.pages.select(k.cast("string").alias("submission"), F.lit("a").alias("metric"), F.lit("known").alias("status"), F.lit(7.0).alias("value"))
    return R.visual_review(pages, m, ["a", "b"], ["no such marker"])


LONG = "repeat(lang || ' 概念 机制 体系 AI 算法 空间 交通 阶段 政府 指标 公开 隐私 版权 复核 ', 8)"


@query("advisory_score", "C6", f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS submission, doc_id % 4 AS k, length(regexp_replace(text, '{WS}+', '', 'g')) AS n,
    contains(text, source || 'zz') AS s FROM documents), x AS (SELECT submission, k, n, unnest({P.SCORE_DIMENSIONS}) AS dimension, unnest([1,2,3,4,5,6,7,8])::INTEGER AS dim_rank FROM d)
    SELECT submission, dim_rank, dimension, CASE dim_rank WHEN 1 THEN 'needs-work' WHEN 2 THEN CASE WHEN k = 0 THEN 'missing' ELSE 'pass' END WHEN 3 THEN CASE WHEN k = 1 THEN 'missing' ELSE 'pass' END WHEN 4 THEN CASE WHEN k = 2 THEN 'missing' ELSE 'pass' END
    WHEN 5 THEN 'missing' WHEN 6 THEN CASE WHEN k = 3 THEN 'manual-review' ELSE 'pass' END WHEN 7 THEN CASE WHEN k < 3 THEN 'missing' WHEN n + 1000 < 800 THEN 'needs-work' ELSE 'missing' END ELSE CASE WHEN k = 3 THEN 'pass' ELSE 'needs-work' END END AS status FROM x""")
def _(t):
    k = F.col("doc_id") % 4
    body = F.repeat(F.lit("概念 机制 体系 AI 算法 空间 交通 阶段 政府 指标 公开 隐私 版权 复核 "), 8)
    sec = lambda name, skip: F.when(k == skip, "").otherwise(F.concat(F.lit(f"\n## {name}\n"), body))
    text = F.concat(F.lit("---\ntitle: t\n---\n"), sec("核心概念", 0), sec("AI 创新生态", 1), sec("落地路径", 2), F.lit("\n## 风险\n"), body,
                    F.when(k == 3, "涉密 内部资料").otherwise(""), F.lit("\n## 参考资料\n- "), F.when(k == 3, "`brief-one` text").otherwise("unknown work"), F.lit("\n京张\n## own\n"), F.translate("text", "#`", ""))
    src = literal_table(t.spark, [("brief-one", "", "", "")], "id string, citation string, path string, url string")
    return R.advisory_score(t.documents.select(F.col("doc_id").cast("string").alias("submission"), text.alias("text")), src)


VAL = f"""(SELECT submission, 'metrics' AS area, 'METRIC_STATUS' AS check_id, 'error' AS severity, coalesce(status, '') AS detail FROM {MROW} WHERE status IS NULL OR status = 'maybe' UNION ALL SELECT submission, 'metrics', 'UNKNOWN_WITH_VALUE', 'error', '' FROM {MROW} WHERE status = 'unknown' AND value IS NOT NULL
    UNION ALL SELECT submission, 'metrics', 'UNKNOWN_WITHOUT_REASON', 'error', '' FROM {MROW} WHERE status = 'unknown' AND reason = '' UNION ALL SELECT submission, 'metrics', 'KNOWN_WITHOUT_VALUE', 'error', '' FROM {MROW} WHERE status = 'known' AND value IS NULL UNION ALL SELECT submission, 'metrics', 'RATIO_RANGE', 'error', '' FROM {MROW} WHERE unit = 'ratio' AND (value < 0 OR value > 1)
    UNION ALL SELECT submission, 'features', 'NOT_A_FEATURE', 'error', '' FROM {FEAT_SQL} WHERE feature_type = 'Thing' UNION ALL SELECT submission, 'features', 'ID_MISSING', 'error', '' FROM {FEAT_SQL} WHERE feature_id = '' UNION ALL SELECT submission, 'features', 'PROPERTY_MISSING', 'error', 'id' FROM {FEAT_SQL} WHERE id IS NULL
    UNION ALL SELECT submission, 'features', 'PROPERTY_MISSING', 'error', 'layer' FROM {FEAT_SQL} WHERE layer = '' UNION ALL SELECT submission, 'features', 'PROPERTY_MISSING', 'error', 'source_type' FROM {FEAT_SQL} WHERE source_type = ''
    UNION ALL SELECT submission, 'features', 'DUPLICATE_ID', 'error', feature_id FROM (SELECT *, row_number() OVER (PARTITION BY submission, feature_id ORDER BY pos) AS rn FROM {FEAT_SQL} WHERE feature_id <> '') WHERE rn > 1
    UNION ALL SELECT submission, 'features', 'ENUM_CONFIDENCE', 'error', confidence FROM {FEAT_SQL} WHERE confidence = 'unknown')"""


@query("package_validation", "C7", f"SELECT * FROM {VAL}")
def _(t):
    return V.validate({"metrics": t.sql(f"SELECT * FROM {MROW}"), "features": t.sql(f"SELECT * FROM {FEAT_SPARK}")}, feature_enums={"confidence": DIMS["confidence"]})


SELF = f"""(SELECT submission, validation, spatial, visual, professional, validation AND spatial AND visual AND professional AS ok, stage FROM (SELECT c_custkey AS submission, NOT EXISTS (SELECT 1 FROM {ISS} i WHERE i.submission = c_custkey AND gate = 'validation' AND severity <> 'minor') AS validation, NOT EXISTS (SELECT 1 FROM {ISS} i WHERE i.submission = c_custkey AND gate = 'spatial' AND severity <> 'minor') AS spatial,
    NOT EXISTS (SELECT 1 FROM {ISS} i WHERE i.submission = c_custkey AND gate = 'visual' AND severity <> 'minor') AS visual, NOT EXISTS (SELECT 1 FROM {ISS} i WHERE i.submission = c_custkey AND gate = 'professional' AND severity <> 'minor') AS professional, CASE WHEN c_custkey % 5 = 0 THEN 'draft' ELSE 'formal' END AS stage FROM customer))"""


def self_check(t):
    i = t.sql(f"SELECT * FROM {ISS}")
    part = lambda g: i.filter(F.col("gate") == g)
    stages = t.customer.select(F.col("c_custkey").alias("submission"), F.when(F.col("c_custkey") % 5 == 0, "draft").otherwise("formal").alias("stage"))
    return R.self_check(part("validation"), part("spatial"), part("visual"), part("professional"), stages)


@query("self_check_gate", "C8", f"SELECT submission, validation, spatial, visual, professional, ok, stage, ok AND stage = 'formal' AS can_enter_formal_review, CASE WHEN ok AND stage = 'formal' THEN 'formal-review-ready' ELSE 'revision-requested' END AS review_status FROM {SELF}")
def _(t):
    return self_check(t).drop("package_type")


@query("maintainer_summary", "C9", f"SELECT submission, recommendation, ok, can_enter_formal_review, " + ", ".join(f"CASE WHEN {g} THEN 'PASS' ELSE 'FAIL' END AS {g}" for g in ("validation", "spatial", "visual", "professional")) + f" FROM {REC}")
def _(t):
    return R.maintainer_summary(gates(t), t.sql(f"SELECT * FROM {ISS}"))


@query("formal_scorecard", "C10", f"SELECT submission, CASE WHEN can_enter_formal_review AND recommendation = 'formal-review-ready' THEN 'draft' ELSE 'blocked' END AS scoring_status, recommendation, d.n AS dimension_id, d.w::INTEGER AS weight_percent FROM {REC}, (SELECT unnest({list(P.RUBRIC_WEIGHTS)}) AS n, unnest({list(P.RUBRIC_WEIGHTS.values())}) AS w) d")
def _(t):
    return R.formal_scorecard(R.maintainer_summary(gates(t), t.sql(f"SELECT * FROM {ISS}")))


@query("reviewed_score", "C11", f"""WITH w AS (SELECT submission, round(sum(CASE WHEN rn = 1 THEN score / 5.0 * CASE dimension WHEN 'a' THEN 20 WHEN 'b' THEN 30 WHEN 'c' THEN 50 ELSE 0 END ELSE 0 END), 2)::DOUBLE AS weighted_score FROM (SELECT *, row_number() OVER (PARTITION BY submission, dimension ORDER BY pos) AS rn FROM {SC}) GROUP BY 1),
    r AS (SELECT n_nationkey AS submission, CASE WHEN n_nationkey % 8 = 1 THEN 'reject' WHEN n_nationkey % 3 = 2 OR n_nationkey % 6 = 4 THEN 'request-changes' ELSE 'formal-review-ready' END AS recommendation FROM nation)
    SELECT submission, recommendation, recommendation = 'formal-review-ready' AS can_enter_formal_review, coalesce(weighted_score, 0) AS weighted_score, CASE WHEN recommendation <> 'formal-review-ready' THEN 'do-not-publish' WHEN coalesce(weighted_score, 0) >= 85 THEN 'featured-candidate' WHEN coalesce(weighted_score, 0) >= 65 THEN 'publish-qualified' ELSE 'do-not-publish' END AS publication FROM r LEFT JOIN w USING (submission)""")
def _(t):
    k = F.col("n_nationkey")
    rev = t.nation.select(k.alias("submission"), F.lit("formal-review-ready").alias("recommendation"), F.lit(True).alias("can_enter"), F.when(k % 8 == 1, 1).otherwise(0).alias("mandatory_hits"), F.when(k % 6 == 4, 2).otherwise(0).alias("open_actions"))
    gate = t.nation.select(k.alias("submission"), (k % 3 != 2).alias("ok"))
    return R.reviewed_score(t.sql(f"SELECT * FROM {SC}"), rev, gate, {"a": 20, "b": 30, "c": 50})


@query("gallery_table", "C13", """SELECT 'p' || c_custkey AS path, 's' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS title, c_name AS title_en, '2026-01-0' || (1 + c_custkey % 9) AS date, 'formal_review_ready' AS status_key FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 4 <> 1""")
def _(t):
    k = F.col("c_custkey")
    pk = t.customer.select(F.concat(F.lit("p"), k).alias("path"), F.concat(F.lit("s"), k).alias("id"), F.when(k % 2 == 0, "en").otherwise("zh").alias("language"), F.col("c_name").alias("title"),
                           F.col("c_mktsegment").alias("title_zh"), F.lit("").alias("title_en"), F.concat(F.lit("2026-01-0"), 1 + k % 9, F.lit("T10:00")).alias("generated_at"), F.when(k % 4 == 1, "needs_revision").otherwise("formal_review_ready").alias("status_key"))
    pub = t.customer.select(F.concat(F.lit("p"), k).alias("path"), (k % 3 == 0).alias("published"))
    return R.gallery_table(pk, pub)


COMPARED = """SELECT c_custkey AS submission, CASE WHEN c_custkey % 15 = 0 THEN '未提供' WHEN c_custkey % 5 = 0 THEN 'sub' ELSE c_name END AS core_concept,
    n_name || '、x' AS tracks, coalesce(t, '未提供') AS concept_space, CASE WHEN c_custkey % 2 = 0 THEN 'm ' || c_name ELSE '未提供' END AS public_space,
    CASE WHEN c_custkey % 3 = 0 THEN 'w' ELSE c_mktsegment END AS industry_governance,
    CASE WHEN c_custkey % 4 = 0 THEN 'g' WHEN c_custkey % 4 = 1 THEN 's1、s2' WHEN c_custkey % 4 = 2 THEN 'h1；h2' ELSE '未提供' END AS ai_scene,
    '未提供' AS landing_path, coalesce(r, '未提供') AS risk, CASE WHEN c_custkey % 7 = 0 THEN '已覆盖' ELSE '未单独声明' END AS youth, c_mktsegment AS beneficiaries
    FROM customer JOIN nation ON n_nationkey = c_nationkey
    LEFT JOIN (SELECT o_custkey, string_agg('L：o' || o_orderkey || '（P）', '；' ORDER BY rn) FILTER (rn <= 4) AS t FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY 'o' || o_orderkey) AS rn FROM orders) GROUP BY 1) a ON a.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, string_agg('o' || o_orderkey || ' ' || s || '/5', '；' ORDER BY rn) FILTER (rn <= 3) AS r FROM (
      SELECT *, 1 + o_orderkey % 5 AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY 1 + o_orderkey % 5 DESC, 'o' || o_orderkey) AS rn FROM orders)
      GROUP BY 1) b ON b.o_custkey = c_custkey"""


@query("portal_compare", "C14", COMPARED)
def _(t):
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    cards = t.customer.select(
        k.alias("submission"), F.when(k % 5 == 0, "").otherwise(F.col("c_name")).alias("summary"), F.when(k % 3 != 0, "sub").otherwise("").alias("subtitle"),
        F.array(F.concat(F.lit("n"), "c_nationkey"), F.when(k % 7 == 0, "youth-friendly-public-space").otherwise("x")).alias("tracks"),
        F.array("c_mktsegment").alias("tags"), F.when(k % 4 == 1, words("s1", "s2")).otherwise(none).alias("scenarios"),
        F.when(k % 4 == 2, words("h1", "h2")).otherwise(none).alias("highlights"))
    modules = t.customer.select(k.alias("submission"), F.explode(F.array(
        F.struct(F.lit("spatial_strategy").alias("module"), F.when(k % 2 == 0, X.module_rollup(F.lit("m  "), F.lit(""), [])).alias("v")),
        F.struct(F.lit("agent_workflow").alias("module"), F.when(k % 3 == 0, "w").alias("v")),
        F.struct(F.lit("scenario_gallery").alias("module"), F.when(k % 4 == 0, "g").otherwise("").alias("v")))).alias("m"), "c_name").select(
        "submission", "m.module", F.when(F.col("m.module") == "spatial_strategy", F.concat("m.v", F.lit(" "), "c_name")).otherwise(F.col("m.v")).alias("value"))
    dim = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("title")).unionByName(
        literal_table(t.spark, [("youth-friendly-public-space", "x")], "id string, title string"))
    o = F.concat(F.lit("o"), F.col("o_orderkey"))
    risk = t.orders.select(F.col("o_custkey").alias("submission"), o.alias("id"), o.alias("label"), (1 + F.col("o_orderkey") % 5).cast("string").alias("score"))
    con = t.orders.select(F.col("o_custkey").alias("submission"), F.lit("L").alias("type_label"), F.lit("P").alias("place_label"), o.alias("title"), F.lit(1).alias("order"))
    return R.compare_table(cards, dim, risk, con, modules)


@query("packet_metrics", "C15", "SELECT p_brand AS submission, CAST(p_partkey AS VARCHAR) AS metric, 'known' AS status, CASE WHEN p_size % 4 = 0 THEN 'unknown' WHEN p_size % 4 = 1 THEN CAST(p_size AS VARCHAR) || ' m' WHEN p_size % 4 = 2 THEN '1.5e+05 m' ELSE '0.25 m' END AS shown FROM part")
def _(t):
    k = F.col("p_size") % 4
    v = F.when(k == 1, F.col("p_size").cast("double")).when(k == 2, 150000.0).when(k == 3, 0.25)
    return R.packet_metrics(t.part.select(F.col("p_brand").alias("submission"), F.col("p_partkey").cast("string").alias("metric"), F.lit("known").alias("status"), v.alias("value"), F.lit("m").alias("unit")))


@query("packet_risks", "C15", "SELECT c_nationkey AS submission, c_name AS label, (c_custkey % 5)::BIGINT AS score, (c_custkey % 5) || '/5' AS shown, c_mktsegment AS note, '' AS mitigation FROM customer WHERE c_custkey % 11 <> 0")
def _(t):
    k = F.col("c_custkey")
    return R.packet_risks(t.customer.select(F.col("c_nationkey").alias("submission"), F.col("c_name").alias("label"), F.when(k % 11 != 0, k % 5).alias("score"), F.concat(F.lit(" "), "c_mktsegment").alias("note"), F.lit("").alias("mitigation")))


@query("packet_checks", "C15", "SELECT c_nationkey AS submission, 'k' || c_custkey AS check_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'pass' END AS result, 'major' AS severity, c_name AS target, '' AS message FROM customer")
def _(t):
    k = F.col("c_custkey")
    return R.packet_checks(t.customer.select(F.col("c_nationkey").alias("submission"), F.concat(F.lit("k"), k).alias("check_id"), F.when(k % 3 != 0, "pass").alias("result"),
                                             F.lit("major").alias("severity"), F.col("c_name").alias("target"), F.lit(None).cast("string").alias("message")))


@query("packet_blockers", "C15", "SELECT c_custkey AS submission, unnest(CASE WHEN c_custkey % 2 = 0 THEN [0, 2] ELSE [2] END)::INTEGER AS pos, unnest(CASE WHEN c_custkey % 2 = 0 THEN [c_name, 'open'] ELSE ['open'] END) AS blocker FROM customer WHERE c_custkey % 5 <> 0")
def _(t):
    k = F.col("c_custkey")
    listed = F.when(k % 5 != 0, F.array(F.when(k % 2 == 0, F.col("c_name")).otherwise(" "), F.lit(None).cast("string"), F.lit("open")))
    return R.packet_blockers(t.customer.select(k.alias("submission"), listed.alias("known_blockers")))


@query("packet_assumptions", "C15", "SELECT s_nationkey AS submission, 'A' || s_suppkey AS id, 'open' AS status, s_name AS statement, '' AS impact FROM supplier")
def _(t):
    return R.packet_assumptions(t.supplier.select(F.col("s_nationkey").alias("submission"), F.concat(F.lit("A"), "s_suppkey").alias("id"), F.lit("open").alias("status"),
                                                  F.col("s_name").alias("statement"), F.lit(None).cast("string").alias("impact")))


@query("packet_sources", "C15", "SELECT lang AS submission, doc_id AS id, source AS source_type, CASE WHEN doc_id % 3 = 0 THEN 'p/' || doc_id WHEN doc_id % 3 = 1 THEN 'http://u/' || doc_id ELSE '' END AS place, '' AS usage FROM documents")
def _(t):
    k = F.col("doc_id")
    return R.packet_sources(t.documents.select(F.col("lang").alias("submission"), k.alias("id"), F.col("source").alias("source_type"), F.when(k % 3 == 0, F.concat(F.lit("p/"), k)).alias("path"),
                                               F.when(k % 3 == 1, F.concat(F.lit("http://u/"), k)).alias("url"), F.lit("").alias("usage")))


@query("packet_files", "C15", "SELECT p_brand AS submission, p_name AS label, CASE WHEN p_size % 4 = 0 THEN '缺失' ELSE '有' END AS state, 'f' || p_partkey AS path FROM part")
def _(t):
    return R.packet_files(t.part.select(F.col("p_brand").alias("submission"), F.col("p_name").alias("label"), (F.col("p_size") % 4 != 0).alias("exists"), F.concat(F.lit("f"), "p_partkey").alias("path")))


@query("packet_index", "S15", "SELECT 'p' || c_custkey AS path, c_name AS title, c_mktsegment AS author, 'ready' AS status, CASE c_custkey % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' ELSE '未声明' END AS readiness FROM customer")
def _(t):
    k = F.col("c_custkey")
    return R.packet_rows(t.customer.select(F.concat(F.lit("p"), k).alias("path"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("author"), F.lit("ready").alias("status"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("readiness")))


@query("snapshot_upsert", "C25", """SELECT id, CASE WHEN o IS NULL OR (c IS NOT NULL AND o % 3 = 0 AND c % 2 = 0) THEN CASE WHEN c % 2 = 0 THEN 'user_provided_summary' ELSE 'fetched' END ELSE 'new' END AS fetch_status, CASE WHEN o IS NULL OR (c IS NOT NULL AND o % 3 = 0 AND c % 2 = 0) THEN 'old' || c ELSE 'new' || o END AS content
    FROM (SELECT coalesce(a.id, b.id) AS id, a.c, b.o FROM (SELECT c_custkey AS id, c_custkey AS c FROM customer WHERE c_custkey % 4 <> 0) a FULL JOIN (SELECT c_custkey AS id, c_custkey AS o FROM customer WHERE c_custkey % 5 <> 0) b USING (id))""")
def _(t):
    k = F.col("c_custkey")
    cur = t.customer.filter("c_custkey % 4 <> 0").select(k.alias("id"), F.when(k % 2 == 0, "user_provided_summary").otherwise("fetched").alias("fetch_status"), F.concat(F.lit("old"), k).alias("content"))
    new = t.customer.filter("c_custkey % 5 <> 0").select(k.alias("id"), F.lit("new").alias("fetch_status"), F.concat(F.lit("new"), k).alias("content"), (k % 3 != 0).alias("ok"))
    return R.snapshot_upsert(cur, new)


# ---- resume, increments, history ---------------------------------------------------------------------------

@query("resume_rows", "T1", "SELECT o_orderkey AS source_row, CASE WHEN o_orderkey % 3 = 0 THEN 'stored' || o_custkey ELSE 'fresh' || o_custkey END AS result, o_orderkey % 3 = 0 AS resumed FROM orders")
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("source_row"), "o_custkey")
    done = t.orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("source_row"), F.concat(F.lit("stored"), "o_custkey").alias("result"))
    return H.resumed(rows, done, lambda d: d.withColumn("result", F.concat(F.lit("fresh"), "o_custkey"))).select("source_row", "result", "resumed")


@query("touched_packages", "T2", "SELECT 'submissions/u' || c_custkey || '/p/proposal.md' AS proposal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(t):
    path = lambda c, tail: F.concat(F.lit("submissions/u"), F.col(c), F.lit("/p/" + tail))
    return H.touched_packages(t.customer.select(path("c_custkey", "proposal.md").alias("proposal")),
                              t.orders.filter("o_orderpriority = '1-URGENT'").select(path("o_custkey", "a/b.json").alias("path")))


@query("run_history", "T3", f"""SELECT run_key, seq, CASE WHEN b IS NULL OR failures < b THEN 'promote' WHEN failures > b THEN 'rollback' ELSE 'keep' END AS action, coalesce(fingerprint = p, FALSE) AS stalled FROM (SELECT *, min(failures) OVER (PARTITION BY run_key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
    lag(fingerprint) OVER (PARTITION BY run_key ORDER BY ts, seq) AS p FROM {B.RUNS})""")
def _(t):
    from ..operators.sequences import ratchet, stall_n
    r = B.runs(t)
    a = ratchet(r).select("run_key", "seq", "action")
    s = stall_n(r.withColumn("phase", F.lit("loop")), 2).select("run_key", "seq", "stalled")
    return a.join(s, ["run_key", "seq"])


# ---- sinks ----------------------------------------------------------------------------------------------------

@query("csv_sink_rows", "S11", "SELECT CAST(c_custkey AS VARCHAR) AS a, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS b, '' AS c FROM customer")
def _(t):
    return W.csv_frame(t.customer.select(F.col("c_custkey").alias("a"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("b")), ["a", "b", "c"])


@query("geojson_point_rows", "S12", """SELECT '{"type":"Feature","properties":{"category":"' || o_orderpriority || '","name":"n' || o_orderkey || '"},"geometry":{"type":"Point","coordinates":[116.5,' || (o_orderkey % 90) || '.5]}}' AS value FROM orders""")
def _(t):
    p = t.orders.select(F.col("o_orderpriority").alias("category"), F.concat(F.lit("n"), "o_orderkey").alias("name"), F.lit(116.5).alias("lon"), (F.col("o_orderkey") % 90 + 0.5).alias("lat"))
    return W.point_features(p)


@query("summary_document", "S13", """SELECT '{"runs":2,"counts":{"priority":{' || string_agg('"' || o_orderpriority || '":' || n, ',' ORDER BY o_orderpriority) || '}}}' AS value FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""")
def _(t):
    c = t.orders.groupBy(F.col("o_orderpriority").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("priority"))
    return W.summary_document(c, runs=2)


@query("registry_document", "S14", """SELECT '{"schema_version":"0.1.0","updated_date":"2026-01-01","sources":[' || string_agg('{"source_id":"S' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '","title":"' || s_name || '"}', ',' ORDER BY s_suppkey) || ']}' AS value FROM supplier""")
def _(t):
    return W.registry_document(t.supplier.select(F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("source_id"), F.col("s_name").alias("title")), "2026-01-01")


@query("publication_rows", "S18", """SELECT role, rank::INTEGER AS rank, source_id FROM (SELECT CASE c_custkey % 2 WHEN 0 THEN 'background' ELSE 'provisional' END AS role, 'S' || c_custkey AS source_id, row_number() OVER (PARTITION BY c_custkey % 2 ORDER BY c_custkey) AS rank FROM customer) WHERE rank <= 20""")
def _(t):
    from ..plans.discovery import registry_counts, registry_roles
    k = F.col("c_custkey")
    reg = t.customer.select(k.alias("pos"), F.concat(F.lit("S"), k).alias("source_id"), F.col("c_name").alias("title"), F.lit("x").alias("review_status"), F.when(k % 2 == 0, "background_only").otherwise("provisional_only").alias("usable_for_formal"), F.lit("A0").alias("authority_level"))
    doc = W.publication_document(registry_counts(reg), registry_roles(reg, 20), "2026-01-01")
    roles = F.from_json(F.get_json_object("value", "$.roles"), "map<string,array<struct<rank:int,source_id:string>>>")
    return doc.select(F.explode(roles).alias("role", "rows")).select("role", F.inline("rows"))
