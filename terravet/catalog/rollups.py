"""Queries of aggregates, top-k and review roll-ups."""

from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import aggregates as A
from ..operators import joins as J
from . import bindings as B
from .checks import PUB, PUB_SQL, RISK
from .registry import query
from .spatial import rects, sql_union

RES = """(SELECT 'S' || user_id AS submission, 'C' || (event_id % 40) AS rule_id, CASE event_id % 5 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'SKIP' WHEN 2 THEN 'ERROR' ELSE 'PASS' END AS outcome,
    CASE WHEN value > 10 THEN 'critical' WHEN value > 3 THEN 'high' ELSE 'medium' END AS severity, event_type AS category FROM events)"""


@query("rule_report", "G1", f"""SELECT submission, count(*) AS total, count(*) FILTER (WHERE outcome = 'PASS') AS passed, count(*) FILTER (WHERE outcome = 'FAIL') AS failed, count(*) FILTER (WHERE outcome = 'FAIL' AND severity = 'critical') AS critical_failures,
    count(*) FILTER (WHERE outcome = 'SKIP') AS skipped, count(*) FILTER (WHERE outcome = 'ERROR') AS errors, count(*) FILTER (WHERE outcome = 'FAIL') = 0 AS all_code_checks_pass, count(*) FILTER (WHERE outcome = 'FAIL' AND severity = 'critical') = 0 AS ready_for_review FROM {RES} GROUP BY 1""")
def _(t):
    return A.rule_report(t.sql(f"SELECT * FROM {RES}"))


@query("failures_by_kind", "G1", f"SELECT submission, 'category' AS kind, category AS value, count(*) AS n FROM {RES} WHERE outcome = 'FAIL' GROUP BY ALL UNION ALL SELECT submission, 'severity', severity, count(*) FROM {RES} WHERE outcome = 'FAIL' GROUP BY ALL")
def _(t):
    return A.failures_by(t.sql(f"SELECT * FROM {RES}"))


REG = """(SELECT c_custkey AS pos, c_name AS title, CASE c_custkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'needs_review' ELSE NULL END AS review_status, CASE c_nationkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'background_only' WHEN 2 THEN 'provisional_only' ELSE 'no' END AS usable_for_formal, 'A' || (c_custkey % 4) AS authority_level FROM customer)"""
ROLE = "CASE WHEN review_status = 'approved' AND usable_for_formal = 'yes' THEN 'approved_formal' WHEN usable_for_formal = 'provisional_only' THEN 'provisional' WHEN usable_for_formal = 'background_only' THEN 'background' WHEN review_status = 'needs_review' THEN 'needs_review' END"


@query("registry_counts", "G2", f"SELECT 'total' AS kind, '' AS value, count(*) AS n FROM {REG} UNION ALL SELECT 'review_status', coalesce(review_status, 'unknown'), count(*) FROM {REG} GROUP BY 2 UNION ALL SELECT 'usable_for_formal', usable_for_formal, count(*) FROM {REG} GROUP BY 2 UNION ALL SELECT 'authority_level', authority_level, count(*) FROM {REG} GROUP BY 2")
def _(t):
    from ..plans.discovery import registry_counts
    return registry_counts(t.sql(f"SELECT * FROM {REG}"))


@query("registry_roles", "G2", f"SELECT pos, title, role, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY pos) AS rank FROM (SELECT *, {ROLE} AS role FROM {REG}) WHERE role IS NOT NULL) WHERE rank <= 8")
def _(t):
    from ..plans.discovery import registry_roles
    return registry_roles(t.sql(f"SELECT * FROM {REG}")).select("pos", "title", "role", "rank")


LAYERED = f"(SELECT submission, x0, y0, x1, y1, CASE layer WHEN 'ECONOMY' THEN 'GREEN_SPACE' WHEN 'STANDARD' THEN 'PUBLIC_SPACE' WHEN 'PROMO' THEN 'BUILDING_FOOTPRINT' ELSE 'OTHER' END AS layer FROM {B.FEATURES} UNION ALL SELECT DISTINCT submission, 0::DOUBLE, 0::DOUBLE, 400::DOUBLE, 500::DOUBLE, 'SITE_BOUNDARY' FROM {B.FEATURES})"


def layered(t):
    r = rects(t).select("submission", F.when(F.col("layer") == "ECONOMY", "GREEN_SPACE").when(F.col("layer") == "STANDARD", "PUBLIC_SPACE").when(
        F.col("layer") == "PROMO", "BUILDING_FOOTPRINT").otherwise("OTHER").alias("layer"), "rings")
    z, w, h = F.lit(0.0), F.lit(400.0), F.lit(500.0)
    return r.unionByName(r.select("submission").distinct().select("submission", F.lit("SITE_BOUNDARY").alias("layer"), B.box_rings(z, z, w, h).alias("rings")))


LAYER_AREA = sql_union(LAYERED, "submission, layer")
SITE_METRICS = f"""(SELECT submission, round(sum(CASE WHEN layer = 'SITE_BOUNDARY' THEN area ELSE 0 END), 3) AS site_area_sqm, round(sum(CASE WHEN layer = 'GREEN_SPACE' THEN area ELSE 0 END), 3) AS green_space_area_sqm, round(sum(CASE WHEN layer = 'PUBLIC_SPACE' THEN area ELSE 0 END), 3) AS public_space_area_sqm,
    round(sum(CASE WHEN layer = 'BUILDING_FOOTPRINT' THEN area ELSE 0 END), 3) AS building_footprint_area_sqm, round(sum(CASE WHEN layer = 'GREEN_SPACE' THEN area ELSE 0 END) / 200000, 6) AS green_ratio, round(sum(CASE WHEN layer = 'PUBLIC_SPACE' THEN area ELSE 0 END) / 200000, 6) AS public_space_ratio FROM {LAYER_AREA} GROUP BY 1)"""


@query("site_metrics", "G6", f"SELECT * FROM {SITE_METRICS}")
def _(t):
    return A.site_metrics(layered(t))


@query("kpi_metrics", "G25", f"""SELECT submission, metric, CASE WHEN value IS NULL THEN 'unknown' ELSE 'known' END AS status, value FROM (SELECT submission, unnest(['site_area_sqm','building_footprint_area_sqm','green_ratio','public_space_ratio','floor_area_ratio','key_area_count']) AS metric,
    unnest([site_area_sqm, building_footprint_area_sqm, green_ratio, public_space_ratio, NULL, 0.0::DOUBLE]) AS value FROM {SITE_METRICS})""")
def _(t):
    return A.kpi_metrics(layered(t)).select("submission", "metric", "status", "value")


GREEN = f"(SELECT submission, sum(CASE WHEN layer = 'ECONOMY' THEN (x1-x0)*(y1-y0) END) AS g, sum(CASE WHEN layer = 'STANDARD' THEN (x1-x0)*(y1-y0) END) AS s FROM {B.FEATURES} GROUP BY 1)"


@query("green_ratio_rule", "G7", f"SELECT submission, round(CASE WHEN s > 0 THEN g / s END, 9) AS ratio, CASE WHEN g IS NULL OR s IS NULL THEN 'SKIP' WHEN s <= 0 THEN 'FAIL' WHEN g / s BETWEEN 0.05 AND 0.8 THEN 'PASS' ELSE 'FAIL' END AS outcome FROM {GREEN}")
def _(t):
    f = rects(t).select("submission", F.when(F.col("layer") == "ECONOMY", "GREEN_SPACE").when(F.col("layer") == "STANDARD", "SITE_BOUNDARY").alias("layer"), F.array("rings").alias("polys"))
    return A.check_green_ratio(f).withColumn("ratio", F.round("ratio", 9))


W = {"a": 20, "b": 30, "c": 50}
SC = "(SELECT c_nationkey AS submission, c_custkey AS pos, CASE c_custkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'zz' END AS dimension, c_custkey % 6 AS score FROM customer WHERE c_nationkey % 5 <> 0 OR c_custkey % 4 <> 2)"


@query("weighted_score", "G8", f"""SELECT submission, round(sum(CASE WHEN rn = 1 THEN score / 5.0 * CASE dimension WHEN 'a' THEN 20 WHEN 'b' THEN 30 WHEN 'c' THEN 50 ELSE 0 END ELSE 0 END), 2)::DOUBLE AS weighted_score,
    array_to_string(list_sort(list_filter(['a','b','c'], lambda d: NOT list_contains(list(dimension), d))), ', ') AS missing, count(*) FILTER (WHERE rn > 1 AND dimension <> 'zz') AS duplicate_rows, count(*) FILTER (WHERE dimension = 'zz') AS unknown_rows
    FROM (SELECT *, row_number() OVER (PARTITION BY submission, dimension ORDER BY pos) AS rn FROM {SC}) GROUP BY submission""")
def _(t):
    return A.weighted_score(t.sql(f"SELECT * FROM {SC}"), W)


PAN = "(SELECT o_custkey AS submission, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 3 = 0 END AS refuted, o_orderkey % 11 = 0 AS blocking FROM orders)"
PANEL_SQL = f"SELECT submission, count(*) AS judges, count(*) FILTER (WHERE coalesce(refuted, TRUE)) AS n_refuted, count(*) FILTER (WHERE coalesce(refuted, TRUE) AND blocking) AS n_blocking, count(*) FILTER (WHERE coalesce(refuted, TRUE)) <= 2 AND count(*) FILTER (WHERE coalesce(refuted, TRUE) AND blocking) = 0 AS approved FROM {PAN} GROUP BY 1"


DECIDED = f"""SELECT *, CASE WHEN approved THEN 'APPROVED' ELSE 'NEED_WORK' END AS decision, CASE WHEN n_blocking > 0 THEN 'blocking'
    WHEN n_refuted > 2 THEN 'major_fixes' WHEN n_refuted > 0 THEN 'minor_fixes' ELSE 'approved' END AS route FROM ({PANEL_SQL})"""


@query("panel_decision", "G9", DECIDED)
def _(t):
    return A.panel(t.sql(f"SELECT * FROM {PAN}"))


@query("panel_verdicts", "C12", f"SELECT submission, approved, (judges - n_refuted) || '/' || judges || ' not refuted, ' || n_blocking || ' blocking: ' || decision AS summary, route FROM ({DECIDED})")
def _(t):
    from ..plans.reviews import panel_verdicts
    return panel_verdicts(t.sql(f"SELECT * FROM {PAN}")).select("submission", "approved", "summary", "route")


@query("risk_summary", "G10", f"""WITH r AS (SELECT submission, label, score::INTEGER AS s, row_number() OVER (PARTITION BY submission ORDER BY score::INTEGER DESC, label, pos) AS rn FROM (SELECT submission, pos, id || pos AS label, score FROM {RISK} WHERE regexp_matches(score, '^[1-5]$')))
    SELECT submission, max(s) AS max_score, count(*) FILTER (WHERE s >= 4) AS high_count, string_agg(CASE WHEN rn <= 3 THEN label || ' ' || s || '/5' END, '；' ORDER BY rn) AS top FROM r GROUP BY 1""")
def _(t):
    return A.risk_summary(t.sql(f"SELECT submission, pos, id, id || pos AS label, score FROM {RISK}"))


CI = "(SELECT c_nationkey AS submission, CASE c_custkey % 4 WHEN 0 THEN 'node' WHEN 1 THEN 'corridor' WHEN 2 THEN 'area' ELSE 'odd' END AS type, c_name AS title, CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 100 AS INTEGER) ELSE NULL END AS {o} FROM customer)"


@query("concept_summary", "G11", f"""SELECT submission, count(*) FILTER (WHERE type = 'node') AS n_node, count(*) FILTER (WHERE type = 'corridor') AS n_corridor, count(*) FILTER (WHERE type = 'area') AS n_area, string_agg(CASE WHEN rn <= 6 THEN title END, '|' ORDER BY rn) AS first_titles
    FROM (SELECT *, row_number() OVER (PARTITION BY submission ORDER BY coalesce(ord, 99), title) AS rn FROM {CI.replace('{o}', 'ord')}) GROUP BY 1""")
def _(t):
    return A.concept_summary(t.sql(f"SELECT * FROM {CI.replace('{o}', 'ord')}").withColumnRenamed("ord", "order"))


@query("layer_statistics", "G12", """SELECT b AS submission, f AS layer_file, CASE WHEN s THEN coalesce(n, 0) ELSE -1 END AS n FROM (SELECT DISTINCT p_brand AS b, p_type AS f, p_type <> 'PROMO' AS s FROM part) LEFT JOIN (SELECT p_brand AS b, p_type AS f, count(*) AS n FROM part WHERE p_size > 25 GROUP BY ALL) USING (b, f)""")
def _(t):
    p = t.part.select(F.col("p_brand").alias("submission"), F.col("p_type").alias("layer_file"), "p_size")
    return A.layer_stats(p.select("submission", "layer_file", (F.col("layer_file") != "PROMO").alias("readable")).distinct(), p.filter("p_size > 25"))


RROWS = "(SELECT l_orderkey AS doc, l_linenumber AS line, l_extendedprice AS land, l_quantity * 100 AS floor FROM lineitem)"


@query("reconcile_rows", "G13", f"""WITH s AS (SELECT doc, sum(land) AS sl, sum(floor) AS sf FROM {RROWS} GROUP BY 1), o AS (SELECT o_orderkey AS doc, o_totalprice AS tl FROM orders WHERE o_orderkey % 4 <> 0),
    g AS (SELECT s.doc, CASE WHEN tl IS NULL THEN 'no_total' WHEN abs(sl - CASE WHEN s.doc % 3 = 0 THEN sl * 1.005 ELSE tl END) / CASE WHEN s.doc % 3 = 0 THEN sl * 1.005 ELSE tl END <= 0.01 THEN 'matched' ELSE 'dropped' END AS note FROM s LEFT JOIN o USING (doc))
    SELECT r.doc, line, land, note, count(*) AS n FROM {RROWS} r JOIN g USING (doc) WHERE note <> 'dropped' GROUP BY ALL""")
def _(t):
    rows = t.sql(f"SELECT * FROM {RROWS}")
    sums = rows.groupBy("doc").agg(F.sum("land").alias("sl"), F.sum("floor").alias("sf"))
    tot = t.orders.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("doc"), "o_totalprice").join(sums, "doc").select(
        "doc", F.when(F.col("doc") % 3 == 0, F.col("sl") * 1.005).otherwise(F.col("o_totalprice")).alias("total_land"), F.col("sf").alias("total_floor"))
    return A.reconcile(rows, tot, "doc").groupBy("doc", "line", "land", "note").agg(F.count(F.lit(1)).alias("n"))


DST = "(SELECT 'S' || user_id AS submission, CASE event_id % 9 WHEN 0 THEN 'missing' WHEN 1 THEN 'needs-work' WHEN 2 THEN 'manual-review' ELSE 'pass' END AS status FROM events)"


@query("scorecard_summary", "G14", f"SELECT submission, count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'needs-work') AS n_needs_work, count(*) FILTER (WHERE status = 'missing') AS n_missing, count(*) FILTER (WHERE status = 'manual-review') AS n_manual_review, count(*) FILTER (WHERE status = 'missing') = 0 AS ready FROM {DST} GROUP BY 1")
def _(t):
    return A.scorecard_summary(t.sql(f"SELECT * FROM {DST}"))


@query("part_sum_equals_whole", "G15", """SELECT o_custkey AS scope, sum(q) AS part_sum, max(q) AS total, sum(q) = max(q) AS equal FROM (SELECT o_custkey, (o_orderkey % 9)::DOUBLE AS q FROM orders) GROUP BY 1""")
def _(t):
    p = t.orders.select(F.col("o_custkey").alias("scope"), (F.col("o_orderkey") % 9).cast("double").alias("area_sqm"))
    return A.check_part_sum(p, p.groupBy("scope").agg(F.max("area_sqm").alias("total")), "scope")


@query("area_share_by_code", "G16", f"SELECT submission, size AS land_use_code, area, round(area / sum(area) OVER (PARTITION BY submission), 9) AS share FROM (SELECT submission, size, sum((x1-x0)*(y1-y0)) AS area FROM {B.FEATURES} GROUP BY ALL)")
def _(t):
    f = rects(t).select("submission", F.col("size").alias("land_use_code"), G.area_m2(F.array("rings")).alias("area"))
    return A.area_by_code(f).withColumn("share", F.round("share", 9))


@query("package_fingerprint", "G17", """SELECT g AS submission, sha256(string_agg('d' || doc_id || chr(0) || octet_length(encode(text)) || chr(0) || text || chr(0), '' ORDER BY 'd' || doc_id)) AS sha256 FROM (SELECT doc_id, text, source || (doc_id // 20) AS g FROM documents) GROUP BY 1""")
def _(t):
    f = t.documents.select(F.concat("source", F.floor(F.col("doc_id") / 20)).alias("submission"), F.concat(F.lit("d"), "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return A.package_sha(f)


@query("declared_metric_keys", "G19", "SELECT DISTINCT p_brand AS submission, p_name AS metric FROM part")
def _(t):
    return A.declared_keys(t.part.select(F.col("p_brand").alias("submission"), F.col("p_name").alias("metric")))


CREF = "(SELECT c_nationkey AS submission, CASE c_custkey % 5 WHEN 0 THEN 'source' WHEN 1 THEN 'standard' WHEN 2 THEN 'depth' WHEN 3 THEN 'data' ELSE 'metric' END AS kind, c_mktsegment || (c_custkey % 3) AS value FROM customer)"


@query("citation_counts", "G20", "SELECT submission, " + ", ".join(f"count(DISTINCT CASE WHEN kind = '{k}' THEN value END) AS {k}" for k in ("source", "standard", "depth", "data", "metric")) + f" FROM {CREF} GROUP BY 1")
def _(t):
    return A.citation_counts(t.sql(f"SELECT * FROM {CREF}"))


GATES = "(SELECT o_custkey AS submission, CASE o_orderkey % 4 WHEN 0 THEN 'validation' WHEN 1 THEN 'spatial' WHEN 2 THEN 'visual' ELSE 'professional' END AS gate, o_orderkey % 13 <> 0 AS ok FROM orders)"
STAGES = "(SELECT c_custkey AS submission, CASE WHEN c_custkey % 5 = 0 THEN 'draft' ELSE 'formal' END AS stage FROM customer WHERE c_custkey % 7 <> 0)"
GATE_SQL = f"""(SELECT submission, validation, spatial, visual, professional, ok, coalesce(stage, 'unknown') AS stage, ok AND coalesce(stage = 'formal', FALSE) AS can_enter_formal_review, CASE WHEN stage = 'formal' THEN 'professional_design_package' ELSE 'unknown' END AS package_type,
    CASE WHEN ok AND stage = 'formal' THEN 'formal-review-ready' ELSE 'revision-requested' END AS review_status FROM (SELECT *, validation AND spatial AND visual AND professional AS ok FROM (SELECT submission, {', '.join(f"coalesce(bool_and(ok) FILTER (WHERE gate = '{g}'), FALSE) AS {g}" for g in ('validation', 'spatial', 'visual', 'professional'))} FROM {GATES} GROUP BY 1)) LEFT JOIN {STAGES} USING (submission))"""


def gates(t):
    return A.gate(t.sql(f"SELECT * FROM {GATES}"), t.sql(f"SELECT * FROM {STAGES}"))


@query("gate_conjunction", "G21", f"SELECT * FROM {GATE_SQL}")
def _(t):
    return gates(t)


ISS = "(SELECT o_custkey AS submission, o_orderkey AS pos, CASE o_orderkey % 4 WHEN 0 THEN 'validation' WHEN 1 THEN 'spatial' WHEN 2 THEN 'visual' ELSE 'professional' END AS gate, 'K' || (o_orderkey % 9) AS check_id, CASE o_orderkey % 3 WHEN 0 THEN 'minor' WHEN 1 THEN 'major' ELSE 'blocking' END AS severity, CASE WHEN o_orderkey % 31 = 0 THEN '疑似手机号' ELSE 'm' || o_orderkey END AS message FROM orders)"
ACTIONS = f"""SELECT submission, (CASE gate WHEN 'validation' THEN 1 WHEN 'spatial' THEN 2 WHEN 'visual' THEN 3 ELSE 4 END)::INTEGER AS gate_rank, pos, CASE WHEN gate = 'validation' THEN 'Fix deterministic validation error: ' || message ELSE 'Repair ' || CASE WHEN gate = 'professional' THEN 'professional evidence' ELSE gate END || ' issue ' || check_id || ': ' || message END AS action FROM {ISS} WHERE severity <> 'minor'"""


@query("next_actions", "G22", ACTIONS)
def _(t):
    return A.next_actions(t.sql(f"SELECT * FROM {ISS}"))


REC = f"""(SELECT g.*, CASE WHEN coalesce(h, FALSE) THEN 'reject' WHEN NOT ok THEN 'request-changes' ELSE 'formal-review-ready' END AS recommendation FROM {GATE_SQL} g LEFT JOIN (SELECT submission, bool_or(contains(message, '手机号')) AS h FROM {ISS} GROUP BY 1) USING (submission))"""


@query("recommendation", "G23", f"SELECT submission, recommendation FROM {REC}")
def _(t):
    return A.recommendation(gates(t), t.sql(f"SELECT * FROM {ISS}")).select("submission", "recommendation")


@query("evidence_violations", "G24", "SELECT c_custkey AS parcel, 'r1' AS rule_id, 'violation' AS outcome FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'r3', 'violation' FROM customer WHERE c_custkey % 3 <> 0")
def _(t):
    e = lambda r, bad: F.struct(F.lit(r).alias("rule_id"), F.when(bad, "violation").otherwise("compliant").alias("outcome"))
    k = F.col("c_custkey")
    runs = t.customer.select(k.alias("parcel"), F.array(e("r1", k % 2 == 0), e("r2", F.lit(False))).alias("lines"), F.when(k % 3 != 0, F.array(e("r3", F.lit(True)))).alias("zones"))
    return A.violations(runs, ["parcel"])


@query("point_library_profile", "G26", f"""SELECT tag, count(*) AS n, count(h) AS with_height, median(a) AS median_area, sum(a) AS total_area FROM (SELECT layer AS tag, CASE WHEN size % 4 = 0 THEN size END AS h, (x1-x0)*(y1-y0) AS a FROM {B.FEATURES}) GROUP BY ROLLUP (tag)""")
def _(t):
    f = rects(t).select(F.col("layer").alias("tag"), F.when(F.col("size") % 4 == 0, F.col("size")).alias("height"), G.area_m2(F.array("rings")).alias("area"))
    return A.osm_profile(f)


GF = "(SELECT c_nationkey AS submission, CASE c_custkey % 3 WHEN 0 THEN 'site_boundary.geojson' WHEN 1 THEN 'key_areas.geojson' ELSE 'x.geojson' END AS layer_file, CASE WHEN c_nationkey % 3 = 0 AND c_custkey % 11 = 0 THEN FALSE ELSE TRUE END AS official_boundary, 'official_constraint' AS geometry_role FROM customer)"


@query("geometry_flags", "G29", f"SELECT submission, bool_or(NOT official_boundary) AS has_provisional, bool_and(official_boundary) AND count(*) FILTER (WHERE layer_file LIKE 'site%') > 0 AND count(*) FILTER (WHERE layer_file LIKE 'key%') >= 3 AS has_official FROM {GF} WHERE layer_file <> 'x.geojson' GROUP BY 1")
def _(t):
    return A.geometry_flags(t.sql(f"SELECT * FROM {GF}"))


BR = "(SELECT user_id AS submission, event_id AS pos, CASE WHEN event_id % 2 = 0 THEN 'BOUNDARY_TRUST' ELSE 'KEY_AREAS_TRUST' END AS check_id, CASE WHEN event_id % 3 = 0 THEN 'major' ELSE 'info' END AS severity FROM events)"


@query("boundary_ready", "G30", f"SELECT submission, bool_and(s = 'info') AS boundary_ready FROM (SELECT submission, check_id, arg_max(severity, pos) AS s FROM {BR} GROUP BY ALL) GROUP BY 1")
def _(t):
    return A.boundary_ready(t.sql(f"SELECT * FROM {BR}"))


@query("full_span_rectangles", "P55", """WITH f AS (SELECT p_brand AS s, p_partkey, CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_size END::DOUBLE AS x0, CASE WHEN p_size % 10 = 0 THEN 100 ELSE p_size + 5 END::DOUBLE AS x1 FROM part), b AS (SELECT s, min(x0) AS a, max(x1) AS b FROM f GROUP BY 1)
    SELECT s AS submission, count(*) FILTER (WHERE x1 - x0 >= 0.99 * (b.b - b.a)) AS full_span FROM f JOIN b USING (s) GROUP BY 1""")
def _(t):
    wide = F.col("p_size") % 10 == 0
    x0, x1 = F.when(wide, 0.0).otherwise(F.col("p_size").cast("double")), F.when(wide, 100.0).otherwise((F.col("p_size") + 5).cast("double"))
    y = F.col("p_partkey").cast("double")
    return A.count_full_span(t.part.select(F.col("p_brand").alias("submission"), B.box_rings(x0, y, x1, y + 1).alias("rings")), ["submission"])


# ---- sorts and limits ------------------------------------------------------------------------------

GAL = "(SELECT 'g' || c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE '2026-0' || (1 + c_custkey % 9) END AS date FROM customer)"


@query("gallery_order", "O2", f"SELECT id, date FROM {GAL} ORDER BY date DESC, id DESC")
def _(t):
    return A.order_gallery(t.sql(f"SELECT * FROM {GAL}"))


@query("violation_samples", "O3", f"SELECT submission, pos, rank::INTEGER AS rank, total FROM (SELECT p_brand AS submission, p_partkey AS pos, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank, count(*) OVER (PARTITION BY p_brand) AS total FROM part) WHERE rank <= 5")
def _(t):
    return A.sample_violations(t.part.select(F.col("p_brand").alias("submission"), F.col("p_partkey").alias("pos")), ["submission"], [F.col("pos")], 5)


@query("top_buildings", "O4", f"SELECT pos AS building_id, (x1-x0)*(y1-y0) AS area FROM {B.FEATURES} WHERE (x1-x0)*(y1-y0) >= 60 ORDER BY 2 DESC, 1 LIMIT 500")
def _(t):
    return A.top_buildings(rects(t).select(F.col("pos").alias("building_id"), G.area_m2(F.array("rings")).alias("area")), 60.0, 500)


@query("compact_actions", "O5", """SELECT p_partkey, array_to_string(list_slice(['act ' || p_size, 'b c', 'd' || (p_partkey % 3), 'd1'] , 1, CASE WHEN p_partkey % 3 = 1 THEN 3 ELSE 4 END), '|') || CASE WHEN p_size % 2 = 0 THEN '|完成七维评分中列出的 ' || p_size || ' 项详细 required repairs；逐项证据和修复要求见各维度。' ELSE '' END AS actions FROM part""")
def _(t):
    acts = F.array(F.concat(F.lit(" act  "), F.col("p_size")), F.lit("b\tc"), F.lit("b c"), F.lit(" "), F.concat(F.lit("d"), F.col("p_partkey") % 3), F.lit("d1"))
    return t.part.select("p_partkey", F.array_join(A.compact_actions(acts, F.when(F.col("p_size") % 2 == 0, F.col("p_size")).otherwise(0)), "|").alias("actions"))


@query("risk_order", "O6", "SELECT c_nationkey AS submission, c_custkey % 5 AS score, c_name AS label FROM customer ORDER BY 1, 2 DESC, 3")
def _(t):
    return A.order_risk(t.customer.select(F.col("c_nationkey").alias("submission"), (F.col("c_custkey") % 5).alias("score"), F.col("c_name").alias("label")))


@query("dimension_order", "O7", "SELECT event_id, event_type AS dimension, coalesce(list_position(['view','click','error'], event_type), 0)::INTEGER AS dim_rank FROM events")
def _(t):
    order = ["view", "click", "error"]
    return A.order_dims(t.events.select("event_id", F.col("event_type").alias("dimension")), order)


@query("publication_class", "F32", """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'do-not-publish' WHEN p_retailprice / 12 >= 85 AND p_size % 3 = 0 THEN 'featured-candidate' WHEN p_retailprice / 12 >= 65 THEN 'publish-qualified' ELSE 'do-not-publish' END AS cls FROM part""")
def _(t):
    return t.part.select("p_partkey", A.publication_class(F.when(F.col("p_size") % 4 == 0, "reject").otherwise("formal-review-ready"), F.lit(True), F.col("p_retailprice") / 12, F.col("p_size") % 3).alias("cls"))


STATUS_SQL = """CASE WHEN c_custkey % 17 = 0 THEN 'blocked_fixture' WHEN c_custkey % 2 = 0 AND c_custkey % 4 = 0 THEN 'legacy_fixture' WHEN c_custkey % 5 = 0 THEN 'needs_revision' WHEN c_custkey % 3 = 0 THEN 'formal_review_ready'
    WHEN c_custkey % 3 = 1 THEN CASE WHEN c_custkey % 7 = 0 THEN 'needs_revision' ELSE 'formal_review_ready' END ELSE CASE WHEN c_custkey % 11 = 0 OR c_custkey % 7 = 0 THEN 'needs_revision' ELSE 'formal_review_ready' END END"""


def classified(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", A.classify_submission(
        F.when(k % 17 == 0, "x/formal-blocked/y").otherwise("x/y"), F.when(k % 4 == 0, "draft").otherwise("formal"), k % 5 != 0,
        F.when(k % 3 == 0, True).when(k % 3 == 1, False), k % 11 == 0, k % 7 == 0).alias("status_key"))


@query("classify_submission", "F31", f"SELECT c_custkey, {STATUS_SQL} AS status_key FROM customer")
def _(t):
    return classified(t)


GALLERY = f"""SELECT p.path, p.status_key, p.status_key = 'formal_review_ready' AS publishable FROM (SELECT 'submissions/u/' || c_custkey AS path, c_custkey, {STATUS_SQL} AS status_key FROM customer) p JOIN (SELECT 'submissions/u/' || pos AS path FROM {PUB_SQL} WHERE published) USING (path)"""


@query("gallery_join", "J18", GALLERY)
def _(t):
    pk = classified(t.__class__(t.spark, t.folder)).select(F.concat(F.lit("submissions/u/"), "c_custkey").alias("path"), "status_key")
    pub = t.sql(f"SELECT 'submissions/u/' || pos AS path, published FROM {PUB.replace('{sha}', 'c_name')}")
    return J.gallery(pk, pub)
