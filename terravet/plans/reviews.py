"""Review jobs: professional evidence, visual page, advisory score, gates, gallery, packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import documents as D
from ..operators import joins as J
from ..scale import top_k
from ..session import cut_lineage


def _issues(df: DataFrame, check_id: str, severity: str, detail: Column) -> DataFrame:
    return df.select("submission", F.lit(check_id).alias("check_id"), F.lit(severity).alias("severity"), detail.alias("detail"))


# ---- professional evidence -----------------------------------------------------------------

def references(docs: DataFrame) -> DataFrame:
    """Distinct (submission, kind, value) cited in the proposal texts."""
    return docs.select("submission", F.inline(X.extract_refs(F.col("text")))).distinct()


def professional_review(docs: DataFrame, standards: DataFrame, depths: DataFrame, metrics: DataFrame,
                        required_standards=P.REQUIRED_STANDARD_IDS, required_depths=P.REQUIRED_DEPTH_IDS,
                        data_paths=None) -> DataFrame:
    """Coverage of the matrices and citation of everything they hold."""
    spark = docs.sparkSession
    paths = ["geometry/" + f for f in P.GEOMETRY_FILES] if data_paths is None else data_paths
    table = lambda values: spark.createDataFrame([(v,) for v in values], "id string")
    subs = docs.select("submission")
    s, d = standards.select("submission", F.col("standard_id").alias("id")), depths.select("submission", F.col("item_id").alias("id"))
    known = metrics.filter("status = 'known'").select("submission", F.col("metric").alias("id"))
    data = subs.select("submission", F.explode(X.words(sorted(paths))).alias("id"))
    wanted = (s.withColumn("kind", F.lit("standard")).unionByName(d.withColumn("kind", F.lit("depth")))
              .unionByName(known.withColumn("kind", F.lit("metric"))).unionByName(data.withColumn("kind", F.lit("data"))))
    uncited = J.check_citations(references(docs), wanted)
    name = F.concat(F.upper("kind"), F.lit("_PROPOSAL_REF"))
    absent = docs.filter(F.col("text").isNull())
    return (_issues(J.missing(table(required_standards), subs, s, "submission", "id"), "STANDARD_MATRIX_COVERAGE", "major", F.col("id"))
            .unionByName(_issues(J.missing(table(required_depths), subs, d, "submission", "id"), "DESIGN_DEPTH_COVERAGE", "major", F.col("id")))
            .unionByName(uncited.select("submission", name.alias("check_id"), F.lit("major").alias("severity"), F.col("id").alias("detail")))
            .unionByName(_issues(absent, "PROPOSAL_MISSING", "blocking", F.lit(""))))


# ---- visual page ------------------------------------------------------------------------------

def visual_review(pages: DataFrame, metrics: DataFrame, names=P.VISUAL_METRICS, markers=None) -> DataFrame:
    """Page safety, text markers and declared metric values."""
    page = D.scan_visual_html(pages.filter("html IS NOT NULL"), "submission", "html", markers)
    values = J.compare_html_metrics(pages.filter("html IS NOT NULL"), metrics, names)
    gone = _issues(pages.filter("html IS NULL"), "VISUAL_HTML_MISSING", "blocking", F.lit(""))
    return page.unionByName(values.select("submission", "check_id", F.lit("major").alias("severity"), F.col("metric").alias("detail"))).unionByName(gone)


# ---- advisory score ------------------------------------------------------------------------------

def advisory_score(docs: DataFrame, sources: DataFrame, terms: dict | None = None) -> DataFrame:
    """Status per dimension and document; ``terms`` replaces the built-in word lists."""
    p = {k: getattr(P, k) for k in ("TASK_TERMS", "ORIGINALITY_TERMS", "AI_TERMS", "URBAN_TERMS", "PHASE_TERMS", "ACTOR_TERMS",
                                    "METRIC_TERMS", "PUBLIC_TERMS", "RISK_TERMS", "MANUAL_REVIEW_TERMS", "TEMPLATE_PLACEHOLDERS",
                                    "CONCEPT_ALIASES", "AI_ALIASES", "LANDING_ALIASES", "RISK_ALIASES", "REFERENCE_ALIASES", "SECTION_GROUPS")}
    p.update(terms or {})
    split = docs.select("submission", "text", F.inline(F.array(X.front_matter(F.col("text")))))
    cut = split.select("submission", "text", "meta", "body", X.sections(F.col("body")).alias("secs"))
    found = cut.select("*", *[X.find_section(F.col("secs"), p[f"{n}_ALIASES"]).alias(n.lower()) for n in ("CONCEPT", "AI", "LANDING", "RISK", "REFERENCE")])
    n = lambda col, terms_: X.count_terms(F.col(col), p[terms_])
    counted = found.select(
        "submission", "reference", *[(F.col(x) == "").alias(f"no_{x}") for x in ("concept", "ai", "landing", "risk", "reference")],
        n("text", "TASK_TERMS").alias("task"), n("concept", "ORIGINALITY_TERMS").alias("orig"),
        n("ai", "AI_TERMS").alias("ai_n"), n("ai", "URBAN_TERMS").alias("urban"), n("landing", "PHASE_TERMS").alias("phase"),
        n("landing", "ACTOR_TERMS").alias("actor"), n("landing", "METRIC_TERMS").alias("metric"), n("text", "PUBLIC_TERMS").alias("public"),
        n("risk", "RISK_TERMS").alias("risk_n"), n("text", "MANUAL_REVIEW_TERMS").alias("manual"),
        X.compact_len(F.col("concept")).alias("concept_len"), X.compact_len(F.col("ai")).alias("ai_len"), X.compact_len(F.col("risk")).alias("risk_len"),
        X.compact_len(F.col("body")).alias("body_len"), (F.size(X.hits(F.col("text"), p["TEMPLATE_PLACEHOLDERS"])) > 0).alias("placeholder"),
        F.exists(X.words(P.REQUIRED_METADATA), lambda k: ~F.exists(F.col("meta"), lambda m: (m["key"] == k) & (m["value"] != ""))).alias("meta_gap"),
        _group_gap(F.col("secs"), p["SECTION_GROUPS"]).alias("section_gap"))
    # Read twice below: the counts and the reference section are kept instead of found again in the whole texts.
    counted = cut_lineage(counted)
    matched = J.match_sources(docs, "submission", "text", sources)
    with_section = counted.select("submission", F.concat(F.lit("## r\n"), "reference").alias("reference"))
    loose = J.unmatched_lines(with_section, "submission", "reference", sources, matched).select("submission").distinct().withColumn("loose", F.lit(True))
    both = counted.join(matched.select("submission").distinct().withColumn("matched", F.lit(True)), "submission", "left").join(loose, "submission", "left")
    c = F.col
    empty = lambda x: c(f"no_{x}")
    status = [
        X.status_from_count(c("task"), 4, 2),
        F.when(empty("concept"), "missing").when((c("concept_len") >= 120) & (c("orig") >= 2), "pass").otherwise("needs-work"),
        F.when(empty("ai"), "missing").when((c("ai_n") >= 2) & (c("urban") >= 2) & (c("ai_len") >= 120), "pass").otherwise("needs-work"),
        F.when(empty("landing"), "missing").when((c("phase") > 0) & (c("actor") > 0) & (c("metric") > 0), "pass")
        .when(c("phase") + c("actor") + c("metric") > 0, "needs-work").otherwise("missing"),
        X.status_from_count(c("public"), 4, 2),
        F.when(c("manual") > 0, "manual-review").when(empty("risk"), "missing")
        .when((c("risk_n") >= 4) & (c("risk_len") >= 100), "pass").otherwise("needs-work"),
        F.when(c("meta_gap") | c("section_gap") | c("placeholder"), "missing").when(c("body_len") < 800, "needs-work").otherwise("pass"),
        F.when(empty("reference"), "missing").when(c("matched").isNotNull() & c("loose").isNull(), "pass").otherwise("needs-work")]
    rows = F.array(*[F.struct(F.lit(i).alias("dim_rank"), F.lit(name).alias("dimension"), s.alias("status"))
                     for i, (name, s) in enumerate(zip(P.SCORE_DIMENSIONS, status), 1)])
    return both.select("submission", F.inline(rows))


def _group_gap(secs: Column, groups) -> Column:
    gap = F.lit(False)
    for _, aliases in groups:
        gap = gap | ~_has_title(secs, aliases)
    return gap


def _has_title(secs: Column, aliases) -> Column:
    return F.exists(secs, lambda s: X.has_any(s["title"], aliases))


# ---- gates, scorecards, reviewed score ----------------------------------------------------------------

def self_check(validation: DataFrame, spatial: DataFrame, visual: DataFrame, professional: DataFrame, stages: DataFrame) -> DataFrame:
    """Four issue tables to one gate row per submission; no blocking or major issue means passed."""
    tables = {"validation": validation, "spatial": spatial, "visual": visual, "professional": professional}
    bad = None
    for name, issues in tables.items():
        one = issues.filter(F.col("severity").isin("blocking", "major", "error")).select("submission", F.lit(name).alias("gate"))
        bad = one if bad is None else bad.unionByName(one)
    # One row per submission meets the stages, so a task holds one join for all four tables.
    flags = bad.groupBy("submission").agg(*[F.bool_or(F.col("gate") == name).alias(name) for name in tables])
    gates = stages.select("submission").join(flags, "submission", "left").select("submission", F.inline(F.array(*[
        F.struct(F.lit(name).alias("gate"), (~F.coalesce(name, F.lit(False))).alias("ok")) for name in tables])))
    return A.gate(gates, stages)


def maintainer_summary(gate_rows: DataFrame, errors: DataFrame) -> DataFrame:
    mark = lambda c: F.when(F.col(c), "PASS").otherwise("FAIL").alias(c)
    return A.recommendation(gate_rows, errors).select(
        "submission", "recommendation", "ok", "can_enter_formal_review", mark("validation"), mark("spatial"), mark("visual"), mark("professional"))


def formal_scorecard(summary: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """One row per submission and dimension; a draft only when the gate is open."""
    weights = weights or P.RUBRIC_WEIGHTS
    open_ = F.col("can_enter_formal_review") & (F.col("recommendation") == "formal-review-ready")
    rows = F.array(*[F.struct(F.lit(d).alias("dimension_id"), F.lit(w).alias("weight_percent")) for d, w in weights.items()])
    return summary.select("submission", F.when(open_, "draft").otherwise("blocked").alias("scoring_status"), "recommendation", F.inline(rows))


def reviewed_score(scores: DataFrame, reviews: DataFrame, gate_rows: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """Given review with the local gates enforced, weighted score and publication class."""
    total = A.weighted_score(scores, weights or P.RUBRIC_WEIGHTS).select("submission", "weighted_score")
    both = reviews.join(gate_rows.select("submission", F.col("ok").alias("gates_ok")), "submission", "left").join(total, "submission", "left")
    failed = ~F.coalesce("gates_ok", F.lit(False))
    rec = (F.when(F.col("mandatory_hits") > 0, "reject").when(failed | (F.col("open_actions") > 0), "request-changes").otherwise(F.col("recommendation")))
    fixed = both.withColumn("recommendation", rec)
    can = F.col("can_enter") & (F.col("recommendation") == "formal-review-ready")
    return fixed.select("submission", "recommendation", can.alias("can_enter_formal_review"), F.coalesce("weighted_score", F.lit(0.0)).alias("weighted_score"),
                        A.publication_class(F.col("recommendation"), can, F.coalesce("weighted_score", F.lit(0.0)), F.col("open_actions")).alias("publication"))


def panel_verdicts(verdicts: DataFrame) -> DataFrame:
    return A.panel(verdicts).withColumn("summary", F.concat(
        F.col("judges") - F.col("n_refuted"), F.lit("/"), F.col("judges"), F.lit(" not refuted, "), F.col("n_blocking"), F.lit(" blocking: "), F.col("decision")))


# ---- gallery, portal, packets ------------------------------------------------------------------------

def gallery_table(packages: DataFrame, publication: DataFrame) -> DataFrame:
    """Published, ready packages with display texts, newest first."""
    live = J.gallery(packages, publication).filter("publishable")
    en = F.col("language") == "en"
    pick = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    return A.order_gallery(live.select(
        "path", "id", F.when(en, pick("title_zh", "title", "id")).otherwise(pick("title", "id")).alias("title"),
        F.when(en, pick("title", "id")).otherwise(pick("title_en", "title", "id")).alias("title_en"),
        X.iso_date(F.col("generated_at")).alias("date"), "status_key"))


def compare_table(cards: DataFrame, tracks: DataFrame, risk: DataFrame, concepts: DataFrame, modules: DataFrame,
                  none: str = "未提供") -> DataFrame:
    """The ten compare fields per proposal from its card, tracks, risks, concepts and exhibit modules.

    ``modules`` holds (submission, module, value) with the rolled-up text of a module;
    concepts carry the label of their type and of their place.
    """
    t = J.label_tags(cards, "submission", "tracks", tracks, 3).groupBy("submission").agg(F.array_sort(F.collect_list(F.struct("pos", "title", "id"))).alias("t"))
    r = A.risk_summary(risk).select("submission", F.col("top").alias("risk_text"))
    order = [F.coalesce(F.col("order"), F.lit(99)), F.col("title")]
    shown = F.concat("type_label", F.lit("："), "title", F.lit("（"), "place_label", F.lit("）"))
    k = (top_k(concepts.withColumn("__shown", shown), ["submission"], order, 4).groupBy("submission")
         .agg(F.array_sort(F.collect_list(F.struct("rank", "__shown"))).alias("c"))
         .select("submission", F.array_join(F.transform("c", lambda x: x["__shown"]), "；").alias("concept_text")))
    names = ("spatial_strategy", "agent_workflow", "scenario_gallery", "timeline")
    m = modules.groupBy("submission").agg(*[F.max(F.when(F.col("module") == x, F.nullif("value", F.lit("")))).alias(x) for x in names])
    all_ = cards
    for part in (t, r, k, m):
        all_ = all_.join(part, "submission", "left")
    text = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(none))
    young = F.exists("t", lambda x: x["id"] == "youth-friendly-public-space")
    tags = F.array_join("tags", "、")
    return all_.select(
        "submission", text(X.compact_text(F.coalesce(F.nullif("summary", F.lit("")), "subtitle"), 220)).alias("core_concept"),
        text(F.array_join(F.transform("t", lambda x: x["title"]), "、")).alias("tracks"), text(F.col("concept_text")).alias("concept_space"),
        text(F.col("spatial_strategy")).alias("public_space"), text(F.col("agent_workflow"), tags).alias("industry_governance"),
        text(F.col("scenario_gallery"), F.array_join("scenarios", "、"), F.array_join("highlights", "；")).alias("ai_scene"),
        text(F.col("timeline")).alias("landing_path"), text(F.col("risk_text")).alias("risk"),
        F.when(F.coalesce(young, F.lit(False)), "已覆盖").otherwise("未单独声明").alias("youth"), text(tags).alias("beneficiaries"))


def packet_rows(packets: DataFrame) -> DataFrame:
    label = F.when(F.col("readiness").eqNullSafe(F.lit(True)), "YES").when(F.col("readiness").eqNullSafe(F.lit(False)), "NO").otherwise("未声明")
    return packets.select("path", "title", "author", "status", label.alias("readiness"))


def packet_metrics(metrics: DataFrame) -> DataFrame:
    """Metric rows of a packet: four significant digits with the unit."""
    v, unit = F.col("value"), X.blank(F.col("unit"))
    text = F.when(v.isNull(), "unknown").otherwise(F.trim(F.concat_ws(" ", significant(v), unit)))
    return metrics.select("submission", "metric", X.blank(F.col("status")).alias("status"), text.alias("shown"))


def significant(v: Column, digits: int = 4) -> Column:
    """Number with the given significant digits, plain or in exponent form."""
    def show(s):
        mag = F.when(s == 0, 0).otherwise(F.floor(F.log10(F.abs(s)))).cast("int")
        scaled = F.bround(s / F.pow(F.lit(10.0), mag - (digits - 1)))
        over = F.abs(scaled) >= 10.0 ** digits
        return F.struct(F.when(over, mag + 1).otherwise(mag).alias("m"), F.when(over, scaled / 10).otherwise(scaled).alias("d"))

    def text(p):
        mantissa = F.regexp_replace((p["d"] / 10.0 ** (digits - 1)).cast(f"decimal(20,{digits - 1})").cast("string"), r"\.?0+$", "")
        value = p["d"].cast("decimal(38,8)") * F.pow(F.lit(10.0), p["m"] - (digits - 1)).cast("decimal(38,8)")
        plain = F.regexp_replace(value.cast("decimal(38,8)").cast("string"), r"\.?0+$", "")
        sign = F.when(p["m"] < 0, "-").otherwise("+")
        return F.when((p["m"] < -4) | (p["m"] >= digits), F.concat(
            mantissa, F.lit("e"), sign, F.lpad(F.abs(p["m"]).cast("string"), 2, "0"))).otherwise(plain)
    return X.let(X.let(v.cast("double"), show), text)


def packet_checks(checks: DataFrame) -> DataFrame:
    return checks.select("submission", *[X.blank(F.col(c)).alias(c) for c in ("check_id", "result", "severity", "target", "message")])


def packet_blockers(manifests: DataFrame) -> DataFrame:
    """Known blockers of a manifest that say something, in order."""
    return (manifests.select("submission", F.posexplode("known_blockers").alias("pos", "blocker"))
            .filter(F.trim(X.blank(F.col("blocker"))) != ""))


def packet_assumptions(assumptions: DataFrame) -> DataFrame:
    return assumptions.select("submission", *[X.blank(F.col(c)).alias(c) for c in ("id", "status", "statement", "impact")])


def packet_sources(sources: DataFrame) -> DataFrame:
    return sources.select("submission", "id", "source_type", F.coalesce(F.nullif("path", F.lit("")), F.nullif("url", F.lit("")), F.lit("")).alias("place"), "usage")


def packet_risks(risk: DataFrame) -> DataFrame:
    return A.order_risk(risk.filter(F.col("score").isNotNull()).select(
        "submission", "label", "score", F.concat("score", F.lit("/5")).alias("shown"), X.compact_text(F.col("note"), 220).alias("note"),
        X.compact_text(F.col("mitigation"), 220).alias("mitigation")))


def packet_files(files: DataFrame) -> DataFrame:
    return files.select("submission", "label", F.when(F.col("exists"), "有").otherwise("缺失").alias("state"), "path")


def snapshot_upsert(current: DataFrame, fetched: DataFrame, protected=P.PROTECTED_SNAPSHOT_STATUSES) -> DataFrame:
    """New fetches replace rows, but a failed one never replaces a trusted row."""
    c = current.select("id", F.col("fetch_status").alias("c_status"), F.col("content").alias("c_content"), F.lit(True).alias("c"))
    f = fetched.select("id", F.col("fetch_status").alias("f_status"), F.col("content").alias("f_content"), "ok", F.lit(True).alias("f"))
    keep = F.col("f").isNull() | (F.col("c").isNotNull() & ~F.coalesce("ok", F.lit(False)) & F.coalesce(F.col("c_status").isin(list(protected)), F.lit(False)))
    return c.join(f, "id", "full_outer").select("id", F.when(keep, F.col("c_status")).otherwise(F.col("f_status")).alias("fetch_status"),
                                                F.when(keep, F.col("c_content")).otherwise(F.col("f_content")).alias("content"))
