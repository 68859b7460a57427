"""Roll-ups: reports, ratios, panels, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import geo as G
from ..functions import text as X
from ..scale import top_k
from ..session import cut_lineage
from . import overlay as O


def rule_report(results: DataFrame, group: str = "submission") -> DataFrame:
    """Totals per outcome with the two readiness flags."""
    fail = F.col("outcome") == "FAIL"
    critical = F.count_if(fail & (F.col("severity") == "critical"))
    return results.groupBy(group).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome") == "PASS").alias("passed"), F.count_if(fail).alias("failed"),
        critical.alias("critical_failures"), F.count_if(F.col("outcome") == "SKIP").alias("skipped"),
        F.count_if(F.col("outcome") == "ERROR").alias("errors"), (F.count_if(fail) == 0).alias("all_code_checks_pass"),
        (critical == 0).alias("ready_for_review"))


def failures_by(results: DataFrame, group: str = "submission") -> DataFrame:
    """Failures by category and by severity in one pass."""
    sets = results.filter("outcome = 'FAIL'").groupingSets(
        [[group, "category"], [group, "severity"]], group, "category", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("severity").alias("g"))
    return sets.select(group, F.when(F.col("g") == 1, "category").otherwise("severity").alias("kind"),
                       F.coalesce("category", "severity").alias("value"), "n")


def site_metrics(features: DataFrame, group: str = "submission", tile: float | None = None) -> DataFrame:
    """Union area per layer and the two ratios; the ratio of an empty site is NaN."""
    layers = {"SITE_BOUNDARY": "site_area_sqm", "GREEN_SPACE": "green_space_area_sqm",
              "PUBLIC_SPACE": "public_space_area_sqm", "BUILDING_FOOTPRINT": "building_footprint_area_sqm"}
    areas = O.union_area(features.filter(F.col("layer").isin(list(layers))), [group, "layer"], tile)
    wide = areas.groupBy(group).agg(*[
        F.coalesce(F.sum(F.when(F.col("layer") == k, F.col("union_area"))), F.lit(0.0)).alias(v) for k, v in layers.items()])
    ratio = lambda c: F.when(F.col("site_area_sqm") > 0, F.round(F.col(c) / F.col("site_area_sqm"), 6)).otherwise(F.lit(float("nan")))
    return wide.select(group, *[F.round(v, 3).alias(v) for v in layers.values()],
                       ratio("green_space_area_sqm").alias("green_ratio"), ratio("public_space_area_sqm").alias("public_space_ratio"))


def kpi_metrics(features: DataFrame, group: str = "submission", tile: float | None = None) -> DataFrame:
    """Site KPIs as metric rows; the floor-area ratio is unknown and says why."""
    m = site_metrics(features, group, tile)
    keys = features.filter("layer = 'KEY_AREA'").groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("key_area_count"))
    wide = m.join(keys, group, "left")
    row = lambda name, unit, value, reason="": F.struct(
        F.lit(name).alias("metric"), F.when(value.isNull(), "unknown").otherwise("known").alias("status"),
        value.cast("double").alias("value"), F.lit(unit).alias("unit"), F.lit(reason).alias("reason"))
    rows = F.array(row("site_area_sqm", "sqm", F.col("site_area_sqm")),
                   row("building_footprint_area_sqm", "sqm", F.col("building_footprint_area_sqm")),
                   row("green_ratio", "ratio", F.col("green_ratio")), row("public_space_ratio", "ratio", F.col("public_space_ratio")),
                   row("floor_area_ratio", "ratio", F.lit(None).cast("double"), "approved controls and official boundary are not given"),
                   row("key_area_count", "count", F.coalesce("key_area_count", F.lit(0.0))))
    return wide.select(group, F.inline(rows))


def check_green_ratio(features: DataFrame, group: str = "submission", low: float = 0.05, high: float = 0.80) -> DataFrame:
    """Sum of green areas over sum of site areas (sums, not unions)."""
    area = G.area_m2(F.col("polys"))
    sums = features.select(group, "layer", area.alias("a")).groupBy(group).agg(
        F.sum(F.when(F.col("layer") == "GREEN_SPACE", F.col("a"))).alias("green"),
        F.sum(F.when(F.col("layer") == "SITE_BOUNDARY", F.col("a"))).alias("site"))
    ratio = F.col("green") / F.col("site")
    outcome = (F.when(F.col("green").isNull() | F.col("site").isNull(), "SKIP").when(F.col("site") <= 0, "FAIL")
               .when(ratio.between(low, high), "PASS").otherwise("FAIL"))
    return sums.select(group, F.when(F.col("site") > 0, ratio).alias("ratio"), outcome.alias("outcome"))


def weighted_score(scores: DataFrame, weights: dict[str, int], group: str = "submission") -> DataFrame:
    """Sum of score / 5 * weight with the first row of a dimension; the rest are errors.

    The dimensions are a fixed short list, so one aggregate with a minimum
    position per dimension replaces a sort.
    """
    first = lambda d: F.min_by("score", F.when(F.col("dimension") == d, F.col("pos")))
    cols = [first(d).alias(f"s{i}") for i, d in enumerate(weights)]
    has = [F.count_if(F.col("dimension") == d).alias(f"n{i}") for i, d in enumerate(weights)]
    wide = scores.groupBy(group).agg(*cols, *has, F.count_if(~F.col("dimension").isin(list(weights))).alias("unknown_rows"))
    total = F.lit(0.0)
    for i, (d, w) in enumerate(weights.items()):
        total = total + F.when(F.col(f"n{i}") > 0, F.col(f"s{i}") / 5.0 * w).otherwise(0.0)
    missing = F.array_compact(F.array(*[F.when(F.col(f"n{i}") == 0, F.lit(d)) for i, d in enumerate(weights)]))
    extra = F.lit(0)
    for i in range(len(weights)):
        extra = extra + F.greatest(F.col(f"n{i}") - 1, F.lit(0))
    return wide.select(group, F.round(total, 2).alias("weighted_score"), F.array_join(F.array_sort(missing), ", ").alias("missing"),
                       extra.cast("bigint").alias("duplicate_rows"), "unknown_rows")


def panel(verdicts: DataFrame, group: str = "submission", allowed: int = 2) -> DataFrame:
    """Approved with at most two refutations and no blocking one among them.

    ``route`` is where the procedure sends the package next: a blocking refutation goes
    before everything, then more refutations than allowed, then any at all.
    """
    refuted = F.coalesce(F.col("refuted"), F.lit(True))
    n, blocking = F.count_if(refuted), F.count_if(refuted & F.coalesce(F.col("blocking"), F.lit(False)))
    counts = verdicts.groupBy(group).agg(F.count(F.lit(1)).alias("judges"), n.alias("n_refuted"), blocking.alias("n_blocking"))
    route = (F.when(F.col("n_blocking") > 0, "blocking").when(F.col("n_refuted") > allowed, "major_fixes")
             .when(F.col("n_refuted") > 0, "minor_fixes").otherwise("approved"))
    approved = (F.col("n_refuted") <= allowed) & (F.col("n_blocking") == 0)
    return counts.withColumn("approved", approved).withColumn(
        "decision", F.when(F.col("approved"), "APPROVED").otherwise("NEED_WORK")).withColumn("route", route)


def risk_summary(risk: DataFrame, group: str = "submission", k: int = 3) -> DataFrame:
    """Maximum, count of high scores and the top labels; malformed scores are ignored."""
    score = F.when(F.col("score").rlike(r"^\d+$"), F.col("score").try_cast("int"))
    valid = risk.withColumn("__s", score).filter(F.col("__s").between(1, 5)).withColumn(
        "__l", F.coalesce(F.nullif("label", F.lit("")), F.nullif("id", F.lit("")), F.lit("风险")))
    sums = valid.groupBy(group).agg(F.max("__s").alias("max_score"), F.count_if(F.col("__s") >= 4).alias("high_count"))
    top = top_k(valid, [group], [F.desc("__s"), F.col("__l")], k).groupBy(group).agg(F.array_sort(F.collect_list(
        F.struct((-F.col("__s")).alias("s"), F.col("__l").alias("l")))).alias("t"))
    text = F.array_join(F.transform("t", lambda r: F.concat(r["l"], F.lit(" "), -r["s"], F.lit("/5"))), "；")
    return sums.join(top, group).select(group, "max_score", "high_count", text.alias("top"))


def concept_summary(items: DataFrame, group: str = "submission", k: int = 6) -> DataFrame:
    """Counts by type and the first items by (order, title)."""
    order = F.coalesce(F.col("order"), F.lit(99))
    sums = items.groupBy(group).agg(*[F.count_if(F.col("type") == c).alias(f"n_{c}") for c in P.CONCEPT_TYPES])
    head = top_k(items.withColumn("__o", order), [group], [F.col("__o"), F.col("title")], k).groupBy(group).agg(F.array_sort(
        F.collect_list(F.struct("__o", "title"))).alias("h"))
    return sums.join(head, group).select(group, *[f"n_{c}" for c in P.CONCEPT_TYPES], F.array_join(
        F.transform("h", lambda r: r["title"]), "|").alias("first_titles"))


def layer_stats(files: DataFrame, features: DataFrame) -> DataFrame:
    """Feature count per file, -1 when the file could not be read."""
    n = features.groupBy("submission", "layer_file").agg(F.count(F.lit(1)).alias("n"))
    return files.join(n, ["submission", "layer_file"], "left").select(
        "submission", "layer_file", F.when(F.col("readable"), F.coalesce("n", F.lit(0))).otherwise(F.lit(-1)).cast("bigint").alias("n"))


def reconcile(rows: DataFrame, totals: DataFrame, group: str, tolerance: float = 0.01) -> DataFrame:
    """Keeps a group only if its sums are within the tolerance of the stated totals.

    Groups without stated totals stay; the note says which case applied.
    """
    sums = rows.groupBy(group).agg(F.sum("land").alias("__sl"), F.sum("floor").alias("__sf"))
    ok = ((F.abs(F.col("__sl") - F.col("total_land")) / F.col("total_land") <= tolerance)
          & (F.abs(F.col("__sf") - F.col("total_floor")) / F.col("total_floor") <= tolerance))
    gate = sums.join(totals, group, "left").select(group, F.when(
        F.col("total_land").isNull() | F.col("total_floor").isNull(), "no_total").when(ok, "matched").otherwise("dropped").alias("note"))
    return rows.join(gate.filter("note <> 'dropped'"), group)


def reconcile_notes(rows: DataFrame, totals: DataFrame, group: str, tolerance: float = 0.01) -> DataFrame:
    sums = rows.groupBy(group).agg(F.sum("land").alias("sum_land"), F.sum("floor").alias("sum_floor"))
    ok = ((F.abs(F.col("sum_land") - F.col("total_land")) / F.col("total_land") <= tolerance)
          & (F.abs(F.col("sum_floor") - F.col("total_floor")) / F.col("total_floor") <= tolerance))
    return sums.join(totals, group, "left").select(group, "sum_land", "sum_floor", F.when(
        F.col("total_land").isNull() | F.col("total_floor").isNull(), "no_total").when(ok, "matched").otherwise("dropped").alias("note"))


def scorecard_summary(checks: DataFrame, group: str = "submission") -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return checks.groupBy(group).agg(
        n("pass").alias("n_pass"), n("needs-work").alias("n_needs_work"), n("missing").alias("n_missing"),
        n("manual-review").alias("n_manual_review"), (n("missing") == 0).alias("ready"))


def check_part_sum(parts: DataFrame, totals: DataFrame, group: str) -> DataFrame:
    sums = parts.groupBy(group).agg(F.sum("area_sqm").alias("part_sum"))
    return totals.join(sums, group, "left").select(group, "part_sum", "total", F.coalesce(
        F.col("part_sum") == F.col("total"), F.lit(False)).alias("equal"))


def area_by_code(features: DataFrame, group: str = "submission", code: str = "land_use_code", area: str = "area") -> DataFrame:
    """Area share per code; the total is a second aggregate of the small result."""
    sums = features.groupBy(group, code).agg(F.sum(area).alias("area"))
    total = sums.groupBy(group).agg(F.sum("area").alias("__t"))
    return sums.join(total, group).select(group, code, "area", (F.col("area") / F.col("__t")).alias("share"))


def package_sha(files: DataFrame, group: str = "submission") -> DataFrame:
    """Package digest over the sorted (path, length, bytes) of its declared files.

    A package is at most some twenty megabytes by rule, so its bytes fit one row.
    """
    zero = F.unhex(F.lit("00"))

    def part(f):
        size = F.encode(F.length(f["content"]).cast("string"), "UTF-8")
        return F.hex(F.concat(F.encode(f["path"], "UTF-8"), zero, size, zero, f["content"], zero))
    bits = F.array_sort(F.collect_list(F.struct("path", "content")))
    # Joined as hex digits: one pass, where a growing binary would be copied for each file.
    return files.groupBy(group).agg(bits.alias("__b")).select(
        group, F.sha2(F.unhex(F.array_join(F.transform("__b", part), "")), 256).alias("sha256"))


def declared_keys(metrics: DataFrame, group: str = "submission") -> DataFrame:
    return metrics.select(group, "metric").distinct()


def citation_counts(refs: DataFrame, group: str = "submission") -> DataFrame:
    """Distinct citations by kind."""
    one = refs.select(group, "kind", "value").distinct()
    return one.groupBy(group).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("source", "standard", "depth", "data", "metric")])


def gate(gates: DataFrame, stages: DataFrame, group: str = "submission") -> DataFrame:
    """Four-gate conjunction: a gate without rows has not passed."""
    names = ["validation", "spatial", "visual", "professional"]
    flags = [F.coalesce(F.bool_and(F.when(F.col("gate") == n, F.col("ok"))), F.lit(False)).alias(n) for n in names]
    ok = F.col(names[0])
    for n in names[1:]:
        ok = ok & F.col(n)
    wide = gates.groupBy(group).agg(*flags).join(stages, group, "left").withColumn("ok", ok)
    ready = F.col("ok") & F.coalesce(F.col("stage") == "formal", F.lit(False))
    return wide.select(group, *names, "ok", F.coalesce("stage", F.lit("unknown")).alias("stage"), ready.alias("can_enter_formal_review"),
                       F.when(F.col("stage") == "formal", "professional_design_package").otherwise("unknown").alias("package_type"),
                       F.when(ready, "formal-review-ready").otherwise("revision-requested").alias("review_status"))


def next_actions(issues: DataFrame, keys: Sequence[str] = ("submission",)) -> DataFrame:
    """Action line per blocking or major issue, numbered in gate order.

    One row per action; the list stays a table however long it grows.
    """
    label = (F.when(F.col("gate") == "validation", F.concat(F.lit("Fix deterministic validation error: "), X.blank(F.col("message"))))
             .otherwise(F.concat(F.lit("Repair "), F.when(F.col("gate") == "professional", "professional evidence").otherwise(F.col("gate")),
                                 F.lit(" issue "), F.col("check_id"), F.lit(": "), X.blank(F.col("message")))))
    rank = F.array_position(X.words(["validation", "spatial", "visual", "professional"]), F.col("gate"))
    return issues.filter(F.col("severity").isin("blocking", "major", "error")).select(
        *keys, rank.cast("int").alias("gate_rank"), "pos", label.alias("action"))


def recommendation(gate_rows: DataFrame, errors: DataFrame, group: str = "submission", words: Sequence[str] = P.REJECTION_WORDS) -> DataFrame:
    """Reject on a mandatory hit, else request changes, else ready."""
    hit = errors.groupBy(group).agg(F.bool_or(X.has_any(F.col("message"), words)).alias("__hit"))
    verdict = (F.when(F.coalesce("__hit", F.lit(False)), "reject").when(~F.coalesce(F.col("ok"), F.lit(False)), "request-changes")
               .otherwise("formal-review-ready"))
    return gate_rows.join(hit, group, "left").withColumn("recommendation", verdict).drop("__hit")


def violations(evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of the violations over the evidence arrays of several runs."""
    runs = [c for c, t in evidence.dtypes if t.startswith("array<struct")]
    all_rows = F.flatten(F.array_compact(F.array(*[F.col(c) for c in runs])))
    return evidence.select(*keys, F.inline(F.filter(all_rows, lambda e: e["outcome"] == "violation")))


def exact_quantile(df: DataFrame, group: Sequence[str], value: str, q: float, out: str) -> DataFrame:
    """Exact quantile of each group, interpolated between the two rows around its rank.

    Equal values are counted before anything moves, the counted values are dealt to ranges
    of (group, value), and the counts of the ranges say in which of them the rank lies.  No
    task holds the values of a group, and a group of any size is spread over the ranges.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n"))
    dealt = cut_lineage(counted.repartitionByRange(*group, value).withColumn("__part", F.spark_partition_id()))
    keys = [F.col(c) for c in group]
    totals = dealt.groupBy(*group, "__part").agg(F.sum("__n").alias("__m"))  # a row for each range and group
    every = Window.partitionBy(*keys)
    totals = totals.withColumn("__all", F.sum("__m").over(every)).withColumn("__before", F.coalesce(F.sum("__m").over(
        every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = F.lit(True)
    other = totals.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(group)], F.col("__part").alias("__p"), "__all", "__before")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(other, same & (F.col("__part") == F.col("__p"))).withColumn("__end", F.col("__before") + F.sum("__n").over(inside))
    rank = (F.col("__all") - 1) * F.lit(q)
    holds = lambda at: (F.col("__end") - F.col("__n") <= at) & (at < F.col("__end"))
    ends = placed.groupBy(*group).agg(F.max(F.when(holds(F.floor(rank)), F.col(value))).alias("__lo"),
                                      F.max(F.when(holds(F.ceil(rank)), F.col(value))).alias("__hi"), F.max(rank).alias("__rank"))
    return ends.select(*group, (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("__rank") - F.floor("__rank"))).alias(out))


def osm_profile(features: DataFrame, tag: str = "tag") -> DataFrame:
    """Feature counts, non-null heights, median and total footprint by tag and overall."""
    base = features.rollup(tag).agg(
        F.grouping_id().cast("int").alias("__level"), F.count(F.lit(1)).alias("n"), F.count("height").alias("with_height"), F.sum("area").alias("total_area"))
    kind = features.schema[tag].dataType
    medians = exact_quantile(features, [tag], "area", 0.5, "median_area").select(F.col(tag).alias("__tag"), F.lit(0).alias("__at"), "median_area").unionByName(
        exact_quantile(features, [], "area", 0.5, "median_area").select(F.lit(None).cast(kind).alias("__tag"), F.lit(1).alias("__at"), "median_area"))
    met = (F.col("__level") == F.col("__at")) & F.col(tag).eqNullSafe(F.col("__tag"))
    return base.join(medians, met, "left").select(tag, "n", "with_height", "median_area", "total_area")


def geometry_flags(features: DataFrame, group: str = "submission") -> DataFrame:
    """Any provisional feature; all official with a site and three key areas."""
    relevant = features.filter(F.col("layer_file").isin("site_boundary.geojson", "key_areas.geojson"))
    official = F.col("official_boundary").eqNullSafe(F.lit(True)) & F.col("geometry_role").eqNullSafe(F.lit("official_constraint"))
    provisional = F.col("official_boundary").eqNullSafe(F.lit(False)) | F.col("geometry_role").eqNullSafe(F.lit("provisional_constraint"))
    n = lambda f: F.count_if(F.col("layer_file") == f)
    return relevant.groupBy(group).agg(
        F.bool_or(provisional).alias("has_provisional"),
        (F.bool_and(official) & (n("site_boundary.geojson") > 0) & (n("key_areas.geojson") >= 3)).alias("has_official"))


def boundary_ready(checks: DataFrame, group: str = "submission", ids: Sequence[str] = P.TRUST_CHECKS) -> DataFrame:
    """Latest severity of each trust check is ``info``."""
    latest = checks.filter(F.col("check_id").isin(list(ids))).groupBy(group, "check_id").agg(F.max_by("severity", "pos").alias("s"))
    return latest.groupBy(group).agg(F.bool_and(F.coalesce(F.col("s") == "info", F.lit(False))).alias("boundary_ready"))


def count_full_span(features: DataFrame, group: Sequence[str]) -> DataFrame:
    """Axis-aligned five-point rings that span 99 percent of the layer box."""
    boxed = features.withColumn("__b", G.bbox(F.col("rings")))
    layer = boxed.groupBy(*group).agg(F.min("__b.x0").alias("__x0"), F.min("__b.y0").alias("__y0"),
                                      F.max("__b.x1").alias("__x1"), F.max("__b.y1").alias("__y1"))
    r = F.col("rings")[0]
    straight = F.forall(F.zip_with(F.slice(r, 1, 4), F.slice(r, 2, 4), lambda a, b: (a["x"] == b["x"]) | (a["y"] == b["y"])), lambda v: v)
    rect = (F.size(r) == 5) & (r[0] == F.element_at(r, -1)) & straight
    w, h = F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0")
    spans = (w > 0) & (h > 0) & ((F.col("__b.y1") - F.col("__b.y0") >= h * 0.99) | (F.col("__b.x1") - F.col("__b.x0") >= w * 0.99))
    return boxed.join(layer, list(group)).groupBy(*group).agg(F.count_if(F.coalesce(rect & spans, F.lit(False))).alias("full_span"))


def sample_violations(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k violations of each group beside the full count."""
    total = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("total"))
    return top_k(rows, group, order, k, "rank").join(total, list(group))


def top_buildings(buildings: DataFrame, min_area: float = 60.0, k: int = 4000) -> DataFrame:
    return buildings.filter(F.col("area") >= min_area).orderBy(F.desc("area"), "building_id").limit(k)


def compact_actions(actions: Column, repairs: Column, limit: int = 12) -> Column:
    """First distinct, space-normalised actions and one line for the listed repairs."""
    flat = F.filter(F.array_distinct(F.transform(actions, X.collapse_space)), lambda a: a != "")
    line = F.concat(F.lit("完成七维评分中列出的 "), repairs.cast("string"), F.lit(" 项详细 required repairs；逐项证据和修复要求见各维度。"))
    return X.let(F.slice(flat, 1, limit), lambda v: F.when(
        (repairs > 0) & ~F.array_contains(v, line), F.array_append(v, line)).otherwise(v))


def order_risk(risk: DataFrame) -> DataFrame:
    return risk.orderBy("submission", F.desc("score"), "label")


def order_dims(df: DataFrame, order: Sequence[str], col: str = "dimension") -> DataFrame:
    return df.withColumn("dim_rank", F.array_position(X.words(order), F.col(col)).cast("int")).orderBy("dim_rank")


def order_gallery(g: DataFrame) -> DataFrame:
    return g.orderBy(F.desc("date"), F.desc("id"))


def publication_class(recommendation: Column, can_enter: Column, score: Column, open_actions: Column) -> Column:
    blocked = ~F.coalesce((recommendation == "formal-review-ready") & can_enter, F.lit(False))
    return (F.when(blocked, "do-not-publish").when((score >= 85) & (open_actions == 0), "featured-candidate")
            .when(score >= 65, "publish-qualified").otherwise("do-not-publish"))


def classify_submission(path: Column, stage: Column, complete: Column, readiness: Column, blockers: Column, blocking_fail: Column) -> Column:
    """Status key of a stored package."""
    return (F.when(F.contains(path, F.lit("formal-blocked")) | F.contains(path, F.lit("blocked-draft")), "blocked_fixture")
            .when(~F.coalesce(stage == "formal", F.lit(False)), "legacy_fixture")
            .when(~complete, "needs_revision")
            .when(readiness.eqNullSafe(F.lit(True)), "formal_review_ready")
            .when(readiness.isNull() & blockers, "needs_revision")
            .when(blocking_fail, "needs_revision").otherwise("formal_review_ready"))
