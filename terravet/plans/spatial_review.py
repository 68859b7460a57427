"""Spatial audit of submissions: validity, areas, gaps, overlaps, containment, ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import geo as G
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import overlay as O
from ..scale import dealt

GROUP = "submission"


def project_features(features: DataFrame) -> DataFrame:
    """Adds ``rings`` in metres from ``polys`` in degrees."""
    return features.withColumn("rings", G.project_rings(G.rings_of(F.col("polys"))))


def _rows(df: DataFrame, check: str, severity: str = "major", feature=None, expected=None, actual=None) -> DataFrame:
    num = lambda c, d=3: F.round(c, d).cast("string") if isinstance(c, Column) else F.lit(c).cast("string")
    return df.select(GROUP, F.lit(check).alias("check_id"), F.lit(severity).alias("severity"),
                     (feature if feature is not None else F.lit(None)).cast("string").alias("feature_id"),
                     num(expected).alias("expected"), num(actual).alias("actual"))


def declared_mismatch(features: DataFrame) -> DataFrame:
    """Declared area off by more than max(1, 1 percent of the measured area)."""
    sized = features.withColumn("area", G.polygon_area(F.col("rings")))
    slack = F.greatest(F.lit(1.0), F.abs("area") * 0.01)
    return sized.filter(F.abs(F.col("area_declared") - F.col("area")) > slack)


def validity(features: DataFrame, keys: Sequence[str], cell: float | None = None) -> DataFrame:
    """Kind, positive area, closed and complete rings, holes inside their shell, no ring
    that crosses or touches itself: one row per finding."""
    ok_kind = F.coalesce(F.col("geom_type").isin("Polygon", "MultiPolygon"), F.lit(False))
    row = F.array_compact(F.array(
        F.when(F.col("rings").isNull(), "NO_GEOMETRY"), F.when(F.col("rings").isNotNull() & ~ok_kind, "NOT_A_POLYGON"),
        F.when(ok_kind & (G.polygon_area(F.col("rings")) <= 0), "ZERO_AREA"),
        F.when(ok_kind & ~F.forall("rings", G.closed), "RING_NOT_CLOSED"),
        F.when(ok_kind & ((F.size("rings") == 0) | F.exists("rings", lambda r: F.size(r) < 4)), "EMPTY_PART"),
        F.when((F.col("geom_type") == "Polygon") & (F.size("rings") > 1) & G.hole_outside(F.col("rings")), "HOLE_OUTSIDE")))
    simple = features.select(*keys, F.explode(row).alias("reason"))
    crossed = O.self_crossing(features.filter(ok_kind).select(*keys, "rings"), keys, cell).withColumn("reason", F.lit("SELF_CROSSING"))
    return simple.unionByName(crossed)


def key_area_audit(features: DataFrame, site: DataFrame, official: dict[str, float] | None = None, tile: float | None = None) -> DataFrame:
    """Role class, outside area, official area, pair overlap and missing ids of key areas."""
    official = P.KEY_AREA_SQM if official is None else official
    t = tile or O.pick_tile(features)
    f = features.withColumn("area_id", F.coalesce(F.nullif("area_id", F.lit("")), F.col("feature_id")))
    is_official = F.coalesce(F.col("official_boundary") & (F.col("geometry_role") == "official_constraint"), F.lit(False))
    is_provisional = F.coalesce(~F.col("official_boundary") & (F.col("geometry_role") == "provisional_constraint"), F.lit(False))
    out = O.outside_site(f, site, [GROUP], "feature_id", 1.0, t)
    named = F.lit(None).cast("double")
    for k, v in official.items():
        named = F.when(F.col("area_id") == k, v).otherwise(named)
    sized = f.filter(is_official).withColumn("area", G.polygon_area(F.col("rings"))).withColumn("expected", F.coalesce("official_area_sqm", named))
    off = sized.filter(F.abs(F.col("expected") - F.col("area")) > F.greatest(F.lit(1.0), F.col("expected") * 0.03))
    pairs = O.overlap_pairs(f, [GROUP], "pos", 1.0, t).join(dealt(f.select(GROUP, "pos", "feature_id")), [GROUP, "pos"])
    gone = J.missing_areas(f, list(official), GROUP)
    return (_rows(f.filter(~is_official & ~is_provisional), "KEY_AREA_NOT_OFFICIAL", feature=F.col("feature_id"))
            .unionByName(_rows(f.filter(is_provisional), "KEY_AREA_PROVISIONAL", "minor", F.col("feature_id")))
            .unionByName(_rows(out, "KEY_AREA_OUTSIDE_SITE", feature=F.col("feature_id"), expected="inside site boundary", actual=F.col("outside_area")))
            .unionByName(_rows(off, "KEY_AREA_AREA_MISMATCH", feature=F.col("feature_id"), expected=F.col("expected"), actual=F.col("area")))
            .unionByName(_rows(pairs, "KEY_AREA_OVERLAP", feature=F.col("feature_id"), expected="no overlap", actual=F.col("overlap_area")))
            .unionByName(gone.select(GROUP, F.lit("KEY_AREA_MISSING").alias("check_id"), F.lit("major").alias("severity"), F.lit(None).cast("string").alias("feature_id"),
                                     F.col("missing").alias("expected"), F.lit(None).cast("string").alias("actual"))))


def scope_nesting(scopes: DataFrame, order: Sequence[str], tolerance: float = 1.0, tile: float | None = None) -> DataFrame:
    """Each scope must cover the next: area of the inner one outside the outer one."""
    out = None
    for outer, inner in zip(order, order[1:]):
        a = scopes.filter(F.col("scope_id") == inner).select(GROUP, "scope_id", "rings")
        b = scopes.filter(F.col("scope_id") == outer).select(GROUP, "rings")
        one = O.against(a, b, [GROUP], "scope_id", tile).select(
            GROUP, F.lit(outer).alias("outer_scope"), F.col("scope_id").alias("inner_scope"), "outside_area", (F.col("outside_area") <= tolerance).alias("nested"))
        out = one if out is None else out.unionByName(one)
    return out


def announced_areas(scopes: DataFrame, announced: DataFrame) -> DataFrame:
    """Measured area beside the announced one and its own tolerance."""
    sized = scopes.select(GROUP, "scope_id", G.polygon_area(F.col("rings")).alias("area"))
    return sized.join(announced, "scope_id").select(
        GROUP, "scope_id", "area", "expected", (F.abs(F.col("area") - F.col("expected")) <= F.col("delta")).alias("near"))


def reproduce(metrics: DataFrame, features: DataFrame, slack: float = 100.0) -> DataFrame:
    """Metric against the sum of the measured areas of its layer."""
    sums = features.groupBy(GROUP, "layer").agg(F.sum(G.polygon_area(F.col("rings"))).alias("measured"))
    return metrics.join(sums, [GROUP, "layer"]).select(GROUP, "metric", "value", "measured", (F.abs(F.col("value") - F.col("measured")) <= slack).alias("reproduced"))


def zone_share(site: DataFrame, zone: DataFrame, tile: float | None = None) -> DataFrame:
    """Share of each site inside a zone layer."""
    m = O.against(site.withColumn("__k", F.lit(0)), zone, [GROUP], "__k", tile)
    return m.select(GROUP, (F.col("inside_area") / F.col("area")).alias("share"))


def not_contained(features: DataFrame, site: DataFrame, key: str = "feature_id", tile: float = 256.0) -> DataFrame:
    """Features of any kind that are not inside the united site.

    Points are decided by their place, polygons by their area outside, and lines by all
    of their length: each segment is cut at tile borders and at the edges of the site,
    and the middle of every piece must lie inside.
    """
    kind = F.col("geom_type")
    polys = features.filter(kind.isin("Polygon", "MultiPolygon"))
    areas = O.outside_site(polys, site, [GROUP], key, 1e-6, tile).select(GROUP, key)
    s = O.tiled(site.select(GROUP, "rings"), tile)
    lines = features.filter(kind.isin("LineString", "MultiLineString"))
    v = features.filter(~kind.isin("Polygon", "MultiPolygon", "LineString", "MultiLineString")).select(
        GROUP, key, F.posexplode(F.flatten("rings")).alias("i", "p")).select(GROUP, key, "i", "p.x", "p.y")
    v = v.withColumn("tx", F.floor(F.col("x") / tile).cast("bigint")).withColumn("ty", F.floor(F.col("y") / tile).cast("bigint"))
    hit = v.join(dealt(s), [GROUP, "tx", "ty"]).filter(G.point_in_rings(F.struct("x", "y"), F.col("rings"))).select(GROUP, key, "i").distinct()
    out = v.join(dealt(hit), [GROUP, key, "i"], "left_anti").select(GROUP, key).distinct()
    return areas.unionByName(out).unionByName(lines_leaving(lines, s, key, tile))


def lines_leaving(lines: DataFrame, pieces: DataFrame, key: str, tile: float) -> DataFrame:
    """Lines with a stretch outside the site pieces of its tile."""
    n = lambda r: F.greatest(F.size(r) - 1, F.lit(0))
    steps = F.flatten(F.transform("rings", lambda r: F.zip_with(F.slice(r, 1, n(r)), F.slice(r, 2, n(r)), lambda p, q: F.struct(
        p["x"].alias("ax"), p["y"].alias("ay"), (q["x"] - p["x"]).alias("dx"), (q["y"] - p["y"]).alias("dy")))))
    seg = lines.select(GROUP, key, F.posexplode(steps).alias("i", "e")).select(GROUP, key, "i", "e.*").withColumn(
        "t0", F.lit(0.0)).withColumn("t1", F.lit(1.0))
    for o, d, cell in (("ax", "dx", "tx"), ("ay", "dy", "ty")):
        # Cells along this axis, and the stretch of the segment inside each.
        low, high = F.col(o) + F.col("t0") * F.col(d), F.col(o) + F.col("t1") * F.col(d)
        first = lambda v: F.floor(v / tile).cast("bigint")
        seg = seg.withColumn(cell, F.explode(F.sequence(first(F.least(low, high)), first(F.greatest(low, high)))))
        at = lambda m: (F.col(cell) * tile + m * tile - F.col(o)) / F.nullif(F.col(d), F.lit(0.0))
        seg = seg.withColumn("__a", F.coalesce(F.greatest("t0", F.least(at(0), at(1))), "t0")).withColumn(
            "t1", F.coalesce(F.least("t1", F.greatest(at(0), at(1))), "t1")).withColumn("t0", F.col("__a")).drop("__a")
    held = pieces.groupBy(GROUP, "tx", "ty").agg(F.collect_list("rings").alias("site"))
    both = seg.filter("t0 <= t1").join(dealt(held), [GROUP, "tx", "ty"], "left").withColumn(
        "site", F.coalesce("site", F.array().cast(held.schema["site"].dataType)))

    def cut(p, q):
        sx, sy = q["x"] - p["x"], q["y"] - p["y"]
        den = F.col("dx") * sy - F.col("dy") * sx
        px, py = p["x"] - F.col("ax"), p["y"] - F.col("ay")
        t = (px * sy - py * sx) / F.nullif(den, F.lit(0.0))
        u = (px * F.col("dy") - py * F.col("dx")) / F.nullif(den, F.lit(0.0))
        return F.when(u.between(0, 1) & (t > F.col("t0")) & (t < F.col("t1")), t)
    cuts = F.array_compact(F.flatten(F.transform(F.flatten("site"), lambda r: F.zip_with(
        F.slice(r, 1, n(r)), F.slice(r, 2, n(r)), cut))))
    stops = F.array_sort(F.array_distinct(F.concat(F.array("t0"), cuts, F.array("t1"))))
    middles = both.withColumn("__s", stops).withColumn("__m", F.transform(F.filter(
        F.sequence(F.lit(1), F.size("__s")), lambda k: F.coalesce(F.get("__s", k) - F.get("__s", k - 1) > 1e-9, F.lit(False))),
        lambda k: (F.get("__s", k) + F.get("__s", k - 1)) / 2))
    # A segment of no length is its one point.
    middles = middles.withColumn("__m", F.when((F.col("dx") == 0) & (F.col("dy") == 0), F.array(F.lit(0.0))).otherwise(F.col("__m")))
    lost = F.exists("__m", lambda m: ~F.exists("site", lambda r: G.point_in_rings(
        F.struct((F.col("ax") + m * F.col("dx")).alias("x"), (F.col("ay") + m * F.col("dy")).alias("y")), r)))
    return middles.filter(lost).select(GROUP, key).distinct()


def review(features: DataFrame, metrics: DataFrame, submissions: DataFrame, official: dict[str, float] | None = None,
           tile: float | None = None) -> DataFrame:
    """All spatial issues of all submissions; ``features`` has rings in metres.

    Submissions without a site give one blocking row and nothing else.
    """
    t = tile or O.pick_tile(features.filter(F.col("layer") != "SITE_BOUNDARY"))
    site_all = features.filter("layer = 'SITE_BOUNDARY'").select(GROUP, "rings")
    sited = site_all.select(GROUP).distinct()
    none = submissions.select(GROUP).distinct().join(sited, GROUP, "left_anti")
    f = features.join(sited, GROUP, "left_semi")
    layer = lambda n: f.filter(F.col("layer") == n)
    land, keys = layer("LAND_USE"), layer("KEY_AREA")
    gap = O.coverage_gap(land, site_all, [GROUP], t).join(land.select(GROUP).distinct(), GROUP, "left_semi")
    pairs = O.overlap_pairs(land, [GROUP], "pos", 1.0, t).join(dealt(land.select(GROUP, "pos", "feature_id")), [GROUP, "pos"])
    inner = f.filter(F.col("layer").isin("BUILDING_FOOTPRINT", "GREEN_SPACE", "PUBLIC_SPACE"))
    out = O.outside_site(inner, site_all, [GROUP], "feature_id", None, t)
    computed = A.site_metrics(f, GROUP, t).select(GROUP, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                                                                    for m in ("site_area_sqm", "green_ratio", "public_space_ratio")])))
    recalc = J.compare_metrics(metrics.select(GROUP, "metric", "value", "unit"), computed)
    ranges = metrics.filter((F.col("unit") == "ratio") & ~F.col("value").between(0, 1)).join(sited, GROUP, "left_semi")
    parts = [
        _rows(none, "SITE_BOUNDARY_EMPTY", "blocking"), _rows(sited.join(land, GROUP, "left_anti"), "LAND_USE_EMPTY"),
        _rows(sited.join(keys, GROUP, "left_anti"), "KEY_AREAS_EMPTY"),
        _rows(declared_mismatch(f), "DECLARED_AREA_MISMATCH", feature=F.col("feature_id"), expected=F.col("area"), actual=F.col("area_declared")),
        _rows(gap, "LAND_USE_COVERAGE_GAP", expected=F.col("site_area"), actual=F.col("site_area") - F.col("gap_area")),
        _rows(pairs, "LAND_USE_OVERLAP", feature=F.col("feature_id"), expected="no overlap", actual=F.col("overlap_area")),
        _rows(out, "GEOMETRY_OUTSIDE_SITE", feature=F.col("feature_id"), expected="inside site boundary", actual=F.col("outside_area")),
        _rows(recalc.filter("check_id = 'METRIC_RECALC_MISMATCH'"), "METRIC_RECALC_MISMATCH", feature=F.col("metric"), expected=F.col("expected"), actual=F.col("value")),
        _rows(ranges, "METRIC_RATIO_RANGE", feature=F.col("metric"), expected="0..1", actual=F.col("value")),
        key_area_audit(keys, site_all, official, t)]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result
