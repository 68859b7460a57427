"""Anchor-corrected boundaries and zones vectorised from classified pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators.joins import match_rings
from ..session import cut_lineage


def translate(features: DataFrame, shifts: DataFrame, revert: bool = False, tolerance: float = 1e-3) -> DataFrame:
    """Rigid shift of the listed features.

    Corrected features are left alone (unless reverting); the spherical area may
    drift by at most the tolerance, else the job fails.
    """
    sign = -1.0 if revert else 1.0
    s = shifts.select("feature_id", (F.col("dlon") * sign).alias("__dx"), (F.col("dlat") * sign).alias("__dy"))
    done = F.coalesce("anchor_corrected", F.lit(False))
    due = F.col("__dx").isNotNull() & (F.lit(True) if revert else ~done)
    moved = F.transform("polys", lambda p: G.translate_rings(p, F.col("__dx"), F.col("__dy")))
    both = features.join(s, "feature_id", "left").withColumn("__due", due).withColumn("__new", F.when(F.col("__due"), moved))
    before, after = G.sphere_area(F.col("polys")), G.sphere_area(F.col("__new"))
    drift = F.abs(after - before) / F.greatest(before, F.lit(1e-9))
    held = both.withColumn("area_before", before).withColumn("area_after", after).withColumn("drift", drift)
    held = held.filter(F.assert_true(~F.col("__due") | (F.col("drift") <= tolerance), F.lit("area changed by the shift")).isNull())
    keep = [c for c in features.columns if c not in ("polys", "anchor_corrected")]
    flag = F.when(F.col("__due"), F.lit(not revert)).otherwise(done)
    return held.select(*keep, F.coalesce("__new", "polys").alias("polys"), flag.alias("anchor_corrected"), "area_before", "area_after")


def correct(features: DataFrame, shifts: DataFrame, summary: list[str] | Column, revert: bool = False) -> DataFrame:
    """Shifts the listed features, and the equal parts of the summary features with them.

    ``summary`` lists the summary features or is a condition that holds for them.
    """
    is_sum = summary if isinstance(summary, Column) else F.col("feature_id").isin(summary)
    single = translate(features.filter(~is_sum), shifts, revert)
    done = F.coalesce("anchor_corrected", F.lit(False))
    open_ = features.filter(is_sum & (F.lit(True) if revert else ~done))
    rest = features.filter(is_sum & ~(F.lit(True) if revert else ~done))
    parts = open_.select("feature_id", F.posexplode("polys").alias("part", "poly")).withColumn("ring", F.col("poly")[0])
    zones = features.filter(~is_sum & (F.lit(True) if revert else ~done)).join(shifts.select("feature_id"), "feature_id", "left_semi").select(
        F.col("feature_id").alias("zone_id"), F.col("polys")[0][0].alias("ring"))
    sign = -1.0 if revert else 1.0
    hit = match_rings(parts, zones).select("feature_id", "part", F.col("zone_id")).join(
        shifts.select(F.col("feature_id").alias("zone_id"), "dlon", "dlat"), "zone_id").groupBy("feature_id", "part").agg(
        F.min_by(F.struct("dlon", "dlat"), "zone_id").alias("s"))
    moved = parts.join(hit, ["feature_id", "part"], "left").select("feature_id", "part", F.when(F.col("s").isNotNull(), G.translate_rings(
        F.col("poly"), F.col("s.dlon") * sign, F.col("s.dlat") * sign)).otherwise(F.col("poly")).alias("poly"))
    # A summary feature holds a few parts, so its polygons fit one row.
    joined = moved.groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct("part", "poly"))).alias("p")).select(
        "feature_id", F.transform("p", lambda x: x["poly"]).alias("__polys"))
    cols = single.columns
    whole = open_.join(joined, "feature_id", "left").withColumn("polys", F.coalesce("__polys", "polys")).withColumn("anchor_corrected", F.lit(not revert)).drop("__polys")
    pad = lambda d: d.withColumn("area_before", G.sphere_area(F.col("polys"))).withColumn("area_after", G.sphere_area(F.col("polys"))).select(*cols)
    return single.unionByName(pad(whole)).unionByName(pad(rest.withColumn("anchor_corrected", done)))


# ---- zones from pixels ------------------------------------------------------------------------------

def pixel_runs(px: DataFrame, fig: str = "fig") -> DataFrame:
    """Horizontal runs of equal class: the nodes of the component graph.

    An image row has at most a few thousand pixels, the window stays inside it.
    """
    w = Window.partitionBy(fig, "class", "y").orderBy("x")
    start = F.when(F.col("x") - F.lag("x").over(w) == 1, 0).otherwise(1)
    marked = px.select(fig, "class", "x", "y").distinct().withColumn("__s", start).withColumn(
        "__run", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(fig, "class", "y", "__run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("__run").withColumn(
        "node", F.struct("y", "x0"))


def components(runs: DataFrame, fig: str = "fig") -> DataFrame:
    """Smallest node of each run's 4-connected component.

    Every round takes the smallest label among the neighbours and then jumps to
    the label of that label, so long chains shrink by halves.  Each round is
    checkpointed reliably; the loop ends when no label changes.
    """
    keys = [fig, "class"]
    runs = cut_lineage(runs)
    a = runs.select(*keys, "node", (F.col("y") + 1).alias("y"), "x0", "x1")
    b = runs.select(*keys, F.col("node").alias("other"), "y", F.col("x0").alias("o0"), F.col("x1").alias("o1"))
    touch = a.join(b, [*keys, "y"]).filter((F.col("x0") <= F.col("o1")) & (F.col("o0") <= F.col("x1"))).select(*keys, "node", "other")
    edges = cut_lineage(touch.unionByName(touch.select(*keys, F.col("other").alias("node"), F.col("node").alias("other"))))
    labels = cut_lineage(runs.select(*keys, "node", F.col("node").alias("label")))
    while True:
        near = edges.join(labels.select(*keys, F.col("node").alias("other"), F.col("label").alias("l")), [*keys, "other"]).groupBy(*keys, "node").agg(F.min("l").alias("l"))
        stepped = labels.join(near, [*keys, "node"], "left").select(*keys, "node", "label", F.least("label", "l").alias("best"))
        jump = stepped.select(*keys, F.col("node").alias("best"), F.col("best").alias("far"))
        new = cut_lineage(stepped.join(jump, [*keys, "best"]).select(*keys, "node", F.least("best", "far").alias("label"), (
            F.least("best", "far") != F.col("label")).alias("changed")))
        labels = new.drop("changed")
        if not new.filter("changed").limit(1).count():
            return labels


def zones_from_pixels(px: DataFrame, fig: str = "fig", min_pixels: int = 60, to_lonlat=None) -> DataFrame:
    """Convex hull of each component of at least ``min_pixels`` pixels.

    Only the two ends of a run can be hull points, and of the runs of an image
    row only the outermost, so a component sends two points per image row.
    """
    runs = pixel_runs(px, fig)
    keys = [fig, "class"]
    labelled = runs.join(components(runs, fig), [*keys, "node"])
    size = labelled.groupBy(*keys, "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("pixels")).filter(F.col("pixels") >= min_pixels)
    rows = labelled.join(size, [*keys, "label"]).groupBy(*keys, "label", "pixels", "y").agg(F.min("x0").alias("a"), F.max("x1").alias("b"))
    pt = lambda c: G.pt(F.col(c).cast("double"), F.col("y").cast("double"))
    ends = rows.select(*keys, "label", "pixels", F.explode(F.array(pt("a"), pt("b"))).alias("p"))
    hull = ends.groupBy(*keys, "label", "pixels").agg(F.collect_set("p").alias("ps")).withColumn("ring", G.convex_hull(F.col("ps"))).drop("ps")
    return hull.withColumn("ring", F.transform("ring", to_lonlat)) if to_lonlat else hull


