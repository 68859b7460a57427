"""Land-permission verdicts: control lines, zones, and their combination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import overlay as O
from ..session import cut_lineage

LINES = ("farmland", "redline", "boundary")
ZONES = ("ecological", "agricultural", "urban")
EPSILON = 1e-6
DOMINANCE = 1e-9

REJECTED = {"farmland": "REJECTED_BASIC_FARMLAND", "redline": "REJECTED_ECOLOGICAL_REDLINE", "boundary": "REJECTED_OUTSIDE_BOUNDARY"}


def slack(area: Column) -> Column:
    """Rounding slack of an overlay area: 1e-6 square metres, or 1e-12 of a large parcel."""
    return F.greatest(F.lit(EPSILON), area * 1e-12)


def measured(parcels: DataFrame, layers: DataFrame, group: str, kind: str, kinds: Sequence[str], tile: float | None = None) -> DataFrame:
    """Area of each parcel, and the part of it inside and outside each kind of layer, in one sweep.

    ``layers`` holds (group, kind, rings).  A kind that a group lacks gives nulls.
    """
    t = tile or O.pick_tile(parcels)
    usable = parcels.filter(F.col("rings").isNotNull())
    present = layers.filter(F.col("rings").isNotNull())
    _, inside = O.inside_areas(usable, present, [group], "parcel_id", [kind], t)
    have = present.groupBy(group).agg(*[F.bool_or(F.col(kind) == k).alias(f"has_{k}") for k in kinds])
    per = inside.groupBy(group, "parcel_id").agg(*[F.sum(F.when(F.col(kind) == k, F.col("inside_area"))).alias(f"in_{k}") for k in kinds])
    size = F.when(F.col("rings").isNotNull(), G.even_odd_area(F.col("rings")))
    base = parcels.select(group, "parcel_id", size.alias("parcel_area"))
    joined = base.join(per, [group, "parcel_id"], "left").join(have, group, "left")
    shown = lambda c, k: F.when(F.coalesce(F.col(f"has_{k}"), F.lit(False)) & F.col("parcel_area").isNotNull(), c)
    part = lambda k: F.coalesce(F.col(f"in_{k}"), F.lit(0.0))
    return joined.select(group, "parcel_id", "parcel_area", *[shown(part(k), k).alias(f"in_{k}") for k in kinds],
                         *[shown(F.greatest(F.col("parcel_area") - part(k), F.lit(0.0)), k).alias(f"out_{k}") for k in kinds])


def inconsistent_lines(lines: DataFrame, group: str, kind: str = "line", tile: float | None = None) -> DataFrame:
    """Groups in which two control lines intersect by more than the slack."""
    t = tile or O.pick_tile(lines.filter(F.col("rings").isNotNull()))
    pieces = O.tiled(lines.filter(F.col("rings").isNotNull()).select(group, kind, "rings"), t).distinct()
    sides = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b"))
                      for i, a in enumerate(LINES) for b in LINES[i + 1:]])
    tagged = pieces.select("*", F.inline(F.filter(sides, lambda s: (s["a"] == F.col(kind)) | (s["b"] == F.col(kind))))).withColumn(
        "side", F.when(F.col(kind) == F.col("a"), 0).otherwise(1)).withColumn("fid", F.xxhash64(F.to_json("rings")))
    both = O.sweep(tagged.select(group, "pair", "tx", "ty", "side", "fid", "rings"), [group, "pair"])
    return both.filter(F.col("both_area") > EPSILON).select(group).distinct()


def three_lines(parcels: DataFrame, lines: DataFrame, group: str = "region", tile: float | None = None) -> DataFrame:
    """Verdict per parcel; the order farmland, redline, boundary is the priority."""
    m = measured(parcels, lines, group, "line", LINES, tile)
    # The lines are far larger than a parcel: they are compared on tiles of their own size.
    bad = inconsistent_lines(lines, group).withColumn("__bad", F.lit(True))
    s = slack(F.col("parcel_area"))
    metric = {"farmland": F.col("in_farmland"), "redline": F.col("in_redline"), "boundary": F.col("out_boundary")}
    verdict = F.when(F.coalesce("__bad", F.lit(False)), "FAIL_CLOSED")
    for k in LINES:
        verdict = verdict.when(metric[k].isNull(), "FAIL_CLOSED").when(metric[k] > s, REJECTED[k])
    joined = m.join(bad, group, "left").withColumn("verdict", verdict.otherwise("ALLOWED"))
    return joined.withColumn("completed", F.col("verdict") != "FAIL_CLOSED").withColumn("evidence", _line_evidence(metric, s)).select(
        group, "parcel_id", F.col("in_farmland").alias("farmland_overlap"), F.col("in_redline").alias("redline_overlap"),
        F.col("out_boundary").alias("outside_boundary"), "verdict", "completed", "evidence")


def _line_evidence(metric: dict[str, Column], s: Column) -> Column:
    """Evidence of the lines judged, up to and including the first that is broken or missing."""
    one = lambda rule, outcome, value: F.struct(F.lit(rule).alias("rule_id"), outcome.alias("outcome"), value.alias("metric"))
    items, go = [F.when(F.coalesce("__bad", F.lit(False)), one("three_lines_inconsistent", F.lit("violation"), F.lit(None).cast("double")))], ~F.coalesce("__bad", F.lit(False))
    for k in LINES:
        broken = metric[k].isNull() | (metric[k] > s)
        items.append(F.when(go, one(k, F.when(broken, "violation").otherwise("compliant"), metric[k])))
        go = go & ~broken
    return F.array_compact(F.array(*items))


def dominant(shares: dict[str, Column]) -> Column:
    """Name of the unique largest share; TIE within 1e-9 or when all are zero; null if any is missing."""
    order = F.sort_array(F.array(*shares.values()), asc=False)
    missing = F.lit(False)
    for c in shares.values():
        missing = missing | c.isNull()
    best = F.array_max(F.array(*[F.struct(c.alias("v"), F.lit(n).alias("n")) for n, c in shares.items()]))["n"]
    return F.when(missing, None).when(order[0] - order[1] <= DOMINANCE, "TIE").otherwise(best)


def zone_shares(parcels: DataFrame, zones: DataFrame, group: str = "region", tile: float | None = None) -> DataFrame:
    m = measured(parcels, zones, group, "zone", ZONES, tile)
    share = lambda k: F.when(F.col("parcel_area") > EPSILON, F.col(f"in_{k}") / F.col("parcel_area")).alias(f"{k}_share")
    return m.select(group, "parcel_id", *[share(k) for k in ZONES])


def three_zones(parcels: DataFrame, zones: DataFrame, group: str = "region", tile: float | None = None) -> DataFrame:
    shares = zone_shares(parcels, zones, group, tile)
    name = dominant({k: F.col(f"{k}_share") for k in ZONES})
    verdict = F.when(name.isNull() | (name == "TIE"), "FAIL_CLOSED").otherwise(F.upper(name))
    return shares.withColumn("verdict", verdict).withColumn("completed", F.col("verdict") != "FAIL_CLOSED")


def land_permission(parcels: DataFrame, lines: DataFrame, zones: DataFrame, group: str = "region", tile: float | None = None) -> DataFrame:
    """Building permission: lines first; zones are measured only for parcels the lines allow."""
    t = tile or O.pick_tile(parcels)
    # One row per parcel, read twice: to pick the parcels that go on, and for the result.
    l = cut_lineage(three_lines(parcels, lines, group, t).select(
        group, "parcel_id", F.col("verdict").alias("line_verdict"), F.col("evidence").alias("line_evidence")))
    passed = parcels.join(l.filter("line_verdict = 'ALLOWED'").select(group, "parcel_id"), [group, "parcel_id"], "left_semi")
    z = three_zones(passed, zones, group, t).select(group, "parcel_id", F.col("verdict").alias("zone_verdict"))
    lv, zv = F.col("line_verdict"), F.col("zone_verdict")
    verdict = (F.when(lv == "FAIL_CLOSED", "FAIL_CLOSED").when(lv != "ALLOWED", "DENIED_BY_LINE")
               .when(F.coalesce(zv, F.lit("FAIL_CLOSED")) == "FAIL_CLOSED", "FAIL_CLOSED")
               .when(zv == "URBAN", "BUILDING_ALLOWED").otherwise("DENIED_BY_ZONE"))
    zone_evidence = F.when(zv.isNotNull(), F.array(F.struct(F.lit("dominant_zone").alias("rule_id"), F.when(
        zv == "URBAN", "compliant").otherwise("violation").alias("outcome"), F.lit(None).cast("double").alias("metric"))))
    return l.join(z, [group, "parcel_id"], "left").select(
        group, "parcel_id", "line_verdict", "zone_verdict", verdict.alias("verdict"), (verdict == "BUILDING_ALLOWED").alias("allowed"),
        "line_evidence", zone_evidence.alias("zone_evidence"))
