"""Areas of overlays: a hierarchy of cells first, then a sweep over vertical slabs.

Features are cut to square cells (first to columns, then to rows).  A feature that is
large beside the tile of its layer is cut top down: a cell wholly inside it stays whole,
at its own level, and has an area but no ring; a cell that its border crosses is cut
again by STEP in both directions, down to the tile.  So the number of cells follows the
border of a polygon, not its area.  Whole cells meet smaller ones by the numbers of their
ancestors; only border tiles are swept.  Inside a tile the edges are swept: between two neighbouring event positions no
edges cross, the order of the edges by height is fixed, and a running sum of
"enter" and "leave" gives how many features of each side cover each gap.  Areas
add up over tiles.  Nothing is collected: every step is a join, a window inside
(scope, tile, slab) or a partial sum.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..scale import dealt
from ..session import cut_lineage
from .cells import cut_batches


#: A cell is cut in this many columns and rows; the shift of a cell number to its parent's.
STEP, SHIFT = 4, 2


_BUILT: dict[tuple, Column] = {}


def _built(make: Callable[..., Column], *names) -> Column:
    """``make`` of the named columns, built once in a session: these are large expressions over few names."""
    context = SparkContext._active_spark_context
    key = (id(context), make.__name__, *names)
    if key not in _BUILT:
        _BUILT[key] = make(*[F.col(n) if isinstance(n, str) else n for n in names])
    return _BUILT[key]


def _cut_x(ring: Column, place: Column, size: float) -> Column:
    return G.clip_rings(ring, "x", place * size, (place + 1) * size)


def _cut_y(ring: Column, place: Column, size: float) -> Column:
    return G.clip_rings(ring, "y", place * size, (place + 1) * size)


def _extents(df: DataFrame, rings: str = "rings") -> tuple[float | None, float]:
    """(mean, largest) feature extent."""
    box = df.select(G.bbox(F.col(rings)).alias("b")).select(
        F.greatest(F.col("b.x1") - F.col("b.x0"), F.col("b.y1") - F.col("b.y0")).alias("w"))
    mean, most = box.filter("w > 0").agg(F.avg("w"), F.max("w")).first()
    return mean, most or 0.0


def _tile(mean: float | None) -> float:
    return 2.0 ** math.ceil(math.log2(mean)) if mean else 1.0


def pick_tile(df: DataFrame, rings: str = "rings") -> float:
    """Tile side for a layer: the power of two at or above the mean feature extent.

    One number is read by the driver, so both sides of a later join are cut by
    the same constant however often a stage runs again.
    """
    return _tile(_extents(df, rings)[0])


#: Up to this many tiles a side a layer is cut flat: the hierarchy has more joins, and pays for larger features.
FLAT = STEP ** 2


def _levels(extent: float, tile: float) -> int:
    """Levels above the tile for a feature of this extent: it spans at most five cells of the top one."""
    return math.ceil(math.log(extent / tile, STEP)) - 1 if extent > FLAT * tile else 0


def pick_grid(df: DataFrame, *others: DataFrame, tile: float | None = None) -> tuple[float, int, int]:
    """Tile of a layer, the levels above it that its own features need, and those that all layers need."""
    mean, most = _extents(df)
    size = tile or _tile(mean)
    own = _levels(most, size)
    return size, own, max([own, *(_levels(_extents(o)[1], size) for o in others)])


def _span(low: Column, high: Column, tile: float) -> Column:
    first = F.floor(low / tile).cast("bigint")
    return F.sequence(first, F.greatest(first, (F.ceil(high / tile) - 1).cast("bigint")))


def tiled(df: DataFrame, tile: float, rings: str = "rings", near: DataFrame | None = None,
          on: Sequence[str] = ()) -> DataFrame:
    """One row per feature and tile it touches, rings cut to the tile.

    ``near`` (on..., tx, ty) keeps only the listed tiles; the others are dropped
    before anything is cut.
    """
    keep = [c for c in df.columns if c != rings]
    columns = (df.withColumn("__b", G.bbox(F.col(rings))).filter("__b.x0 IS NOT NULL")
               .select(*keep, F.col(rings).alias("__r"), F.explode(_span(F.col("__b.x0"), F.col("__b.x1"), tile)).alias("tx")))
    if near is not None:
        columns = columns.join(dealt(near.select(*on, "tx").distinct()), [*on, "tx"], "left_semi")
    strips = columns.select(*keep, "tx", _built(_cut_x, "__r", "tx", tile).alias("__r")).filter(F.size("__r") > 0)
    rows = (strips.withColumn("__b", G.bbox(F.col("__r")))
            .select(*keep, "tx", "__r", F.explode(_span(F.col("__b.y0"), F.col("__b.y1"), tile)).alias("ty")))
    if near is not None:
        rows = rows.join(dealt(near.select(*on, "tx", "ty").distinct()), [*on, "tx", "ty"], "left_semi")
    return rows.select(*keep, "tx", "ty", _built(_cut_y, "__r", "ty", tile).alias(rings)).filter(F.size(rings) > 0)


def cover(df: DataFrame, tile: float, levels: int, rings: str = "rings") -> DataFrame:
    """Cells of each feature: (lev, tx, ty, whole) with the cut rings, null for a whole cell.

    A cell of level k has the side ``tile * STEP^k``.  A feature starts at the level of its
    extent, so a layer of small features is cut once.  Cells with a border are of level 0.
    """
    keep = [c for c in df.columns if c != rings]
    box = df.withColumn("__b", G.bbox(F.col(rings))).filter("__b.x0 IS NOT NULL")
    extent = F.greatest(F.col("__b.x1") - F.col("__b.x0"), F.col("__b.y1") - F.col("__b.y0"), F.lit(tile))
    start = F.least(F.greatest(F.ceil(F.log(extent / tile) / math.log(STEP)) - 1, F.lit(0)), F.lit(levels)).cast("int")
    rows = box.select(*keep, start.alias("__start"), F.col(rings).alias("__r"))
    # Pieces of a feature that is hardly larger than a tile go to the sweep in any case.
    small = tiled(rows.filter("__start = 0").drop("__start"), tile, "__r").select(
        *keep, F.lit(0).alias("lev"), "tx", "ty", F.lit(False).alias("whole"), "__r")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema]
    large = rows.filter("__start > 0").mapInArrow(cut_batches(tile, STEP), ", ".join(
        [*kept, "lev int, tx bigint, ty bigint, whole boolean, __r array<array<struct<x:double,y:double>>>"]))
    return small.unionByName(large).withColumnRenamed("__r", rings)


def _side(tile: float) -> Column:
    return F.lit(tile) * F.pow(F.lit(float(STEP)), F.col("lev"))


def _ancestors(cells: DataFrame, levels: int, strict: bool = False) -> DataFrame:
    """Each row once for itself (unless ``strict``) and each cell above it: columns up, ux, uy."""
    first = F.col("lev") + (1 if strict else 0)
    ups = F.when(first <= levels, F.sequence(first, F.lit(levels))).otherwise(F.array().cast("array<int>"))
    shifted = lambda c: F.expr(f"shiftright({c}, {SHIFT} * (up - lev))")
    return cells.withColumn("up", F.explode(ups)).withColumn("ux", shifted("tx")).withColumn("uy", shifted("ty"))


def _whole(cells: DataFrame, group: Sequence[str]) -> DataFrame:
    return cells.filter("whole").select(*group, "lev", "tx", "ty").distinct()


def _beneath(cells: DataFrame, whole: DataFrame, group: Sequence[str], levels: int, strict: bool = False) -> DataFrame:
    """The cells (group..., lev, tx, ty) that are, or lie in, a whole cell."""
    own = _ancestors(cells.select(*group, "lev", "tx", "ty").distinct(), levels, strict)
    above = whole.select(*group, F.col("lev").alias("up"), F.col("tx").alias("ux"), F.col("ty").alias("uy"))
    return own.join(dealt(above), [*group, "up", "ux", "uy"], "left_semi").select(*group, "lev", "tx", "ty").distinct()


def _united(cells: DataFrame, group: Sequence[str], levels: int) -> tuple[DataFrame, DataFrame]:
    """Union of a layer: (largest whole cells, border pieces that no whole cell covers)."""
    key = [*group, "lev", "tx", "ty"]
    whole = _whole(cells, group)
    top = whole.join(dealt(_beneath(whole, whole, group, levels, strict=True)), key, "left_anti")
    border = cells.filter("NOT whole")
    return top, border.join(dealt(_beneath(border, top, group, levels)), key, "left_anti")


def _cell(scope: Sequence[str]) -> list[str]:
    return [*scope, *(c for c in ("tx", "ty") if c not in scope)]


def _edges(pieces: DataFrame, scope: Sequence[str]) -> DataFrame:
    return pieces.select(*_cell(scope), "side", "fid", F.inline(G.edges(F.col("rings"))))


def sweep(pieces: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Areas per scope from tiled pieces (scope..., tx, ty, side 0/1, fid, rings).

    Columns: a_area (side 0 covered), b_area, a2_area (side 0 covered at least
    twice), both_area, a_only_area, b_only_area.
    """
    cell = _cell(scope)
    # Read four times below: written once to the checkpoint folder instead of cut again.
    e = cut_lineage(_edges(pieces, scope))
    f = e.select(*cell, *[F.col(c).alias(f"f_{c}") for c in ("x1", "y1", "x2", "y2")])
    left = F.struct(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    right = F.struct(*[F.col(f"f_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    meet = ((F.col("f_x1") < F.col("x2")) & (F.col("f_x2") > F.col("x1"))
            & (F.least("f_y1", "f_y2") < F.greatest("y1", "y2")) & (F.greatest("f_y1", "f_y2") > F.least("y1", "y2")))
    # Each crossing is needed once: the edge with the smaller end comes first.
    once = F.struct("x1", "y1", "x2", "y2") < F.struct("f_x1", "f_y1", "f_x2", "f_y2")
    cross = e.select(*cell, "x1", "y1", "x2", "y2").distinct().join(dealt(f.distinct()), cell).filter(meet & once).select(
        *cell, G.crossing_x(left, right).alias("x")).filter("x IS NOT NULL")
    events = e.select(*cell, F.explode(F.array("x1", "x2")).alias("x")).unionByName(cross).distinct()
    slabs = events.withColumn("r", F.lead("x").over(Window.partitionBy(*cell).orderBy("x"))).filter(
        "r IS NOT NULL").withColumnRenamed("x", "l")
    mid = (F.col("l") + F.col("r")) / 2
    height = F.col("y1") + (F.col("y2") - F.col("y1")) * (mid - F.col("x1")) / (F.col("x2") - F.col("x1"))
    active = e.join(dealt(slabs), cell).filter((F.col("x1") <= F.col("l")) & (F.col("x2") >= F.col("r"))).select(
        *cell, "l", "r", "side", "fid", height.alias("y"))
    slab = [*cell, "l"]
    nth = F.row_number().over(Window.partitionBy(*slab, "side", "fid").orderBy("y"))
    stepped = active.withColumn("d", F.when(nth % 2 == 1, 1).otherwise(-1))
    walk = Window.partitionBy(*slab).orderBy("y", "side", "fid", "d")
    upto = walk.rowsBetween(Window.unboundedPreceding, 0)
    level = stepped.select(
        *scope, (F.col("r") - F.col("l")).alias("w"), (F.lead("y").over(walk) - F.col("y")).alias("h"),
        F.sum(F.when(F.col("side") == 0, F.col("d")).otherwise(0)).over(upto).alias("a"),
        F.sum(F.when(F.col("side") == 1, F.col("d")).otherwise(0)).over(upto).alias("b")).filter("h IS NOT NULL")
    area = lambda cond: F.sum(F.when(cond, F.col("w") * F.col("h")).otherwise(0.0))
    a, b = F.col("a"), F.col("b")
    return level.groupBy(*scope).agg(
        area(a > 0).alias("a_area"), area(b > 0).alias("b_area"), area(a > 1).alias("a2_area"),
        area((a > 0) & (b > 0)).alias("both_area"), area((a > 0) & (b <= 0)).alias("a_only_area"),
        area((a <= 0) & (b > 0)).alias("b_only_area"))


def union_area(features: DataFrame, group: Sequence[str], tile: float | None = None) -> DataFrame:
    """Area covered by the features of each group.  Copies count once, before the sweep."""
    base = features.select(*group, "rings")
    t, _, levels = pick_grid(base, tile=tile)
    if levels:
        top, border = _united(cut_lineage(cover(base, t, levels)), group, levels)
        inner = top.groupBy(*group).agg(F.sum(F.pow(_side(t), 2)).alias("v"))
        pieces = border.select(*group, "tx", "ty", "rings").distinct()
    else:
        inner, pieces = None, tiled(base, t).distinct()
    pieces = pieces.withColumn("side", F.lit(0)).withColumn("fid", F.xxhash64(F.to_json("rings")))
    swept = sweep(pieces, group).select(*group, F.col("a_area").alias("v"))
    both = swept if inner is None else swept.unionByName(inner)
    return both.groupBy(*group).agg(F.sum("v").alias("union_area")) if inner is not None else swept.withColumnRenamed("v", "union_area")


def coverage(layer: DataFrame, site: DataFrame, group: Sequence[str], tile: float | None = None) -> DataFrame:
    """Site area, layer union, gap and overhang of each group."""
    t, _, levels = pick_grid(layer.select("rings"), site.select("rings"), tile=tile)
    if not levels:
        cut = lambda df, side: tiled(df.select(*group, "rings"), t).distinct().withColumn("side", F.lit(side))
        pieces = cut(layer, 0).unionByName(cut(site, 1)).withColumn("fid", F.xxhash64(F.to_json("rings")))
        return sweep(pieces, group).select(
            *group, F.col("a_area").alias("layer_area"), F.col("b_area").alias("site_area"),
            F.col("b_only_area").alias("gap_area"), F.col("a_only_area").alias("outside_area"), F.col("both_area").alias("covered_area"))
    (a, a_border), (b, b_border) = (_united(cut_lineage(cover(df.select(*group, "rings"), t, levels)), group, levels) for df in (layer, site))
    cell = [*group, "lev", "tx", "ty"]
    under = lambda border, other: border.join(dealt(_beneath(border, other, group, levels).withColumn("under", F.lit(True))), cell, "left")
    pieces = under(a_border, b).withColumn("side", F.lit(0)).unionByName(under(b_border, a).withColumn("side", F.lit(1)))
    pieces = pieces.select(*group, F.coalesce("under", F.lit(False)).alias("under"), "tx", "ty", "side", "rings").distinct()
    swept = sweep(pieces.withColumn("fid", F.xxhash64(F.to_json("rings"))), [*group, "under"])
    area = F.pow(_side(t), 2)
    zero = F.lit(0.0)
    # Of two whole cells in each other the smaller one is common.
    inside = lambda one, two, strict: _beneath(one, two, group, levels, strict)
    parts = [a.select(*group, area.alias("layer_area"), zero.alias("site_area"), zero.alias("covered_area")),
             b.select(*group, zero.alias("layer_area"), area.alias("site_area"), zero.alias("covered_area")),
             inside(a, b, False).unionByName(inside(b, a, True)).select(
                 *group, zero.alias("layer_area"), zero.alias("site_area"), area.alias("covered_area")),
             swept.select(*group, F.col("a_area").alias("layer_area"), F.col("b_area").alias("site_area"),
                          F.when(F.col("under"), F.col("a_area") + F.col("b_area")).otherwise(F.col("both_area")).alias("covered_area"))]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    total = total.groupBy(*group).agg(*[F.sum(c).alias(c) for c in ("layer_area", "site_area", "covered_area")])
    return total.select(*group, "layer_area", "site_area", F.greatest(F.col("site_area") - F.col("covered_area"), zero).alias("gap_area"),
                        F.greatest(F.col("layer_area") - F.col("covered_area"), zero).alias("outside_area"), "covered_area")


def _border_areas(a: DataFrame, b: DataFrame, group: Sequence[str], key: str, kind: Sequence[str]) -> DataFrame:
    """Common area of pieces of features and the united pieces of the other layer in the same tile.

    With one piece of the other layer it is measured in the row; tiles in which several
    pieces may cover each other go through the sweep.
    """
    cell = [*group, "tx", "ty"]
    counted = b.groupBy(*cell, *kind).agg(F.count(F.lit(1)).alias("__n"))
    alone = b.join(dealt(counted.filter("__n = 1").drop("__n")), [*cell, *kind], "left_semi")
    crowd = b.join(dealt(counted.filter("__n > 1").drop("__n")), [*cell, *kind], "left_semi")
    direct = a.join(dealt(alone.withColumnRenamed("rings", "__o")), cell).select(
        *group, key, *kind, _built(G.intersection_area, "rings", "__o").alias("v"))
    spots = crowd.select(*cell, *kind).distinct()
    first = a.join(dealt(spots), cell).withColumn("side", F.lit(0))
    second = a.select(*cell, key).join(dealt(crowd), cell).withColumn("side", F.lit(1))
    pieces = first.unionByName(second).withColumn("fid", F.xxhash64(F.to_json("rings")))
    swept = sweep(pieces, [*group, key, *kind]).select(*group, key, *kind, F.col("both_area").alias("v"))
    return direct.unionByName(swept)


def _in_whole_cells(a: DataFrame, top: DataFrame, border: DataFrame, group: Sequence[str], key: str, kind: Sequence[str],
                    tile: float, levels: int) -> tuple[DataFrame, DataFrame]:
    """Areas of whole cells, and of united border pieces, of the other layer in whole cells of a feature."""
    out, place = [*group, key, *kind], [*group, "up", "ux", "uy"]
    held_by = a.filter("whole")
    whole = held_by.select(*group, key, "lev", "tx", "ty").withColumnsRenamed({"lev": "up", "tx": "ux", "ty": "uy"})
    above = _ancestors(top, levels, strict=True).join(dealt(whole), place).select(*out, F.pow(_side(tile), 2).alias("v"))
    held = border.join(dealt(_beneath(border, held_by, group, levels)), [*group, "lev", "tx", "ty"], "left_semi")
    united = sweep(held.select(*group, *kind, "tx", "ty", "rings").distinct().withColumn("side", F.lit(0)).withColumn(
        "fid", F.xxhash64(F.to_json("rings"))), [*group, *kind, "tx", "ty"])
    inner = _ancestors(united.select(*group, *kind, F.lit(0).alias("lev"), "tx", "ty", "a_area"), levels).join(
        dealt(whole), place).select(*out, F.col("a_area").alias("v"))
    return above, inner


def inside_areas(features: DataFrame, other: DataFrame, group: Sequence[str], key: str, kind: Sequence[str] = (),
                 tile: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(area per feature, area per feature inside the union of the other layer and kind)."""
    t, own, levels = pick_grid(features.select("rings"), other.select("rings"), tile=tile)
    size = _built(G.even_odd_area, "rings")
    if not levels:
        # Only pieces of the other layer in tiles of a feature are cut.
        a = cut_lineage(tiled(features.select(*group, key, "rings"), t))
        b = cut_lineage(tiled(other.select(*group, *kind, "rings"), t, near=a, on=group).distinct())
        areas = a.groupBy(*group, key).agg(F.sum(size).alias("area"))
        common = _border_areas(a, b, group, key, kind)
        return areas, common.groupBy(*group, key, *kind).agg(F.sum("v").alias("inside_area"))
    a = cut_lineage(cover(features.select(*group, key, "rings"), t, levels).withColumn(
        "size", F.when(F.col("whole"), F.pow(_side(t), 2)).otherwise(size)))
    top, border = _united(cut_lineage(cover(other.select(*group, *kind, "rings"), t, levels)), [*group, *kind], levels)
    areas = a.groupBy(*group, key).agg(F.sum("size").alias("area"))
    place = [*group, "up", "ux", "uy"]
    named = lambda df: df.withColumnsRenamed({"lev": "up", "tx": "ux", "ty": "uy"})
    out = [*group, key, *kind]
    small = a.drop("rings", "whole")
    beneath = _ancestors(small, levels).join(dealt(named(top)), place).select(*out, F.col("size").alias("v"))
    edge = _border_areas(a.filter("NOT whole").select(*group, key, "tx", "ty", "rings"),
                         border.select(*group, *kind, "tx", "ty", "rings").distinct(), group, key, kind)
    common = beneath.unionByName(edge)
    if own:
        for part in _in_whole_cells(a, top, border, group, key, kind, t, levels):
            common = common.unionByName(part)
    return areas, common.groupBy(*out).agg(F.sum("v").alias("inside_area"))


def against(features: DataFrame, other: DataFrame, group: Sequence[str], key: str, tile: float | None = None) -> DataFrame:
    """Area of each feature inside and outside the union of the other layer of its group."""
    areas, inside = inside_areas(features, other, group, key, (), tile)
    both = areas.filter("area > 0").join(dealt(inside), [*group, key], "left").withColumn("inside_area", F.coalesce("inside_area", F.lit(0.0)))
    return both.select(*group, key, "area", "inside_area", F.greatest(F.col("area") - F.col("inside_area"), F.lit(0.0)).alias("outside_area"))


def _boxes(df: DataFrame, tile: float) -> DataFrame:
    b = df.withColumn("__b", G.bbox(F.col("rings"))).filter("__b.x0 IS NOT NULL")
    return b.withColumn("tx", F.explode(_span(F.col("__b.x0"), F.col("__b.x1"), tile))).withColumn(
        "ty", F.explode(_span(F.col("__b.y0"), F.col("__b.y1"), tile)))


def overlap_pairs(features: DataFrame, group: Sequence[str], pos: str = "pos", tolerance: float = 1.0,
                  tile: float | None = None) -> DataFrame:
    """Pairs of features of a group whose common area exceeds the tolerance.

    Features meet only in tiles they share, and a pair is measured in the one
    tile that holds the lower left corner of its common box.
    """
    base = features.select(*group, pos, "rings")
    t = tile or pick_tile(base)
    a = _boxes(base, t)
    b = a.select(*group, "tx", "ty", F.col(pos).alias("other_pos"), F.col("rings").alias("__or"), F.col("__b").alias("__ob"))
    x, y = F.greatest(F.col("__b.x0"), F.col("__ob.x0")), F.greatest(F.col("__b.y0"), F.col("__ob.y0"))
    near = ((F.col(pos) < F.col("other_pos")) & (x < F.least(F.col("__b.x1"), F.col("__ob.x1")))
            & (y < F.least(F.col("__b.y1"), F.col("__ob.y1")))
            & (F.floor(x / t) == F.col("tx")) & (F.floor(y / t) == F.col("ty")))
    pairs = a.join(dealt(b), [*group, "tx", "ty"]).filter(near)
    return pairs.select(*group, pos, "other_pos", _built(G.intersection_area, "rings", "__or").alias("overlap_area")).filter(
        F.col("overlap_area") > tolerance)


def outside_site(features: DataFrame, site: DataFrame, group: Sequence[str], key: str = "pos",
                 tolerance: float | None = None, tile: float | None = None) -> DataFrame:
    """Features reaching outside the site by more than max(1, 1e-4 of the site)."""
    measured = against(features, site, group, key, tile)
    if tolerance is not None:
        return measured.filter(F.col("outside_area") > tolerance)
    sites = union_area(site, group, tile).withColumnRenamed("union_area", "site_area")
    allowed = F.greatest(F.lit(1.0), F.col("site_area") * 1e-4)
    return measured.join(sites, list(group)).filter(F.col("outside_area") > allowed).drop("site_area")


def coverage_gap(layer: DataFrame, site: DataFrame, group: Sequence[str], tile: float | None = None) -> DataFrame:
    allowed = F.greatest(F.lit(1.0), F.col("site_area") * 1e-4)
    return coverage(layer, site, group, tile).filter(F.col("gap_area") > allowed)


def topology_report(layer: DataFrame, site: DataFrame, group: Sequence[str], pos: str = "pos",
                    tile: float | None = None) -> DataFrame:
    cover = coverage(layer, site, group, tile)
    pairs = overlap_pairs(layer, group, pos, 0.0, tile).groupBy(*group).agg(F.sum("overlap_area").alias("overlap_area"))
    return cover.join(pairs, list(group), "left").select(
        *group, F.col("layer_area").alias("union_area"), "site_area",
        (F.col("site_area") - F.col("layer_area")).alias("gap_area"), F.coalesce("overlap_area", F.lit(0.0)).alias("overlap_area"))


def self_crossing(features: DataFrame, keys: Sequence[str], cell: float | None = None) -> DataFrame:
    """Features whose edges cross, run along each other, or touch inside one ring.

    Edges that follow each other may share their common vertex, and two rings may meet
    in single points; everything else that edges have in common is a fault.  Edges meet
    only in grid cells they share, so a polygon of many vertices is checked by many tasks.
    """
    size = cell or pick_tile(features)
    no_repeats = F.transform("rings", lambda r: F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, i - 1))))

    def of_ring(r, ring):
        last = F.size(r) - 2
        return F.transform(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(
            ring.alias("ring"), k.alias("k"), last.alias("last"), F.get(r, k)["x"].alias("ax"), F.get(r, k)["y"].alias("ay"),
            F.get(r, k + 1)["x"].alias("bx"), F.get(r, k + 1)["y"].alias("by")))
    e = features.select(*keys, no_repeats.alias("rings")).select(*keys, F.inline(F.flatten(F.transform("rings", of_ring))))
    # Cells are closed here: edges that touch on a cell border must meet.
    cells = lambda p, q: F.explode(F.sequence(
        F.floor(F.least(p, q) / size).cast("bigint"), F.floor(F.greatest(p, q) / size).cast("bigint")))
    e = e.withColumn("cx", cells("ax", "bx")).withColumn("cy", cells("ay", "by"))
    f = e.select(*keys, "cx", "cy", *[F.col(c).alias("f" + c) for c in ("ring", "k", "ax", "ay", "bx", "by")])

    def turn(o, p, q):
        (ox, oy), (px, py), (qx, qy) = o, p, q
        return F.signum((F.col(px) - F.col(ox)) * (F.col(qy) - F.col(oy)) - (F.col(py) - F.col(oy)) * (F.col(qx) - F.col(ox)))

    def within(q, o, p):
        return (F.col(q[0]).between(F.least(o[0], p[0]), F.greatest(o[0], p[0]))
                & F.col(q[1]).between(F.least(o[1], p[1]), F.greatest(o[1], p[1])))
    a, b, c, d = ("ax", "ay"), ("bx", "by"), ("fax", "fay"), ("fbx", "fby")
    both = e.join(dealt(f), [*keys, "cx", "cy"]).filter((F.col("ring") < F.col("fring")) | (F.col("ring") == F.col("fring")) & (F.col("k") < F.col("fk")))
    both = both.select("*", turn(a, b, c).alias("t1"), turn(a, b, d).alias("t2"), turn(c, d, a).alias("t3"), turn(c, d, b).alias("t4"))
    crossing = (F.col("t1") * F.col("t2") < 0) & (F.col("t3") * F.col("t4") < 0)
    shared = lambda i: (F.least(F.greatest(a[i], b[i]), F.greatest(c[i], d[i]))
                        > F.greatest(F.least(a[i], b[i]), F.least(c[i], d[i])))
    along = (F.col("t1") == 0) & (F.col("t2") == 0) & (shared(0) | shared(1))
    next_to = (F.col("fk") == F.col("k") + 1) | (F.col("k") == 0) & (F.col("fk") == F.col("last"))
    meets = ((F.col("t1") == 0) & within(c, a, b) | (F.col("t2") == 0) & within(d, a, b)
             | (F.col("t3") == 0) & within(a, c, d) | (F.col("t4") == 0) & within(b, c, d))
    touching = (F.col("ring") == F.col("fring")) & ~next_to & meets
    return both.filter(crossing | along | touching).select(*keys).distinct()


#: A zone of at most so many points and STEP tiles a side is filed whole in its tiles: that is cheaper than to cut it.
FEW = 64


def points_in_zones(points: DataFrame, zones: DataFrame, tile: float) -> DataFrame:
    """Zone of each point: points meet whole cells, border pieces and small zones; only the last two are tested."""
    box, count = G.bbox(F.col("rings")), F.size(F.flatten("rings"))
    extent = F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"])
    most, longest = zones.agg(F.max(extent), F.max(count)).first()
    levels = _levels(most or 0.0, tile)
    at = lambda c: F.floor(F.col(c) / tile).cast("bigint")
    p = _ancestors(points.withColumn("lev", F.lit(0)).withColumn("tx", at("x")).withColumn("ty", at("y")), levels)
    small = F.coalesce((extent <= STEP * tile) & (count <= FEW), F.lit(False))
    uncut = (most or 0.0) <= STEP * tile and (longest or 0) <= FEW
    z = _boxes(zones if uncut else zones.filter(small), tile).withColumns({"lev": F.lit(0), "whole": F.lit(False)})
    if not uncut:
        z = z.unionByName(cover(zones.filter(~small), tile, levels), allowMissingColumns=True)
    z = z.withColumnsRenamed({"lev": "up", "tx": "ux", "ty": "uy"})
    boxed = F.col("__b").isNull() | F.col("x").between(F.col("__b.x0"), F.col("__b.x1")) & F.col("y").between(F.col("__b.y0"), F.col("__b.y1"))
    inside = boxed & (F.col("whole") | G.point_in_rings(F.struct("x", "y"), F.col("rings")))
    return p.join(dealt(z), ["up", "ux", "uy"]).filter(inside).drop("lev", "tx", "ty", "up", "ux", "uy", "whole", "rings", "__b")
