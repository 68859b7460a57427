"""Geometry and overlay queries."""

from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import overlay as O
from . import bindings as B
from .registry import query

A = f"(SELECT * FROM {B.FEATURES})"
IX = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
G2 = "submission, layer"


def rects(t):
    return B.with_rings(B.features(t))


def site_boxes(t):
    """One square site per brand."""
    s = t.part.groupBy(F.col("p_brand").alias("submission")).agg(F.max("p_size").alias("m"))
    lo, hi = F.lit(3.0), (F.col("m") * 4 + 57.5).cast("double")
    return s.select("submission", B.box_rings(lo, lo, hi, hi).alias("rings"))


SITE = "(SELECT p_brand AS submission, 3.0::DOUBLE AS x0, 3.0::DOUBLE AS y0, max(p_size) * 4 + 57.5::DOUBLE AS x1, max(p_size) * 4 + 57.5::DOUBLE AS y1 FROM part GROUP BY 1)"

# Union of boxes by coordinate compression, per group.
def sql_union(source, group, value="area"):
    return f"""(WITH f AS (SELECT * FROM {source}), xs AS (SELECT {group}, x, lead(x) OVER (PARTITION BY {group} ORDER BY x) AS xr FROM
      (SELECT {group}, x0 AS x FROM f UNION SELECT {group}, x1 FROM f)),
      s AS (SELECT {group}, x, xr - x AS w, y0, y1, max(y1) OVER (PARTITION BY {group}, x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
        FROM xs JOIN f USING ({group}) WHERE xr IS NOT NULL AND f.x0 <= x AND f.x1 >= xr)
      SELECT {group}, sum(w * greatest(0, y1 - greatest(y0, coalesce(top, y0)))) AS {value} FROM s GROUP BY ALL)"""


@query("ring_extraction", "X1", "SELECT p_partkey, (1 + p_size % 2)::INTEGER AS polygons, (1 + p_size % 2)::INTEGER * 5 AS points FROM part")
def _(t):
    ring = F.format_string("[[%d,0,9],[%d,1,9],[3,2,9],[3,1,9],[%d,0,9]]", "p_partkey", "p_partkey", "p_partkey")
    poly = F.concat(F.lit('{"type":"Polygon","coordinates":['), ring, F.lit("]}"))
    multi = F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), ring, F.lit("],["), ring, F.lit("]]}"))
    polys = G.rings_from_geojson(F.when(F.col("p_size") % 2 == 0, poly).otherwise(multi))
    return t.part.select("p_partkey", F.size(polys).alias("polygons"), F.size(F.flatten(F.flatten(polys))).alias("points"))


N = "(1.0/298.257222101)/(2-1.0/298.257222101)"
PROJ = f"""(SELECT *, {N} AS n, sqrt((1.0/298.257222101)*(2-1.0/298.257222101)) AS e, radians(lon - 117) AS lam, sin(radians(lat)) AS s FROM {B.POINTS})"""
PROJ2 = f"(SELECT *, sinh(atanh(s) - e * atanh(e * s)) AS t FROM {PROJ})"
PROJ3 = f"""(SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta, 6378137.0/(1+n)*(1+n*n/4+n*n*n*n/64) AS a,
    n/2-2*n*n/3+5*n*n*n/16 AS a1, 13*n*n/48-3*n*n*n/5 AS a2, 61*n*n*n/240 AS a3 FROM {PROJ2})"""
PROJECTED = f"""(SELECT *, 500000 + a*(eta + a1*cos(2*xi)*sinh(2*eta) + a2*cos(4*xi)*sinh(4*eta) + a3*cos(6*xi)*sinh(6*eta)) AS px,
    a*(xi + a1*sin(2*xi)*cosh(2*eta) + a2*sin(4*xi)*cosh(4*eta) + a3*sin(6*xi)*cosh(6*eta)) AS py FROM {PROJ3})"""


@query("project_points", "X2", f"SELECT point_id, round(px, 4) AS x, round(py, 4) AS y FROM {PROJECTED}")
def _(t):
    p = B.points(t).select("point_id", F.inline(F.array(G.project(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))))))
    return p.select("point_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("planar_area", "X3", f"SELECT pos, (x1-x0)*(y1-y0) - (CASE WHEN size % 2 = 0 THEN 4 ELSE 0 END) AS area FROM {A}")
def _(t):
    x, y = F.col("x0") + 1, F.col("y0") + 1
    hole = F.when(F.col("size") % 2 == 0, B.box_rings(x, y, x + 2, y + 2)).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>"))
    return rects(t).select("pos", G.area_m2(F.array(F.concat("rings", hole))).alias("area"))


@query("union_area", "X4", f"SELECT submission, layer, area AS union_area FROM {sql_union(A, G2)}")
def _(t):
    return O.union_area(rects(t), ["submission", "layer"])


PAIRS = f"(SELECT a.submission, a.layer, a.pos, b.pos AS other_pos, {IX} AS overlap_area FROM {A} a JOIN {A} b ON a.submission = b.submission AND a.layer = b.layer AND a.pos < b.pos)"


@query("pair_overlap_area", "X5", f"SELECT pos, other_pos, overlap_area FROM {PAIRS} WHERE overlap_area > 0")
def _(t):
    return O.overlap_pairs(rects(t), ["submission", "layer"], tolerance=0.0).select("pos", "other_pos", "overlap_area")


@query("overlap_pairs", "X8", f"SELECT submission, layer, pos, other_pos, overlap_area FROM {PAIRS} WHERE overlap_area > 1")
def _(t):
    return O.overlap_pairs(rects(t), ["submission", "layer"])


# Rotated squares: side s turned by 45 degrees over an upright square of the same centre.
@query("rotated_overlap_area", "X5", "SELECT p_partkey, round(s*s*2*(sqrt(2)-1), 6) AS area FROM (SELECT p_partkey, 2.0 + p_size AS s FROM part)")
def _(t):
    s = F.col("p_size") + 2.0
    cx, cy, h, d = F.col("p_partkey") * 1.5, F.col("p_partkey") * 0.5, s / 2, s / (2 ** 0.5)
    dia = F.array(F.array(G.pt(cx + d, cy), G.pt(cx, cy + d), G.pt(cx - d, cy), G.pt(cx, cy - d), G.pt(cx + d, cy)))
    return t.part.select("p_partkey", F.round(G.intersection_area(B.box_rings(cx - h, cy - h, cx + h, cy + h), dia), 6).alias("area"))


INSIDE = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
AGAINST = f"(SELECT a.submission, a.pos, (a.x1-a.x0)*(a.y1-a.y0) AS area, {INSIDE} AS inside_area FROM {A} a JOIN {SITE} b USING (submission))"


@query("outside_area", "X6", f"SELECT submission, pos, area, inside_area, area - inside_area AS outside_area FROM {AGAINST}")
def _(t):
    return O.against(rects(t), site_boxes(t), ["submission"], "pos")


@query("outside_features", "X9", f"""SELECT a.submission, pos, area, inside_area, area - inside_area AS outside_area FROM {AGAINST} a JOIN {SITE} s USING (submission)
    WHERE area - inside_area > greatest(1, (s.x1 - s.x0) * (s.y1 - s.y0) * 1e-4)""")
def _(t):
    return O.outside_site(rects(t), site_boxes(t), ["submission"])


CLIPPED = f"(SELECT a.submission, greatest(a.x0, b.x0) AS x0, least(a.x1, b.x1) AS x1, greatest(a.y0, b.y0) AS y0, least(a.y1, b.y1) AS y1 FROM {A} a JOIN {SITE} b USING (submission) WHERE a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0)"


@query("coverage_gap", "X7", f"""SELECT s.submission, l.area AS layer_area, (x1-x0)*(y1-y0) AS site_area, (x1-x0)*(y1-y0) - coalesce(c.area, 0) AS gap_area,
    l.area - coalesce(c.area, 0) AS outside_area, coalesce(c.area, 0) AS covered_area FROM {SITE} s JOIN {sql_union(A, 'submission')} l USING (submission) LEFT JOIN {sql_union(CLIPPED, 'submission')} c USING (submission)""")
def _(t):
    return O.coverage_gap(rects(t), site_boxes(t), ["submission"])


@query("topology_report", "X17", f"""SELECT s.submission, l.area AS union_area, (x1-x0)*(y1-y0) AS site_area, (x1-x0)*(y1-y0) - l.area AS gap_area, coalesce(p.o, 0) AS overlap_area
    FROM {SITE} s JOIN {sql_union(A, 'submission')} l USING (submission) LEFT JOIN (SELECT a.submission, sum({IX}) AS o FROM {A} a JOIN {A} b ON a.submission = b.submission AND a.pos < b.pos GROUP BY 1) p USING (submission)""")
def _(t):
    return O.topology_report(rects(t), site_boxes(t), ["submission"])


@query("self_crossing", "X10", "SELECT p_partkey FROM part WHERE p_size % 3 = 0")
def _(t):
    x, y = F.col("p_partkey") * 10.0, F.col("p_size") * 1.0
    bow = F.array(F.array(G.pt(x, y), G.pt(x + 5, y + 5), G.pt(x + 5, y), G.pt(x, y + 4), G.pt(x, y)))
    return O.self_crossing(t.part.select("p_partkey", F.when(F.col("p_size") % 3 == 0, bow).otherwise(
        B.box_rings(x, y, x + 5, y + 5)).alias("rings")), ["p_partkey"])


@query("point_in_polygon", "X13", f"""SELECT p.point_id, f.pos FROM (SELECT point_id, point_id % 400 + 0.25 AS x, point_id % 490 + 0.25 AS y FROM {B.POINTS}) p
    JOIN {A} f ON x > x0 AND x < x1 AND y > y0 AND y < y1""")
def _(t):
    p = B.points(t).select("point_id", (F.col("point_id") % 400 + 0.25).alias("x"), (F.col("point_id") % 490 + 0.25).alias("y"))
    return O.points_in_zones(p, rects(t).select("pos", "rings"), 16.0).select("point_id", "pos")


@query("spherical_area", "X14", f"""SELECT point_id, round(abs(sum((radians(lon2) - radians(lon1)) * (2 + sin(radians(la1)) + sin(radians(la2))))) * 6371000.0 * 6371000.0 / 2, 0) AS area FROM
    (SELECT point_id, unnest([lon, lon + 0.001, lon + 0.001, lon]) AS lon1, unnest([lon + 0.001, lon + 0.001, lon, lon]) AS lon2,
     unnest([lat, lat, lat + 0.001, lat + 0.001]) AS la1, unnest([lat, lat + 0.001, lat + 0.001, lat]) AS la2 FROM {B.POINTS}) GROUP BY point_id""")
def _(t):
    x, y = F.col("lon"), F.col("lat")
    return B.points(t).select("point_id", F.round(G.sphere_area(F.array(B.box_rings(x, y, x + 0.001, y + 0.001))), 0).alias("area"))


@query("densify_ring", "X16", f"SELECT pos, 13 AS points, round(x0 + (x1 - x0) / 3, 6) AS second_x, (x1-x0)*(y1-y0) AS area FROM {A}")
def _(t):
    d = G.densify(F.col("rings")[0], 3)
    return rects(t).select("pos", d.alias("d")).select("pos", F.size("d").alias("points"), F.round(F.col("d")[1]["x"], 6).alias("second_x"),
                                                       F.round(G.ring_area(F.col("d")), 6).alias("area"))


def _gcj(x, y):
    pi = "pi()"
    com = f"(20*sin(6*{x}*{pi})+20*sin(2*{x}*{pi}))*2/3"
    lat = f"(-100+2*{x}+3*{y}+0.2*{y}*{y}+0.1*{x}*{y}+0.2*sqrt(abs({x}))+{com}+(20*sin({y}*{pi})+40*sin({y}/3*{pi}))*2/3+(160*sin({y}/12*{pi})+320*sin({y}*{pi}/30))*2/3)"
    lon = f"(300+{x}+2*{y}+0.1*{x}*{x}+0.1*{x}*{y}+0.1*sqrt(abs({x}))+{com}+(20*sin({x}*{pi})+40*sin({x}/3*{pi}))*2/3+(150*sin({x}/12*{pi})+300*sin({x}/30*{pi}))*2/3)"
    return lon, lat


LON, LAT = _gcj("(lon-105)", "(lat-35)")
MAGIC = "(1-0.00669342162296594323*sin(lat/180*pi())*sin(lat/180*pi()))"


@query("datum_shift", "F34", f"""SELECT point_id, round(lon - {LON}*180/(6378245.0/sqrt({MAGIC})*cos(lat/180*pi())*pi()), 9) AS x,
    round(lat - {LAT}*180/((6378245.0*(1-0.00669342162296594323))/({MAGIC}*sqrt({MAGIC}))*pi()), 9) AS y FROM {B.POINTS}""")
def _(t):
    p = B.points(t).select("point_id", F.inline(F.array(G.gcj02_to_wgs84(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))))))
    return p.select("point_id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("degrees_per_metre", "F35", f"SELECT point_id, round(1e9/(111320.0*cos(radians(lat))), 6) AS x, round(1e9/111320.0, 6) AS y FROM {B.POINTS}")
def _(t):
    d = B.points(t).select("point_id", F.inline(F.array(G.deg_per_m(F.col("lat")))))
    return d.select("point_id", F.round(F.col("x") * 1e9, 6).alias("x"), F.round(F.col("y") * 1e9, 6).alias("y"))


@query("layer_scale", "F36", f"""SELECT category, round(111320.0*cos(radians(avg(lat))), 3) AS x, 110540.0::DOUBLE AS y FROM {B.POINTS} GROUP BY category""")
def _(t):
    g = B.points(t).groupBy("category").agg(F.avg("lat").alias("m"), F.first("lon").alias("fx"), F.first("lat").alias("fy"))
    return g.select("category", F.inline(F.array(G.layer_scale(F.col("m"), F.col("fx"), F.col("fy"))))).withColumn("x", F.round("x", 3))


IMAGE, BOX = (10.0, 20.0, 410.0, 620.0), (116.0, 39.8, 116.5, 40.2)


@query("pixel_to_lonlat", "F37", "SELECT k, n, round(116.0 + (r - 10) / 400.0 * 0.5, 9) AS x, round(40.2 - (g - 20) / 600.0 * 0.4, 9) AS y FROM (SELECT l_partkey % 256 AS r, l_suppkey % 199 AS g, l_orderkey AS k, l_linenumber AS n FROM lineitem)")
def _(t):
    p = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.inline(F.array(G.pixel_to_lonlat(
        F.col("l_partkey") % 256, F.col("l_suppkey") % 199, IMAGE, BOX))))
    return p.select("k", "n", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("lonlat_to_pixel", "F53", f"SELECT point_id, round((lon - 116.0) / 0.5 * 400 + 10, 6) AS x, round((40.2 - lat) / (40.2 - 39.8) * 600 + 20, 6) AS y FROM {B.POINTS}")
def _(t):
    p = B.points(t).select("point_id", F.inline(F.array(G.lonlat_to_pixel(F.col("lon"), F.col("lat"), IMAGE, BOX))))
    return p.select("point_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("boundary_text", "F52", f"SELECT pos, (CASE WHEN size % 2 = 0 THEN 2 ELSE 1 END)::INTEGER AS rings, (CASE WHEN size % 2 = 0 THEN 2 ELSE 1 END) * (x1-x0)*(y1-y0) AS area FROM {A}")
def _(t):
    c = lambda x, y: F.concat_ws(",", F.col(x).cast("string"), F.col(y).cast("string"))
    ring = F.concat_ws(";", c("x0", "y0"), c("x1", "y0"), c("x1", "y1"), c("x0", "y1"))
    text = F.concat(ring, F.lit("| |1,1;2,2"), F.when(F.col("size") % 2 == 0, F.concat(F.lit("|"), ring)).otherwise(""))
    r = G.parse_boundary_text(text, shift=False)
    return rects(t).select("pos", r.alias("r")).select("pos", F.size("r").alias("rings"), G.area_m2(F.transform("r", lambda x: F.array(x))).alias("area"))


@query("feature_bbox", "G18", f"SELECT submission, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM {A} GROUP BY 1")
def _(t):
    b = rects(t).select("submission", F.inline(F.array(G.bbox(F.col("rings")))))
    return b.groupBy("submission").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
