"""Geometry expressions.

A ring is an array of points struct<x,y>; ``rings`` is an array of rings read
by the even-odd rule; ``polys`` is an array of polygons, each an outer ring
followed by its holes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# fixed values: CGCS2000 ellipsoid and the 3-degree zone with central meridian 117 E
AXIS = 6378137.0
INVERSE_FLATTENING = 298.257222101
CENTRAL_MERIDIAN = 117.0
FALSE_EASTING = 500000.0

# fixed values: datum shift ellipsoid
SHIFT_AXIS = 6378245.0
SHIFT_ECC = 0.00669342162296594323

EARTH_RADIUS = 6371000.0
METRES_PER_DEGREE = 111320.0
METRES_PER_DEGREE_LAT = 110540.0
POINT = "struct<x:double,y:double>"


def pt(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def no_points() -> Column:
    return F.array().cast(f"array<{POINT}>")


def no_doubles() -> Column:
    return F.array().cast("array<double>")


# ---- projection -----------------------------------------------------------------------

def project(p: Column) -> Column:
    """Longitude / latitude to metres of the zone (Krueger series, third order)."""
    f = 1 / INVERSE_FLATTENING
    n, e = f / (2 - f), math.sqrt(f * (2 - f))
    radius = AXIS / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    alpha = [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16, 13 * n ** 2 / 48 - 3 * n ** 3 / 5, 61 * n ** 3 / 240]

    def series(v):
        xi, eta = v["xi"], v["eta"]
        north, east = xi, eta
        for k, a in enumerate(alpha, 1):
            north = north + F.sin(2 * k * xi) * F.cosh(2 * k * eta) * a
            east = east + F.cos(2 * k * xi) * F.sinh(2 * k * eta) * a
        return pt(east * radius + FALSE_EASTING, north * radius)

    def plane(v):
        return let(F.struct(F.atan2(v["t"], F.cos(v["lam"])).alias("xi"),
                            F.atanh(F.sin(v["lam"]) / F.sqrt(v["t"] * v["t"] + 1)).alias("eta")), series)

    lam, sine = F.radians(p["x"] - CENTRAL_MERIDIAN), F.sin(F.radians(p["y"]))
    return let(F.struct(lam.alias("lam"), F.sinh(F.atanh(sine) - F.atanh(sine * e) * e).alias("t")), plane)


def project_rings(rings: Column) -> Column:
    return F.transform(rings, lambda r: F.transform(r, project))


def project_polys(polys: Column) -> Column:
    return F.transform(polys, project_rings)


def gcj02_to_wgs84(p: Column) -> Column:
    """Approximate inverse of the map datum shift."""
    pi = math.pi

    def waves(v, terms):
        out = F.lit(0.0)
        for amplitude, frequency in terms:
            out = out + F.sin(v * frequency) * amplitude
        return out * 2.0 / 3.0

    def shift(v):
        x, y = v["x"], v["y"]
        common = waves(x, [(20.0, 6.0 * pi), (20.0, 2.0 * pi)])
        root = F.sqrt(F.abs(x))
        dlat = (x * 2.0 + y * 3.0 + y * y * 0.2 + x * y * 0.1 + root * 0.2 - 100.0 + common
                + waves(y, [(20.0, pi), (40.0, pi / 3.0)]) + waves(y, [(160.0, pi / 12.0), (320.0, pi / 30.0)]))
        dlon = (x + y * 2.0 + x * x * 0.1 + x * y * 0.1 + root * 0.1 + 300.0 + common
                + waves(x, [(20.0, pi), (40.0, pi / 3.0)]) + waves(x, [(150.0, pi / 12.0), (300.0, pi / 30.0)]))
        lat = v["lat"] / 180.0 * pi
        magic = 1 - F.sin(lat) * F.sin(lat) * SHIFT_ECC
        return pt(v["lon"] - dlon * 180.0 / (SHIFT_AXIS / F.sqrt(magic) * F.cos(lat) * pi),
                  v["lat"] - dlat * 180.0 / (SHIFT_AXIS * (1 - SHIFT_ECC) / (magic * F.sqrt(magic)) * pi))
    return let(F.struct((p["x"] - 105.0).alias("x"), (p["y"] - 35.0).alias("y"), p["x"].alias("lon"), p["y"].alias("lat")), shift)


def deg_per_m(lat: Column) -> Column:
    return pt(1.0 / (F.cos(F.radians(lat)) * METRES_PER_DEGREE), F.lit(1.0 / METRES_PER_DEGREE))


def layer_scale(mean_lat: Column, first_x: Column, first_y: Column) -> Column:
    """Metres per unit of a layer: degrees are scaled at the mean latitude."""
    degrees = (F.abs(first_x) <= 180) & (F.abs(first_y) <= 90)
    return F.when(F.coalesce(degrees, F.lit(False)), pt(
        F.cos(F.radians(mean_lat)) * METRES_PER_DEGREE, F.lit(METRES_PER_DEGREE_LAT))).otherwise(pt(F.lit(1.0), F.lit(1.0)))


def pixel_to_lonlat(x: Column, y: Column, image: tuple, box: tuple) -> Column:
    """``image`` and ``box`` are (x0, y0, x1, y1) in pixels and in degrees."""
    (ix0, iy0, ix1, iy1), (lon0, lat0, lon1, lat1) = image, box
    return pt((x - ix0) / (ix1 - ix0) * (lon1 - lon0) + lon0, F.lit(lat1) - (y - iy0) / (iy1 - iy0) * (lat1 - lat0))


def lonlat_to_pixel(lon: Column, lat: Column, image: tuple, box: tuple) -> Column:
    (ix0, iy0, ix1, iy1), (lon0, lat0, lon1, lat1) = image, box
    return pt((lon - lon0) / (lon1 - lon0) * (ix1 - ix0) + ix0, (F.lit(lat1) - lat) / (lat1 - lat0) * (iy1 - iy0) + iy0)


# ---- rings --------------------------------------------------------------------------------

def rings_from_geojson(geometry: Column) -> Column:
    """Polygons of a GeoJSON geometry text; rings are kept as given, Z is dropped."""
    kind = F.get_json_object(geometry, "$.type")
    coords = F.get_json_object(geometry, "$.coordinates")
    points = lambda ring: F.transform(ring, lambda c: pt(c[0], c[1]))
    single = F.from_json(coords, "array<array<array<double>>>")
    multi = F.from_json(coords, "array<array<array<array<double>>>>")
    poly = lambda rings: F.transform(F.filter(rings, lambda r: F.size(r) > 0), points)
    return (F.when(kind == "Polygon", F.array(poly(single)))
            .when(kind == "MultiPolygon", F.transform(multi, poly))
            .otherwise(F.array().cast(f"array<array<array<{POINT}>>>")))


def rings_of(polys: Column) -> Column:
    return F.flatten(polys)


def closed(ring: Column) -> Column:
    return (F.size(ring) >= 4) & (F.element_at(ring, 1) == F.element_at(ring, -1))


def _steps(ring: Column, body) -> Column:
    """``body(p, q)`` for consecutive points of a ring."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), body)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def ring_area(ring: Column) -> Column:
    """Absolute shoelace area; the first point is the local origin."""
    def area(r):
        o = F.get(r, F.lit(0))
        terms = _steps(r, lambda p, q: (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"]))
        return F.abs(_sum(terms)) / 2
    return let(ring, area)


def polygon_area(rings: Column) -> Column:
    """Outer ring minus holes."""
    areas = F.transform(rings, ring_area)
    return let(areas, lambda a: F.coalesce(F.get(a, F.lit(0)), F.lit(0.0)) * 2 - _sum(a))


def area_m2(polys: Column) -> Column:
    return _sum(F.transform(polys, polygon_area))


def sphere_area(polys: Column) -> Column:
    """Spherical area of the outer rings."""
    def outer(rings):
        ring = F.get(rings, F.lit(0))
        terms = _steps(ring, lambda p, q: F.radians(q["x"] - p["x"]) * (
            F.sin(F.radians(p["y"])) + F.sin(F.radians(q["y"])) + 2.0))
        return F.abs(_sum(terms)) * (EARTH_RADIUS * EARTH_RADIUS / 2)
    return _sum(F.transform(polys, outer))


def translate_rings(rings: Column, dx: Column, dy: Column) -> Column:
    return F.transform(rings, lambda r: F.transform(r, lambda p: pt(p["x"] + dx, p["y"] + dy)))


def densify(ring: Column, n: int) -> Column:
    """n - 1 points are inserted on every edge."""
    cuts = F.array(*[F.lit(j / n) for j in range(n)])
    pieces = _steps(ring, lambda p, q: F.transform(cuts, lambda t: pt(
        p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"]))))
    return F.when(F.size(ring) > 0, F.concat(F.flatten(pieces), F.array(F.element_at(ring, -1)))).otherwise(ring)


def bbox(rings: Column) -> Column:
    return let(F.flatten(rings), lambda ps: F.struct(
        F.array_min(F.transform(ps, lambda p: p["x"])).alias("x0"), F.array_min(F.transform(ps, lambda p: p["y"])).alias("y0"),
        F.array_max(F.transform(ps, lambda p: p["x"])).alias("x1"), F.array_max(F.transform(ps, lambda p: p["y"])).alias("y1")))


def point_in_rings(p: Column, rings: Column) -> Column:
    """Even-odd test; a point on a lower or left edge counts as inside."""
    hits = F.flatten(F.transform(rings, lambda r: _steps(r, lambda a, b: F.when(
        (a["y"] > p["y"]) != (b["y"] > p["y"]),
        p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / (b["y"] - a["y"]) + a["x"]).otherwise(F.lit(False)))))
    return F.size(F.filter(hits, lambda h: h)) % 2 == 1


def on_ring(p: Column, ring: Column) -> Column:
    """Whether a point lies on the line of a ring."""
    hits = _steps(ring, lambda a, b: (
        ((b["x"] - a["x"]) * (p["y"] - a["y"]) == (b["y"] - a["y"]) * (p["x"] - a["x"]))
        & p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))
        & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))))
    return F.exists(hits, lambda h: h)


def hole_outside(rings: Column) -> Column:
    """Whether a ring after the first has a vertex or an edge middle outside the first."""
    def points(r):
        return F.concat(r, _steps(r, lambda a, b: pt((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)))
    shell = F.get(rings, F.lit(0))
    holes = F.flatten(F.transform(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), points))
    return F.exists(holes, lambda p: ~point_in_rings(p, F.array(shell)) & ~on_ring(p, shell))


def parse_boundary_text(text: Column, shift: bool = True) -> Column:
    """``lon,lat;...|...`` to closed rings; rings of fewer than four points are dropped."""
    def ring(chunk):
        pts = F.transform(F.split(chunk, ";"), lambda s: pt(
            F.substring_index(s, ",", 1).cast("double"), F.substring_index(s, ",", -1).cast("double")))
        return F.transform(pts, gcj02_to_wgs84) if shift else pts
    chunks = F.filter(F.split(text, r"\|"), lambda c: F.trim(c) != "")
    rings = F.filter(F.transform(chunks, ring), lambda r: F.size(r) >= 4)
    return F.transform(rings, lambda r: F.concat(r, F.slice(r, 1, 1)))


def edges(rings: Column) -> Column:
    """Non-vertical edges, left end first."""
    raw = F.flatten(F.transform(rings, lambda r: _steps(r, lambda p, q: F.when(p["x"] <= q["x"], F.struct(
        p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))).otherwise(F.struct(
            q["x"].alias("x1"), q["y"].alias("y1"), p["x"].alias("x2"), p["y"].alias("y2"))))))
    return F.filter(raw, lambda e: e["x1"] < e["x2"])


def crossing_x(e: Column, f: Column) -> Column:
    """x of the proper crossing of two edges, null if they do not cross."""
    se = (e["y2"] - e["y1"]) / (e["x2"] - e["x1"])
    sf = (f["y2"] - f["y1"]) / (f["x2"] - f["x1"])

    def at(v):
        x = (f["y1"] - e["y1"] + v["se"] * e["x1"] - v["sf"] * f["x1"]) / (v["se"] - v["sf"])
        return let(x, lambda c: F.when((c > F.greatest(e["x1"], f["x1"])) & (c < F.least(e["x2"], f["x2"])), c))
    return let(F.struct(se.alias("se"), sf.alias("sf")), lambda v: F.when(v["se"] != v["sf"], at(v)))


def even_odd_area(rings: Column) -> Column:
    """Area of a ring set read by the even-odd rule, whatever the ring order."""
    return intersection_area(rings, None)


def intersection_area(a: Column, b: Column | None) -> Column:
    """Area common to two ring sets, each read by the even-odd rule.

    Without ``b`` it is the area of ``a`` alone.

    The edges cut the plane into vertical slabs in which no two edges cross, so
    the middle height of a slab gives its area exactly.
    """
    tag = lambda rings, side: F.transform(edges(rings), lambda e: F.struct(
        e["x1"].alias("x1"), e["y1"].alias("y1"), e["x2"].alias("x2"), e["y2"].alias("y2"), F.lit(side).alias("s")))

    def slab(es, left, right):
        mid = (left + right) / 2
        active = F.filter(es, lambda e: (e["x1"] <= left) & (e["x2"] >= right))
        heights = F.array_sort(F.transform(active, lambda e: F.struct(
            (e["y1"] + (e["y2"] - e["y1"]) * (mid - e["x1"]) / (e["x2"] - e["x1"])).alias("y"), e["s"].alias("s"))))
        walked = F.aggregate(
            heights, F.struct(F.lit(False).alias("a"), F.lit(b is None).alias("b"), F.lit(0.0).alias("y"), F.lit(0.0).alias("sum")),
            lambda acc, h: F.struct(
                (acc["a"] != (h["s"] == 0)).alias("a"), (acc["b"] != (h["s"] == 1)).alias("b"), h["y"].alias("y"),
                (acc["sum"] + F.when(acc["a"] & acc["b"], h["y"] - acc["y"]).otherwise(0.0)).alias("sum")),
            lambda acc: acc["sum"])
        return walked * (right - left)

    def measure(es):
        cuts = F.flatten(F.transform(es, lambda e: F.filter(
            F.transform(F.filter(es, lambda f: (f["x1"] < e["x2"]) & (f["x2"] > e["x1"])), lambda f: crossing_x(e, f)),
            lambda c: c.isNotNull())))
        xs = F.array_sort(F.array_distinct(F.concat(
            F.transform(es, lambda e: e["x1"]), F.transform(es, lambda e: e["x2"]), cuts)))
        return let(xs, lambda v: _sum(F.zip_with(
            F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))),
            lambda left, right: slab(es, left, right))))
    return let(tag(a, 0) if b is None else F.concat(tag(a, 0), tag(b, 1)), measure)


def clip_rings(rings: Column, axis: str, low: Column, high: Column) -> Column:
    """Rings cut to ``low <= axis <= high``; the even-odd area inside is kept."""
    other = "y" if axis == "x" else "x"

    def half(rs, keep, limit):
        def cut(p, q):
            t = (limit - p[axis]) / (q[axis] - p[axis])
            cross = p[other] + t * (q[other] - p[other])
            return pt(limit, cross) if axis == "x" else pt(cross, limit)

        def ring(r):
            pieces = _steps(r, lambda p, q: F.when(keep(p), F.when(keep(q), F.array(q)).otherwise(F.array(cut(p, q))))
                            .otherwise(F.when(keep(q), F.array(cut(p, q), q)).otherwise(no_points())))
            return let(F.flatten(pieces), lambda c: F.when(F.size(c) > 0, F.concat(c, F.slice(c, 1, 1))).otherwise(c))
        return F.filter(F.transform(rs, ring), lambda r: F.size(r) > 3)
    return half(half(rings, lambda p: p[axis] >= low, low), lambda p: p[axis] <= high, high)


def convex_hull(points: Column) -> Column:
    """Closed counter-clockwise hull (monotone chain over the sorted points)."""
    def turn(o, a, b):
        return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])

    def chain(ps):
        # A stack whose last points make no left turn with the new one is cut back
        # to the longest prefix that does.
        def push(acc, p):
            good = F.filter(F.sequence(F.lit(2), F.greatest(F.size(acc), F.lit(2))), lambda k: (k <= F.size(acc)) & (
                turn(F.element_at(acc, k - 1), F.element_at(acc, k), p) > 0))
            keep = F.coalesce(F.array_max(good), F.least(F.size(acc), F.lit(1)))
            return F.when(F.size(acc) < 2, F.array_append(acc, p)).otherwise(F.array_append(F.slice(acc, 1, keep), p))
        return F.aggregate(ps, no_points(), push)

    def hull(ps):
        lower, upper = chain(ps), chain(F.reverse(ps))
        both = F.concat(lower, F.slice(upper, 2, F.greatest(F.size(upper) - 1, F.lit(0))))
        return both
    return let(F.array_sort(F.array_distinct(points)), hull)
