"""Corridor and point queries."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import corridor as C
from . import bindings as B
from .registry import query

SEGMENTS = ["BUILD", "HOUSE", "AUTO", "HOLD"]
BUCKET = f"CASE WHEN status = 'ok' AND {B.IN_BOX} THEN 'in' WHEN status = 'ok' THEN 'out' ELSE 'not_geocoded' END"
HINT = "array_to_string(list_filter(['BUILD','HOUSE','AUTO','HOLD'], lambda k: contains(address, k)), '|')"
POI = f"(SELECT l_partkey % 7 AS category, l_orderkey FROM lineitem)"


@query("in_bbox", "P1", f"SELECT point_id, {B.IN_BOX} AS inside FROM {B.POINTS}")
def _(t):
    return B.points(t).select("point_id", C.in_bbox(F.col("lon"), F.col("lat")).alias("inside"))


@query("bucket", "P2", f"SELECT point_id, {BUCKET} AS bucket FROM {B.POINTS}")
def _(t):
    return B.points(t).select("point_id", C.bucket(F.col("status"), F.col("lon"), F.col("lat")).alias("bucket"))


@query("keyword_hint", "P3", f"SELECT point_id, {HINT} AS hint FROM {B.POINTS_ADDR} WHERE status <> 'ok'")
def _(t):
    return C.hinted(B.points(t, True), SEGMENTS).select("point_id", "hint")


@query("keyword_flag", "P4", f"""SELECT c_custkey, CASE WHEN regexp_matches(c_mktsegment, 'BUILD|AUTO') THEN 'yes'
    ELSE 'unknown' END AS flag FROM customer""")
def _(t):
    return t.customer.select("c_custkey", X.keyword_flag(F.col("c_mktsegment"), ["BUILD", "AUTO"]).alias("flag"))


@query("clean_address", "F7", """SELECT c_custkey, CASE WHEN contains(a, 'CITY') THEN a ELSE 'CITY' || a END AS address
    FROM (SELECT c_custkey, trim(regexp_replace(CASE WHEN c_custkey % 2 = 0 THEN 'CITY ' ELSE '  ' END ||
    c_mktsegment || '   ' || c_name || ' ', '\\s+', ' ', 'g')) AS a FROM customer)""")
def _(t):
    raw = F.concat(F.when(F.col("c_custkey") % 2 == 0, "CITY ").otherwise("  "), F.col("c_mktsegment"),
                   F.lit("   "), F.col("c_name"), F.lit(" "))
    return t.customer.select("c_custkey", X.clean_address(raw, "CITY").alias("address"))


SUMMARY = f"""SELECT category, count(*) AS total, count(*) FILTER (WHERE b = 'in') AS corridor_in,
    count(*) FILTER (WHERE b = 'out') AS corridor_out, count(*) FILTER (WHERE b = 'not_geocoded') AS not_geocoded,
    count(*) FILTER (WHERE status = 'ok') AS geocoded_ok
    FROM (SELECT *, {BUCKET} AS b FROM {B.POINTS}) GROUP BY category"""


@query("facility_summary", "G4", SUMMARY)
def _(t):
    return C.facility_summary(B.points(t))


@query("geocode_status_counts", "G5", f"SELECT status, count(*) AS n FROM {B.POINTS} GROUP BY status")
def _(t):
    return C.status_counts(B.points(t))


POI_BY_PRIORITY = """(SELECT o_orderpriority AS category, l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE o_orderpriority <> '5-LOW')"""


def _poi(t):
    return (t.lineitem.select("l_orderkey").join(
        t.orders.filter("o_orderpriority <> '5-LOW'").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("category")), "l_orderkey"))


@query("poi_category_counts", "G27", f"SELECT category, count(*) AS n FROM {POI_BY_PRIORITY} GROUP BY category")
def _(t):
    return C.poi_counts(_poi(t))


COMPARE = f"""SELECT s.*, coalesce(p.n, 0) AS poi_count FROM ({SUMMARY}) s LEFT JOIN
    (SELECT category, count(*) AS n FROM {POI_BY_PRIORITY} GROUP BY category) p USING (category)"""


@query("compare_sources", "J19", COMPARE)
def _(t):
    return C.compare_sources(C.facility_summary(B.points(t), check=False), _poi(t))


@query("corridor_integration", "C20", COMPARE)
def _(t):
    return C.integrate(B.points(t), _poi(t))


@query("corridor_points", "U5", f"SELECT point_id, category, lon, lat FROM {B.POINTS} WHERE status = 'ok' AND {B.IN_BOX}")
def _(t):
    p = B.points(t)
    parts = [p.filter("category < '3'"), p.filter("category >= '3' AND category < '5'"), p.filter("category >= '5'")]
    return C.corridor_points(*parts).select("point_id", "category", "lon", "lat")


@query("filter_poi", "P63", f"""SELECT point_id FROM {B.POINTS} WHERE contains(category, 'URGENT') AND {B.IN_BOX}""")
def _(t):
    return C.filter_poi(B.points(t).withColumnRenamed("category", "type"), "URGENT").select("point_id")
