"""Queries of joins and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import joins as J
from . import bindings as B
from .checks import DISK_SQL, LISTED_SQL, MET, listed, metrics
from .registry import query
from .texts import LINES, sql_strip

BRANDS = "(SELECT 'S' || (l_suppkey % 50) AS submission, 'Brand#' || (l_partkey % 27) AS brand FROM lineitem WHERE l_suppkey % 50 <> 7 OR l_partkey % 27 < 9)"
MISSING = f"SELECT s.submission, b.brand FROM (SELECT DISTINCT submission FROM {BRANDS}) s CROSS JOIN (SELECT DISTINCT p_brand AS brand FROM part) b WHERE NOT EXISTS (SELECT 1 FROM {BRANDS} c WHERE c.submission = s.submission AND c.brand = b.brand)"


def brands(t):
    return t.sql(f"SELECT * FROM {BRANDS}")


@query("missing_coverage", "J2", MISSING)
def _(t):
    c = brands(t)
    return J.missing(t.part.select(F.col("p_brand").alias("brand")), c, c, "submission", "brand")


@query("undeclared_metrics", "J24", f"SELECT s.submission, r.metric FROM (SELECT DISTINCT submission FROM {MET}) s CROSS JOIN (SELECT unnest(['AF','RF','none']) AS metric) r WHERE NOT EXISTS (SELECT 1 FROM {MET} m WHERE m.submission = s.submission AND m.metric = r.metric)")
def _(t):
    m = metrics(t)
    need = t.region.select(F.explode(F.array(F.lit("AF"), F.lit("RF"), F.lit("none"))).alias("metric")).distinct()
    return J.undeclared_metrics(m, m, need)


@query("set_missing", "U2", """SELECT submission, array_to_string(list_sort(list_filter(['Brand#1','Brand#9','Brand#26','none'], lambda x: NOT list_contains(b, x))), '|') AS missing FROM
    (SELECT 'S' || (l_suppkey % 50) AS submission, list(DISTINCT 'Brand#' || (l_partkey % 27)) AS b FROM lineitem GROUP BY 1)""")
def _(t):
    g = t.sql("SELECT 'S' || (l_suppkey % 50) AS submission, 'Brand#' || (l_partkey % 27) AS brand FROM lineitem").groupBy("submission").agg(F.collect_set("brand").alias("b"))
    need = F.array(*[F.lit(x) for x in ("Brand#1", "Brand#9", "Brand#26", "none")])
    return g.select("submission", F.array_join(J.set_missing(need, F.col("b")), "|").alias("missing"))


CITE_IDS = "(SELECT source AS submission, CASE WHEN doc_id % 2 = 0 THEN 'data' ELSE 'source' END AS kind, 'p' || (doc_id % 90) AS id FROM documents)"
CITE_REFS = "(SELECT source AS submission, CASE WHEN doc_id % 3 = 0 THEN 'data' ELSE 'source' END AS kind, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'p' || (doc_id % 90) || '#x' ELSE 'p' || (doc_id % 90) END AS value FROM documents)"


@query("citation_integrity", "J3", f"""SELECT DISTINCT submission, kind, id FROM {CITE_IDS} i WHERE NOT EXISTS (SELECT 1 FROM {CITE_REFS} r WHERE r.submission = i.submission AND r.kind = i.kind
    AND (r.value = i.id OR (i.kind = 'data' AND starts_with(r.value, i.id || '#'))))""")
def _(t):
    return J.check_citations(t.sql(f"SELECT * FROM {CITE_REFS}"), t.sql(f"SELECT * FROM {CITE_IDS}"))


SRC = "(SELECT 's' || item_id AS id, CASE WHEN item_id % 3 = 0 THEN '' ELSE substr(text, 3, 9) END AS citation, CASE WHEN item_id % 4 = 0 THEN substr(text, 20, 6) ELSE '' END AS path, '' AS url FROM benchmark)"
SRC_TOK = f"(SELECT id, coalesce(nullif(citation, ''), nullif(path, ''), '') AS label, trim(unnest([id, citation, path])) AS token FROM {SRC})"
MATCHED = f"(SELECT DISTINCT doc_id, id, label FROM documents JOIN {SRC_TOK} ON token <> '' AND contains(text, token))"


@query("match_sources", "J4", f"SELECT * FROM {MATCHED}")
def _(t):
    return J.match_sources(t.documents, "doc_id", "text", t.sql(f"SELECT * FROM {SRC}"))


@query("mentions_large_dictionary", "J4", "SELECT DISTINCT doc_id, token FROM documents JOIN (SELECT DISTINCT p_name AS token FROM part UNION SELECT substr(text, 3, 9) FROM benchmark) ON contains(text, token)")
def _(t):
    tokens = t.part.select(F.col("p_name").alias("token")).union(t.benchmark.select(F.expr("substr(text, 3, 9)")))
    return J.mentions(t.documents, "doc_id", "text", tokens, small=0)


@query("unmatched_reference_lines", "J4", f"""WITH l AS (SELECT doc_id, {sql_strip("substr(x, 3)")} AS line FROM (SELECT doc_id, {sql_strip("unnest(" + LINES.format(c="md") + ")")} AS x FROM {B.MARKDOWN}) WHERE starts_with(x, '- ') AND {sql_strip("substr(x, 3)")} <> '')
    SELECT doc_id, line, count(*) AS n FROM l WHERE NOT EXISTS (SELECT 1 FROM {MATCHED} m JOIN {SRC_TOK} k USING (id) WHERE m.doc_id = l.doc_id AND k.token <> '' AND contains(replace(l.line, '`', ''), k.token)) GROUP BY ALL""")
def _(t):
    src = t.sql(f"SELECT * FROM {SRC}")
    m = J.match_sources(t.documents, "doc_id", "text", src)
    return J.unmatched_lines(B.markdown(t), "doc_id", "md", src, m).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"))


@query("collections", "J6", """SELECT o_orderkey AS item, 'c' || o_custkey AS proposal, coalesce(c_name, 'c' || o_custkey) AS title, coalesce(c_mktsegment, '未载入') AS author, coalesce('u/' || c_custkey, '') AS url, c_custkey IS NOT NULL AS loaded
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = o_custkey""")
def _(t):
    items = t.orders.select(F.col("o_orderkey").alias("item"), F.concat(F.lit("c"), "o_custkey").alias("proposal"))
    cards = t.customer.filter("c_custkey % 3 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("source_path"), F.col("c_name").alias("title"),
                                                         F.col("c_mktsegment").alias("author"), F.concat(F.lit("u/"), "c_custkey").alias("detail_url"))
    return J.join_collections(items, cards)


TITLED = """(SELECT c_custkey, pos, id, coalesce(n_name, id) AS title FROM (SELECT c_custkey, unnest(['n' || c_nationkey, 'x' || (c_custkey % 4), 'n' || ((c_nationkey + 3) % 25)]) AS id, unnest([0, 1, 2]) AS pos FROM customer) LEFT JOIN nation ON id = 'n' || n_nationkey)"""


@query("label_tags", "J7", f"SELECT c_custkey, pos::INTEGER AS pos, id, title FROM {TITLED} WHERE pos < 2")
def _(t):
    tags = t.customer.select("c_custkey", F.array(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("x"), F.col("c_custkey") % 4),
                                                  F.concat(F.lit("n"), (F.col("c_nationkey") + 3) % 25)).alias("tags"))
    return J.label_tags(tags, "c_custkey", "tags", t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("title")), 2)


@query("check_hashes", "J14", f"""SELECT submission, path, CASE WHEN d.sha256 IS NULL THEN 'missing_file' WHEN coalesce(l.sha256, '') = '' THEN 'missing_hash' WHEN l.sha256 <> d.sha256 THEN 'mismatch' ELSE 'match' END AS verdict
    FROM {LISTED_SQL} l LEFT JOIN {DISK_SQL} d USING (submission, path)""")
def _(t):
    return J.check_hashes(*listed(t))


@query("changed_files", "J15", f"SELECT submission, path FROM {LISTED_SQL} l JOIN {DISK_SQL} d USING (submission, path) WHERE coalesce(l.sha256, '') <> '' AND l.sha256 <> d.sha256")
def _(t):
    return J.changed_files(*listed(t))


DECL = f"(SELECT submission, metric, value * (CASE n % 5 WHEN 0 THEN 1.5 WHEN 1 THEN 1.005 ELSE 1 END) AS value, CASE n % 3 WHEN 0 THEN 'sqm' WHEN 1 THEN 'ratio' ELSE 'm' END AS unit FROM {MET})"


@query("compare_metrics", "J16", f"""SELECT * FROM (SELECT submission, metric, d.value, m.value AS expected, CASE WHEN unit = 'ratio' AND (d.value < 0 OR d.value > 1) THEN 'METRIC_RATIO_RANGE'
    WHEN abs(d.value - m.value) > greatest(CASE WHEN unit = 'sqm' THEN 1 ELSE 0.01 END, abs(m.value) * 0.01) THEN 'METRIC_RECALC_MISMATCH' END AS check_id FROM {DECL} d JOIN {MET} m USING (submission, metric)) WHERE check_id IS NOT NULL""")
def _(t):
    return J.compare_metrics(t.sql(f"SELECT * FROM {DECL.replace('1.005', 'CAST(1.005 AS DOUBLE)').replace('THEN 1.5', 'THEN CAST(1.5 AS DOUBLE)')}"), metrics(t))


@query("compare_html_metrics", "J17", """SELECT CAST(p_partkey AS VARCHAR) AS submission, metric, check_id FROM (SELECT p_partkey, unnest(['a', 'b', 'c']) AS metric, unnest([CASE p_size % 3 WHEN 0 THEN 'VISUAL_METRIC_MISMATCH' END,
    CASE WHEN p_size % 2 = 0 THEN 'VISUAL_METRIC_SOURCE_MISSING' END, 'VISUAL_METRIC_MISSING']) AS check_id FROM part) WHERE check_id IS NOT NULL""")
def _(t):
    k = F.col("p_partkey").cast("string")
    html = F.concat(F.lit('<b data-metric="a" class=x data-value="'), F.col("p_retailprice") + F.when(F.col("p_size") % 3 == 0, 0.1).otherwise(0.0),
                    F.lit('">v</b><i DATA-METRIC=\'b\' data-value=\'5\'></i><i data-metric="c" data-value="many"></i>'))
    pages = t.part.select(k.alias("submission"), html.alias("html"))
    m = t.part.select(k.alias("submission"), F.explode(F.array(
        F.struct(F.lit("a").alias("metric"), F.lit("known").alias("status"), F.col("p_retailprice").alias("value")),
        F.struct(F.lit("b").alias("metric"), F.when(F.col("p_size") % 2 == 0, "unknown").otherwise("known").alias("status"), F.lit(5.0).alias("value")))).alias("m")).select("submission", "m.*")
    return J.compare_html_metrics(pages, m, ["a", "b", "c"])


@query("rule_overrides", "J21", """SELECT 'C' || c_custkey AS constraint_id, CASE WHEN c_custkey % 4 = 0 THEN 'critical' ELSE 'high' END AS severity, CASE WHEN c_custkey % 8 = 0 THEN FALSE ELSE TRUE END AS enabled FROM customer""")
def _(t):
    r = t.customer.select(F.concat(F.lit("C"), "c_custkey").alias("constraint_id"), F.lit("high").alias("severity"), F.lit(True).alias("enabled"))
    o = t.customer.filter("c_custkey % 4 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("constraint_id"), F.lit("critical").alias("severity"),
                                                     F.when(F.col("c_custkey") % 8 == 0, False).alias("enabled"))
    return J.apply_overrides(r, o)


@query("dangling_ids", "J22", """SELECT submission, pos, id FROM (SELECT c_nationkey AS submission, c_custkey AS pos, unnest(['A' || (c_custkey % 30), 'A' || (c_custkey % 7)]) AS id FROM customer) x
    WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = x.submission AND 'A' || (s.s_suppkey % 30) = x.id)""")
def _(t):
    m = t.customer.select(F.col("c_nationkey").alias("submission"), F.col("c_custkey").alias("pos"), F.array(
        F.concat(F.lit("A"), F.col("c_custkey") % 30), F.concat(F.lit("A"), F.col("c_custkey") % 7)).alias("ids"))
    return J.dangling_ids(m, ["pos"], "ids", t.supplier.select(F.col("s_nationkey").alias("submission"), F.concat(F.lit("A"), F.col("s_suppkey") % 30).alias("id")))


@query("missing_key_areas", "J23", """SELECT submission, array_to_string(list_filter(['ECONOMY','NONE','SMALL'], lambda x: NOT list_contains(a, x)), ', ') AS missing FROM (SELECT p_brand AS submission, list(DISTINCT p_type) AS a FROM part GROUP BY 1) UNION ALL SELECT 'none', 'ECONOMY, NONE, SMALL'""")
def _(t):
    f = t.part.select(F.col("p_brand").alias("submission"), F.col("p_type").alias("area_id"))
    return J.missing_areas(f, ["SMALL", "ECONOMY", "NONE"], submissions=B.with_empty(f, "none"))


PATHS = "(SELECT CASE c_custkey % 5 WHEN 0 THEN 'submissions/u' || c_nationkey || '/p/a.json' WHEN 1 THEN './submissions/u' || c_nationkey || '//q/b/c.md' WHEN 2 THEN 'docs/x.md' WHEN 3 THEN ' ' ELSE 'submissions/short' END AS path FROM customer)"
NORM = f"(SELECT DISTINCT path FROM (SELECT regexp_replace(regexp_replace(trim(path), '^(\\./)+', ''), '/+', '/', 'g') AS path FROM {PATHS}) WHERE path <> '')"


@query("normalized_paths", "U6", f"SELECT path FROM {NORM}")
def _(t):
    return J.norm_paths(t.sql(f"SELECT * FROM {PATHS}"))


@query("touched_proposals", "J25", f"SELECT DISTINCT array_to_string(string_split(path, '/')[1:3], '/') || '/proposal.md' AS proposal FROM {NORM} WHERE path LIKE 'submissions/%/%'")
def _(t):
    return J.touched(J.norm_paths(t.sql(f"SELECT * FROM {PATHS}")))


SNAP_R = 200.0


@query("snap_to_segment", "J13", f"""WITH v AS (SELECT point_id AS vertex_id, lon, lat FROM {B.POINTS}),
    s AS (SELECT s_suppkey AS segment_id, 116.25 + (s_suppkey * 7 % 200)::DOUBLE / 1000 AS x1, 39.9 + (s_suppkey * 11 % 150)::DOUBLE / 1000 AS y1, 116.25 + (s_suppkey * 7 % 200)::DOUBLE / 1000 + 0.006 AS x2, 39.9 + (s_suppkey * 11 % 150)::DOUBLE / 1000 + 0.003 AS y2 FROM supplier),
    p AS (SELECT v.*, segment_id, x1 + t * (x2 - x1) AS px, y1 + t * (y2 - y1) AS py FROM (SELECT v.*, s.*, greatest(0.0, least(1.0, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM v, s) v),
    d AS (SELECT *, sqrt((lon - px) ** 2 + (lat - py) ** 2) AS d FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY vertex_id ORDER BY d, segment_id) AS rn FROM d WHERE d < {SNAP_R} / (111320.0 * cos(radians(lat))))
    SELECT v.vertex_id, round(b.px, 7) AS snap_lon, round(b.py, 7) AS snap_lat FROM v LEFT JOIN b ON b.vertex_id = v.vertex_id AND rn = 1""")
def _(t):
    v = B.points(t).select(F.col("point_id").alias("vertex_id"), "lon", "lat")
    x, y = F.lit(116.25) + (F.col("s_suppkey") * 7 % 200) / 1000, F.lit(39.9) + (F.col("s_suppkey") * 11 % 150) / 1000
    s = t.supplier.select(F.col("s_suppkey").alias("segment_id"), x.alias("x1"), y.alias("y1"), (x + 0.006).alias("x2"), (y + 0.003).alias("y2"))
    return J.snap(v, s, SNAP_R).select("vertex_id", F.round("snap_lon", 7).alias("snap_lon"), F.round("snap_lat", 7).alias("snap_lat"))


@query("match_rings", "J20", f"SELECT a.pos AS part_id, b.pos AS zone_id FROM {B.FEATURES} a JOIN {B.FEATURES} b USING (x0, y0, x1, y1) WHERE a.size % 3 <> 0")
def _(t):
    r = B.with_rings(B.features(t)).select("pos", "size", F.col("rings")[0].alias("ring"))
    moved = F.transform("ring", lambda p: G.pt(p["x"] + F.when(F.col("size") % 3 == 0, 1e-6).otherwise(2e-10), p["y"]))
    return J.match_rings(r.select(F.col("pos").alias("part_id"), moved.alias("ring")), r.select(F.col("pos").alias("zone_id"), "ring")).select("part_id", "zone_id")


@query("osm_lines", "S7", """SELECT way_id, count(*)::INTEGER AS points, round(sum(lon), 6) AS lon_sum FROM (SELECT o_orderkey AS way_id, unnest([o_custkey, o_custkey + 1, o_custkey + 700]) AS node_id FROM orders) JOIN
    (SELECT c_custkey AS node_id, 116 + c_custkey::DOUBLE / 1000 AS lon FROM customer WHERE c_custkey % 3 <> 0) USING (node_id) GROUP BY way_id HAVING count(*) >= 2""")
def _(t):
    from ..sources.readers import osm_lines
    nodes = t.customer.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("node_id"), (116 + F.col("c_custkey") / 1000).alias("lon"), F.lit(40.0).alias("lat"))
    c = F.col("o_custkey")
    ways = t.orders.select(F.col("o_orderkey").alias("way_id"), F.array(c, c + 1, c + 700).alias("nodes"))
    return osm_lines(nodes, ways).select("way_id", F.size("points").alias("points"), F.round(F.aggregate("points", F.lit(0.0), lambda a, p: a + p["x"]), 6).alias("lon_sum"))


def _written(frame, part: str) -> str:
    """Folder of text files below the shared checkpoint folder, one for each value of ``part``; lines in the order of the frame's columns."""
    import uuid

    from ..session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(frame.sparkSession)}/files-{uuid.uuid4().hex}"
    order = [c for c in frame.columns if c != "value"]
    frame.repartition(part).sortWithinPartitions(*order).select(part, "value").write.partitionBy(part).text(path)
    return path


@query("json_documents", "S2", """SELECT event_id // 500 AS doc, CASE WHEN (event_id // 500) % 3 = 0 THEN NULL ELSE sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT))::BIGINT END AS k,
    CASE WHEN (event_id // 500) % 3 = 0 THEN NULL ELSE count(*) END AS rows FROM events GROUP BY 1""")
def _(t):
    """Files of 500 events as one JSON array; every third file lacks its end."""
    from ..sources.readers import read_json_docs
    doc, last = F.floor(F.col("event_id") / 500), F.max("event_id").over(Window.partitionBy("doc"))
    rows = t.events.select("event_id", doc.alias("doc"), "props").withColumn("last", last)
    opened = F.when(F.row_number().over(Window.partitionBy("doc").orderBy("event_id")) == 1, "[").otherwise("")
    closed = F.when(F.col("event_id") < F.col("last"), ",").when(F.col("doc") % 3 == 0, "").otherwise("]")
    lines = rows.select("doc", "event_id", F.concat(opened, "props", closed).alias("value"))
    docs = read_json_docs(t.spark, _written(lines, "doc") + "/doc=*")
    items = F.try_variant_get("doc", "$", "array<variant>")
    total = F.aggregate(items, F.lit(0).cast("bigint"), lambda a, v: a + F.try_variant_get(v, "$.k", "bigint"))
    return docs.select(F.regexp_extract("file", "doc=([0-9]+)", 1).cast("bigint").alias("doc"), total.alias("k"),
                       F.when(items.isNotNull(), F.size(items)).cast("bigint").alias("rows"))


@query("metric_layouts", "F43", "SELECT p_partkey, CASE WHEN p_size % 6 = 5 THEN NULL ELSE p_retailprice END AS value FROM part")
def _(t):
    from ..sources.readers import metric_values
    v = F.col("p_retailprice")
    k = F.col("p_size") % 6
    text = (F.when(k == 0, F.format_string('{"m":%s}', v)).when(k == 1, F.format_string('{"m":{"value":%s}}', v))
            .when(k == 2, F.format_string('{"metrics":{"m":{"value":%s}}}', v)).when(k == 3, F.format_string('[{"metric":"x","value":1},{"metric":"m","value":%s}]', v))
            .when(k == 4, F.format_string('[{"m":%s}]', v)).otherwise('{"m":true}'))
    return t.part.select("p_partkey", metric_values(F.try_parse_json(text), "m").alias("value"))


@query("matrix_layouts", "F44", "SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN 'none' ELSE 'r' || p_size END AS first_id FROM part")
def _(t):
    from ..sources.readers import matrix_entries
    row = F.format_string('[{"requirement_id":"r%d"}]', F.col("p_size"))
    k = F.col("p_size") % 4
    text = F.when(k == 0, row).when(k == 1, F.concat(F.lit('{"entries":'), row, F.lit("}"))).when(k == 2, F.concat(F.lit('{"requirements":'), row, F.lit("}"))).otherwise("{}")
    e = F.get(matrix_entries(F.try_parse_json(text)), F.lit(0))
    return t.part.select("p_partkey", F.coalesce(F.try_variant_get(e, "$.requirement_id", "string"), F.lit("none")).alias("first_id"))


@query("enum_layouts", "F45", "SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN 'k' || p_size ELSE 'c' || p_size || '|d' END AS codes FROM part")
def _(t):
    from ..sources.readers import enum_codes
    rows = F.format_string('[{"code":"c%d"},{"code":"d"}]', F.col("p_size"))
    k = F.col("p_size") % 3
    text = F.when(k == 0, rows).when(k == 1, F.concat(F.lit('{"classes":'), rows, F.lit("}"))).otherwise(F.format_string('{"k%d":1}', F.col("p_size")))
    return t.part.select("p_partkey", F.array_join(enum_codes(F.try_parse_json(text)), "|").alias("codes"))


@query("layer_scan", "S1", """SELECT o_custkey AS file, 'feature' AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'f' || o_orderkey ELSE 'feature-' || pos END AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders WHERE o_custkey % 20 <> 3) WHERE o_orderkey % 5 <> 0
    UNION ALL SELECT o_custkey, 'GEOMETRY_PARSE', CASE WHEN o_orderkey % 2 = 0 THEN 'f' || o_orderkey ELSE 'feature-' || pos END FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders WHERE o_custkey % 20 <> 3) WHERE o_orderkey % 5 = 0
    UNION ALL SELECT DISTINCT o_custkey, 'LAYER_JSON', NULL FROM orders WHERE o_custkey % 20 = 3""")
def _(t):
    from ..sources.readers import parse_layers
    geometry = F.when(F.col("o_orderkey") % 5 == 0, '{"type":"Blob"}').otherwise('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}')
    feature = F.concat(F.lit('{"type":"Feature",'), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('"id":"f'), F.col("o_orderkey"), F.lit('",'))).otherwise(""),
                       F.lit('"properties":{"a":1},"geometry":'), geometry, F.lit("}"))
    files = t.orders.select("o_custkey", "o_orderkey", feature.alias("f")).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "f"))).alias("fs"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("fs", lambda x: x["f"]), ","), F.when(F.col("o_custkey") % 20 == 3, "").otherwise("]}"))
    features, issues = parse_layers(files.select(F.col("o_custkey").alias("file"), text.alias("text")))
    return features.select("file", F.lit("feature").alias("kind"), F.col("feature_id").alias("id")).unionByName(issues.select("file", F.col("check_id").alias("kind"), F.col("feature_id").alias("id")))


@query("standard_point_columns", "S3", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS addr, CAST(c_nationkey AS VARCHAR) AS lon FROM customer")
def _(t):
    from ..plans.corridor import standard_columns
    df = t.customer.select("c_custkey", F.col("c_nationkey").cast("string").alias("lon_wgs84"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise("").alias("地址"), F.col("c_name").alias("geocode_query"))
    return standard_columns(df).select("c_custkey", F.col("_addr").alias("addr"), F.col("_lon").alias("lon"))


@query("query_lines", "S5", "SELECT DISTINCT trim(p_name) AS query FROM part WHERE p_size % 3 <> 0")
def _(t):
    from ..sources.readers import query_lines
    raw = F.when(F.col("p_size") % 6 == 0, "  ").when(F.col("p_size") % 6 == 3, F.concat(F.lit(" #"), "p_name")).otherwise(F.concat(F.lit(" "), "p_name", F.lit("\t")))
    return query_lines(t.part.select(raw.alias("value")))


@query("open_notices", "S9", """SELECT c_custkey, '京土储挂（海）[2019]' || c_custkey || '号' AS notice_no FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 10 <> 1""")
def _(t):
    from ..sources.readers import open_notices
    n = t.customer.select("c_custkey", F.concat(F.lit("京土整储挂（海）[2019]"), "c_custkey", F.lit("号")).alias("landid"), F.when(F.col("c_custkey") % 4 != 0, "zip").alias("memo2"))
    done = t.customer.filter("c_custkey % 10 = 1").select(F.concat(F.lit("京土储挂（海）[2019]"), "c_custkey", F.lit("号")).alias("notice_no"))
    return open_notices(n, done).select("c_custkey", "notice_no")


@query("dimension_rows", "S16", "SELECT 'd' || n_nationkey AS id, n_name AS title FROM nation")
def _(t):
    from ..sources.readers import dimension
    doc = F.format_string('{"tracks":[{"id":" d%d ","title":"%s"},{"id":""}]}', F.col("n_nationkey"), F.col("n_name"))
    docs = t.nation.select(F.try_parse_json(doc).alias("doc"))
    return dimension(docs, F.try_variant_get("doc", "$.tracks", "array<variant>"))


@query("package_listing", "S17", "SELECT 'd/f' || p_partkey AS path, p_size::BIGINT AS length FROM part WHERE p_size % 5 <> 0")
def _(t):
    from ..sources.readers import relative_listing
    name = F.when(F.col("p_size") % 10 == 0, "exhibit.json").when(F.col("p_size") % 10 == 5, "a/.DS_Store").otherwise(F.concat(F.lit("d/f"), "p_partkey"))
    return relative_listing(t.part.select(F.concat(F.lit("file:/r/pkg/"), name).alias("path"), F.col("p_size").cast("bigint").alias("length")), "/r/pkg")


@query("package_hashes", "S8", """SELECT file, octet_length(encode(body))::BIGINT AS length, sha256(body) AS sha256 FROM
    (SELECT doc_id // 50 AS file, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS body FROM documents GROUP BY 1)""")
def _(t):
    """Files of 50 texts each, hashed as the scan finds them."""
    from ..sources.readers import package_files
    lines = t.documents.select(F.floor(F.col("doc_id") / 50).alias("file"), "doc_id", F.col("text").alias("value"))
    files = package_files(t.spark, _written(lines, "file"))
    return files.filter(F.col("path").contains("file=")).select(
        F.regexp_extract("path", "file=([0-9]+)", 1).cast("bigint").alias("file"), "length", "sha256")
