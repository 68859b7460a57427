"""Queries of the rule checks."""

from pyspark.sql import functions as F

from .. import params as P
from ..operators import checks as K
from .bindings import with_empty
from .registry import query

# ---- registry rows from customer -----------------------------------------------------------
REG = """(SELECT c_custkey AS pos, CASE WHEN c_custkey % 11 = 0 THEN 'bad id' ELSE 'SRC-' || (c_custkey % 1400) END AS source_id,
    CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE c_name END AS title, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'pub' END AS publisher,
    CASE c_nationkey % 4 WHEN 0 THEN 'official_news' WHEN 1 THEN 'media_report' WHEN 2 THEN 'official_standard' ELSE 'odd' END AS source_kind,
    CASE WHEN c_custkey % 9 = 0 THEN '/abs/../x' WHEN c_custkey % 9 = 1 THEN 'data/x.json' ELSE 'https://x.org/' || c_custkey END AS url,
    CASE WHEN c_custkey % 17 = 0 THEN '2026/01/01' ELSE '2026-01-02' END AS accessed_date,
    CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN '2026' ELSE '2025-05-05' END AS published_date, 'html' AS file_type,
    CASE c_nationkey % 5 WHEN 0 THEN 'A0' WHEN 1 THEN 'A1' WHEN 2 THEN 'PROVISIONAL_REPOSITORY' WHEN 3 THEN NULL ELSE 'A3' END AS authority_level,
    CASE WHEN c_custkey % 23 = 0 THEN 'T9' ELSE 'T1' END AS timeliness_level,
    CASE c_custkey % 4 WHEN 0 THEN 'public_url' WHEN 1 THEN 'restricted_or_unknown' WHEN 2 THEN 'cleared_for_repo' ELSE 'public_local_snapshot' END AS public_access_status,
    CASE WHEN c_custkey % 29 = 0 THEN ' no ' ELSE 'license text' END AS license_summary,
    CASE c_custkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'provisional' ELSE 'needs_review' END AS review_status,
    CASE c_nationkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'background_only' WHEN 2 THEN 'provisional_only' ELSE 'no' END AS usable_for_formal,
    CASE WHEN c_custkey % 6 = 0 THEN 'a| ' WHEN c_custkey % 6 = 1 THEN NULL ELSE 'a|b' END AS uses FROM customer)"""


def registry(t):
    u = F.split("uses", r"\|")
    return t.sql(f"SELECT * FROM {REG}").withColumn("allowed_uses", u).withColumn("prohibited_uses", F.array(F.lit("x"))).withColumn(
        "topics", F.array(F.lit("x")))


def _nulls(cols):
    return " UNION ALL ".join(f"SELECT pos, '{c}' AS field FROM {REG} WHERE {c} IS NULL" for c in cols)


FIELDS = ["title", "publisher", "source_kind", "url", "accessed_date", "authority_level", "published_date"]


@query("require_fields", "P5", _nulls(FIELDS))
def _(t):
    return K.require_fields(registry(t), ["pos"], FIELDS)


@query("require_text", "P6", """SELECT c_custkey, 'a' AS field FROM customer WHERE c_custkey % 5 = 0
    UNION ALL SELECT c_custkey, 'b' FROM customer WHERE c_custkey % 3 <> 2""")
def _(t):
    df = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "  \t").otherwise("x").alias("a"),
                           F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).when(F.col("c_custkey") % 3 == 1, " ").otherwise("y").alias("b"))
    return K.require_text(df, ["c_custkey"], ["a", "b"])


@query("check_enum", "P7", """SELECT c_custkey, v AS value FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE
    'NATION_' || (c_nationkey + c_custkey % 3) END AS v FROM customer) WHERE v <> '' AND v NOT IN (SELECT n_name FROM nation)""")
def _(t):
    v = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("NATION_"), F.col("c_nationkey") + F.col("c_custkey") % 3))
    return K.check_enum(t.customer.select("c_custkey", v.alias("v")), ["c_custkey"], "v", t.nation.select("n_name"))


# ---- features from part ---------------------------------------------------------------------
FEAT = """(SELECT p_brand AS submission, p_type || '.geojson' AS layer_file, p_partkey AS pos,
    CASE WHEN p_partkey % 31 = 0 THEN '' ELSE 'f' || (p_partkey % 1900) END AS feature_id,
    CASE WHEN p_partkey % 37 = 0 THEN 'Thing' ELSE 'Feature' END AS feature_type, CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE 'i' END AS id,
    CASE p_size % 7 WHEN 0 THEN 'SITE_BOUNDARY' WHEN 1 THEN 'KEY_AREA' WHEN 2 THEN 'KEY_AREA-1' WHEN 3 THEN 'LAND_USE' WHEN 4 THEN 'LOCK' WHEN 5 THEN '' ELSE 'ODD' END AS layer,
    CASE p_size % 5 WHEN 0 THEN 'official_public' WHEN 1 THEN 'osm' WHEN 2 THEN 'user_provided_cleared' WHEN 3 THEN '' ELSE 'weird' END AS source_type,
    CASE p_size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'unknown' ELSE 'medium' END AS confidence,
    CASE p_size % 3 WHEN 0 THEN 'official_constraint' WHEN 1 THEN 'provisional_constraint' ELSE 'design' END AS geometry_role,
    CASE p_partkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS official_boundary,
    CASE WHEN p_partkey % 2 = 0 THEN 'rough' ELSE NULL END AS boundary_precision,
    CASE WHEN p_size % 6 = 0 THEN NULL WHEN p_size % 6 = 1 THEN '' ELSE '0' || (p_size % 10) END AS land_use_code,
    CASE WHEN p_size % 8 = 0 THEN 'alley' ELSE 'arterial' END AS road_class, CASE WHEN p_size % 9 = 0 THEN 'hut' ELSE '' END AS building_type,
    CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN NULL ELSE CAST(p_size * 12 AS {text}) END AS height_m,
    CASE WHEN p_partkey % 10 = 0 THEN 'tall' ELSE NULL END AS building_height_m, CASE WHEN p_partkey % 15 = 1 THEN '30' ELSE NULL END AS height,
    CASE p_partkey % 4 WHEN 0 THEN 'LineString' WHEN 1 THEN 'Polygon' WHEN 2 THEN 'MultiLineString' ELSE 'Point' END AS geom_type,
    'area' || (p_partkey % 2) AS area_id FROM part)"""
FEAT_SQL, FEAT_SPARK = FEAT.replace("{text}", "VARCHAR"), FEAT.replace("{text}", "STRING")


def feats(t):
    return t.sql(f"SELECT * FROM {FEAT_SPARK}")


@query("land_use_code", "P8", f"""SELECT pos, land_use_code, CASE WHEN coalesce(land_use_code, '') = '' THEN 'missing' ELSE 'unknown' END AS reason
    FROM {FEAT_SQL} WHERE coalesce(land_use_code, '') = '' OR land_use_code NOT IN (SELECT '0' || r_regionkey FROM region)""")
def _(t):
    codes = t.region.select(F.concat(F.lit("0"), F.col("r_regionkey")).alias("code"))
    return K.check_land_use_code(feats(t), ["pos"], codes)


DIMS = {"layer": ["SITE_BOUNDARY", "KEY_AREA", "LAND_USE"], "source_type": ["official_public", "osm", "user_provided_cleared"],
        "confidence": ["high", "low", "medium"], "geometry_role": ["official_constraint", "provisional_constraint"],
        "land_use_code": ["01", "02", "03"], "road_class": ["arterial"], "building_type": ["tower"]}


def _enums(source, key, dims, empty_ok):
    return " UNION ALL ".join(
        f"SELECT {key}, '{c}' AS field, {c} AS value FROM {source} WHERE " + (
            f"{c} <> '' AND {c} NOT IN ({str(v)[1:-1]})" if empty_ok else f"({c} IS NULL OR {c} NOT IN ({str(v)[1:-1]}))")
        for c, v in dims.items())


@query("feature_enums", "P9", _enums(FEAT_SQL, "pos", DIMS, True).replace("('tower')", "('tower','')"))
def _(t):
    return K.check_value_lists(feats(t), ["pos"], DIMS)


@query("registry_enums", "P10", _enums(REG, "pos", P.REGISTRY_ENUMS, False))
def _(t):
    return K.check_registry_enums(registry(t), ["pos"])


@query("check_format", "P11", f"SELECT pos, source_id AS value FROM {REG} WHERE NOT regexp_matches(source_id, '^[A-Z0-9][A-Z0-9_-]+$')")
def _(t):
    return K.check_format(registry(t), ["pos"], "source_id", P.REGISTRY_ID_PATTERN)


CROSS = f"""SELECT pos, 'RESTRICTED_APPROVED' AS check_id, 'error' AS severity, '' AS detail FROM {REG} WHERE review_status = 'approved' AND public_access_status = 'restricted_or_unknown'
    UNION ALL SELECT pos, 'FORMAL_NOT_APPROVED', 'error', '' FROM {REG} WHERE usable_for_formal = 'yes' AND review_status <> 'approved'
    UNION ALL SELECT pos, 'PROVISIONAL_REPOSITORY_FORMAL', 'error', '' FROM {REG} WHERE usable_for_formal = 'yes' AND authority_level = 'PROVISIONAL_REPOSITORY'
    UNION ALL SELECT pos, 'PROVISIONAL_FORMAL', 'error', '' FROM {REG} WHERE usable_for_formal = 'yes' AND review_status = 'provisional'
    UNION ALL SELECT pos, 'PUBLIC_URL_NOT_HTTP', 'error', '' FROM {REG} WHERE public_access_status IN ('public_url','public_local_snapshot') AND url NOT LIKE 'http%'
    UNION ALL SELECT pos, 'LICENSE_TOO_SHORT', 'error', '' FROM {REG} WHERE length(trim(license_summary)) < 5
    UNION ALL SELECT pos, 'NEEDS_REVIEW', 'warning', '' FROM {REG} WHERE review_status = 'needs_review'"""


@query("registry_cross_rules", "P12", CROSS)
def _(t):
    return K.check_registry_cross(registry(t), ["pos"])


@query("string_array", "P13", f"SELECT pos, 'allowed_uses' AS field FROM {REG} WHERE uses IS NULL OR uses = 'a| '")
def _(t):
    return K.check_string_array(registry(t), ["pos"], ["allowed_uses", "topics"])


@query("registry_validation", "C18", f"""SELECT pos, 'FIELD_MISSING' AS check_id, field AS detail FROM ({_nulls(
    ["title", "publisher", "source_kind", "url", "accessed_date", "authority_level"])} UNION ALL SELECT pos, 'allowed_uses' FROM {REG} WHERE uses IS NULL)
    UNION ALL SELECT pos, 'ENUM', field FROM ({_enums(REG, "pos", P.REGISTRY_ENUMS, False)})
    UNION ALL SELECT pos, 'ID_FORM', source_id FROM {REG} WHERE source_id = 'bad id' UNION ALL SELECT pos, 'ACCESSED_DATE', accessed_date FROM {REG} WHERE contains(accessed_date, '/')
    UNION ALL SELECT pos, 'PUBLISHED_DATE', published_date FROM {REG} WHERE published_date = '2026'
    UNION ALL SELECT pos, 'STRING_ARRAY', 'allowed_uses' FROM {REG} WHERE uses IS NULL OR uses = 'a| ' UNION ALL SELECT pos, 'CROSS', check_id FROM ({CROSS})
    UNION ALL SELECT pos, 'LOCAL_PATH', url FROM {REG} WHERE public_access_status = 'cleared_for_repo' AND url <> 'data/x.json'
    UNION ALL SELECT pos, 'DUPLICATE_ID', source_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY pos) AS rn FROM {REG}) WHERE rn > 1""")
def _(t):
    return K.check_registry(registry(t), ["pos"])


@query("duplicate_ids", "W5", """SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus
    ORDER BY o_orderkey) AS rn FROM orders) WHERE rn > 1""")
def _(t):
    from ..scale import later_duplicates
    return later_duplicates(t.orders, ["o_custkey", "o_orderstatus"], "o_orderkey").select("o_orderkey", "o_custkey")


IDX = """(SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 9 = 0 THEN 'Bad!' ELSE 'src-' || (s_suppkey % 90) END AS id, s_name AS title,
    CASE s_nationkey % 4 WHEN 0 THEN 'brief' WHEN 1 THEN 'policy' WHEN 2 THEN '' ELSE 'blog' END AS type, 'p' AS publisher, '2026' AS published_at,
    CASE WHEN s_nationkey % 3 = 0 THEN 'secret' ELSE 'public-draft' END AS public_status, CASE WHEN s_suppkey % 7 = 0 THEN ' ' ELSE 'c' END AS citation,
    'u' AS usage_note, 'r' AS risk_note, CASE s_suppkey % 4 WHEN 0 THEN 'a/' || (s_suppkey % 8) WHEN 1 THEN '../b' ELSE NULL END AS path,
    CASE s_suppkey % 3 WHEN 0 THEN 'http://x' WHEN 1 THEN 'https://y' ELSE NULL END AS url FROM supplier)"""


def index_rows(t):
    return t.sql(f"SELECT * FROM {IDX}").withColumn("extra", F.when(F.col("pos") % 5 == 0, F.create_map(F.lit("color"), F.lit("red"))))


INDEX_SQL = f"""SELECT pos, 'ID_FORM' AS check_id, 'major' AS severity, id AS detail FROM {IDX} WHERE id = 'Bad!'
    UNION ALL SELECT pos, 'TYPE', 'major', type FROM {IDX} WHERE type = 'blog' UNION ALL SELECT pos, 'PUBLIC_STATUS', 'major', public_status FROM {IDX} WHERE public_status = 'secret'
    UNION ALL SELECT pos, 'FIELD_MISSING', 'major', 'citation' FROM {IDX} WHERE citation = ' ' UNION ALL SELECT pos, 'FIELD_MISSING', 'major', 'type' FROM {IDX} WHERE type = ''
    UNION ALL SELECT pos, 'PATH_OR_URL', 'major', '' FROM {IDX} WHERE path IS NULL AND url IS NULL
    UNION ALL SELECT pos, 'UNSAFE_PATH', 'major', path FROM {IDX} WHERE path = '../b' UNION ALL SELECT pos, 'URL_NOT_HTTPS', 'major', url FROM {IDX} WHERE url = 'http://x'
    UNION ALL SELECT pos, 'UNSUPPORTED_FIELD', 'major', 'color' FROM {IDX} WHERE pos % 5 = 0
    UNION ALL SELECT pos, 'DUPLICATE_ID', 'major', id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM {IDX}) WHERE rn > 1"""


@query("source_index_rows", "P14", INDEX_SQL)
def _(t):
    return K.check_source_index(index_rows(t), ["pos"], extra="extra")


@query("source_index_validation", "C19", INDEX_SQL + f" UNION ALL SELECT pos, 'PATH_MISSING', 'major', path FROM {IDX} WHERE path = 'a/4'")
def _(t):
    files = t.supplier.filter("s_suppkey % 8 = 0").select(F.concat(F.lit("a/"), F.col("s_suppkey") % 8).alias("path"))
    return K.check_source_index(index_rows(t), ["pos"], files, "extra")


PATHS = "CASE p_partkey % 6 WHEN 0 THEN '/abs' WHEN 1 THEN 'a/../b' WHEN 2 THEN 'http://x' WHEN 3 THEN 'ok/' || p_name WHEN 4 THEN ' ' ELSE 'a..b/c' END"


@query("safe_path", "P15", "SELECT p_partkey, p_partkey % 6 IN (3, 5) AS ok FROM part")
def _(t):
    return t.sql(f"SELECT p_partkey, {PATHS} AS p FROM part").select("p_partkey", K.safe_path(F.col("p")).alias("ok"))


# ---- metrics from lineitem per nation-like submission ----------------------------------------
MET = """(SELECT 'S' || (l_suppkey % 25) AS submission, l_returnflag || l_linestatus AS metric, sum(l_quantity) AS value, count(*) AS n
    FROM lineitem WHERE l_suppkey % 25 <> 3 OR l_returnflag <> 'A' GROUP BY 1, 2)"""


def metrics(t):
    return t.sql(f"SELECT * FROM {MET}")


def _rules(t):
    return t.sql("SELECT 'C-' || r_name AS rule_id, CASE r_regionkey WHEN 0 THEN 'AF' WHEN 1 THEN 'NO' WHEN 2 THEN 'RF' WHEN 3 THEN 'AO' ELSE 'none' END AS metric,"
                 " CASE WHEN r_regionkey = 1 THEN NULL ELSE CAST(1000 AS DOUBLE) END AS min_val, CASE WHEN r_regionkey = 2 THEN NULL ELSE CAST(15100 AS DOUBLE) END AS max_val,"
                 " CASE WHEN r_regionkey = 3 THEN NULL ELSE CAST(15000 AS DOUBLE) END AS declared, CASE WHEN r_regionkey = 0 THEN CAST(20 AS DOUBLE) ELSE NULL END AS tolerance_pct FROM region")


RULES = """(SELECT 'C-' || r_name AS rule_id, CASE r_regionkey WHEN 0 THEN 'AF' WHEN 1 THEN 'NO' WHEN 2 THEN 'RF' WHEN 3 THEN 'AO' ELSE 'none' END AS metric,
    CASE WHEN r_regionkey = 1 THEN NULL ELSE 1000.0::DOUBLE END AS min_val, CASE WHEN r_regionkey = 2 THEN NULL ELSE 15100.0::DOUBLE END AS max_val,
    CASE WHEN r_regionkey = 3 THEN NULL ELSE 15000.0::DOUBLE END AS declared, CASE WHEN r_regionkey = 0 THEN 20.0::DOUBLE END AS tolerance_pct FROM region)"""
BESIDE = f"(SELECT s.submission, r.*, m.value FROM (SELECT DISTINCT submission FROM {MET}) s CROSS JOIN {RULES} r LEFT JOIN {MET} m USING (submission, metric))"


@query("metric_bounds", "P16", f"""SELECT submission, rule_id, metric, value, CASE WHEN value IS NULL THEN 'SKIP'
    WHEN value < coalesce(min_val, value) OR value > coalesce(max_val, value) THEN 'FAIL' ELSE 'PASS' END AS outcome FROM {BESIDE}""")
def _(t):
    m = metrics(t)
    return K.check_bounds(m, m, _rules(t))


@query("area_tolerance", "P17", f"""SELECT submission, rule_id, metric, round(abs(value - declared) / declared * 100, 6) AS delta_pct, CASE WHEN declared IS NULL THEN 'SKIP'
    WHEN value IS NULL THEN 'FAIL' WHEN abs(value - declared) / declared * 100 <= coalesce(tolerance_pct, 5) THEN 'PASS' ELSE 'FAIL' END AS outcome FROM {BESIDE}""")
def _(t):
    m = metrics(t)
    return K.check_area_tolerance(m, m, _rules(t)).withColumn("delta_pct", F.round("delta_pct", 6))


MROW = """(SELECT p_partkey AS pos, p_brand AS submission, p_name AS metric, CASE p_size % 5 WHEN 0 THEN 'known' WHEN 1 THEN 'unknown' WHEN 2 THEN 'not_applicable' WHEN 3 THEN NULL ELSE 'maybe' END AS status,
    CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice / 1000 END AS value, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'r' END AS reason,
    CASE WHEN p_partkey % 2 = 0 THEN 'ratio' ELSE 'sqm' END AS unit FROM part)"""


@query("metric_rows", "P18", f"""SELECT pos, 'METRIC_STATUS' AS check_id, 'major' AS severity, coalesce(status, '') AS detail FROM {MROW} WHERE status IS NULL OR status = 'maybe'
    UNION ALL SELECT pos, 'UNKNOWN_WITH_VALUE', 'major', '' FROM {MROW} WHERE status = 'unknown' AND value IS NOT NULL
    UNION ALL SELECT pos, 'UNKNOWN_WITHOUT_REASON', 'major', '' FROM {MROW} WHERE status = 'unknown' AND reason = ''
    UNION ALL SELECT pos, 'KNOWN_WITHOUT_VALUE', 'major', '' FROM {MROW} WHERE status = 'known' AND value IS NULL
    UNION ALL SELECT pos, 'RATIO_RANGE', 'major', '' FROM {MROW} WHERE unit = 'ratio' AND (value < 0 OR value > 1)""")
def _(t):
    return K.check_metric_rows(t.sql(f"SELECT * FROM {MROW}"), ["pos"])


@query("metric_claims", "P19", """WITH m AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 4 = 0 THEN ' ' ELSE 'f' END AS formula,
    [p_type, 'x' || p_size] AS src FROM part WHERE p_size % 3 <> 0)
    SELECT p_brand AS submission, CAST(p_partkey AS VARCHAR) AS metric, CASE WHEN formula = ' ' THEN 'no_formula' ELSE 'no_source_file' END AS reason FROM m
    WHERE formula = ' ' OR NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT p_brand AS b, p_type AS f FROM part WHERE p_size > 47) f WHERE f.b = m.p_brand AND list_contains(m.src, f.f))""")
def _(t):
    m = t.part.select(F.col("p_brand").alias("submission"), F.col("p_partkey").cast("string").alias("metric"),
                      F.when(F.col("p_size") % 3 == 0, "unknown").otherwise("known").alias("status"),
                      F.when(F.col("p_size") % 4 == 0, " ").otherwise("f").alias("formula"),
                      F.array("p_type", F.concat(F.lit("x"), "p_size")).alias("source_files"))
    files = t.part.filter("p_size > 47").select(F.col("p_brand").alias("submission"), F.col("p_type").alias("path"))
    return K.check_metric_claims(m, files)


@query("provisional_marking", "P20", f"""SELECT pos, CASE WHEN official_boundary IS DISTINCT FROM FALSE THEN 'official_boundary' ELSE 'boundary_precision' END AS reason
    FROM {FEAT_SQL} WHERE geometry_role = 'provisional_constraint' AND (official_boundary IS DISTINCT FROM FALSE OR coalesce(boundary_precision, '') = '')""")
def _(t):
    return K.check_provisional(feats(t), ["pos"])


@query("locked_layers", "P21", f"SELECT pos, layer FROM {FEAT_SQL} WHERE layer = 'LOCK'")
def _(t):
    return K.check_locked(feats(t), ["pos"], ["LOCK", "SITE_BOUNDARY"])


@query("layer_names", "P22", f"SELECT pos, layer FROM {FEAT_SQL} WHERE layer IN ('ODD', 'LOCK')")
def _(t):
    return K.check_layer_names(feats(t), ["pos"], ["SITE_BOUNDARY", "LAND_USE"])


@query("required_layers", "P23", """SELECT submission, CASE WHEN a AND c THEN 'PASS' ELSE 'FAIL' END AS outcome,
    array_to_string(list_filter([CASE WHEN NOT a THEN 'STANDARD' END, CASE WHEN NOT c THEN 'GONE' END], lambda x: x IS NOT NULL), ', ') AS missing,
    CASE WHEN o THEN '' ELSE 'SITE_BOUNDARY' END AS skipped FROM (SELECT p_brand AS submission, bool_or(p_type = 'STANDARD') AS a,
    bool_or(p_size = 50 AND p_type = 'ECONOMY') AS c, bool_or(false) AS o FROM part GROUP BY 1) UNION ALL SELECT 'none', 'FAIL', 'STANDARD, GONE', 'SITE_BOUNDARY'""")
def _(t):
    f = t.part.select(F.col("p_brand").alias("submission"), F.concat(F.lit("geometry/"), F.when(
        (F.col("p_size") == 50) & (F.col("p_type") == "ECONOMY"), "gone_alias").otherwise(F.lower("p_type")), F.lit(".geojson")).alias("path"))
    g = t.part.filter("p_type = 'ECONOMY'").select(F.col("p_brand").alias("submission"), F.lit("geometry/economy.geojson").alias("path"))
    return K.check_required_layers(f.unionByName(g), ["STANDARD", "GONE", "SITE_BOUNDARY"], {"GONE": "gone_alias.geojson"},
                                   submissions=with_empty(f, "none"))


@query("building_heights", "P30", f"""SELECT pos, raw AS value, CASE WHEN raw IS NULL THEN 'missing' WHEN TRY_CAST(raw AS DOUBLE) IS NULL THEN 'not_a_number' ELSE 'out_of_range' END AS reason
    FROM (SELECT pos, coalesce(nullif(height_m, ''), nullif(building_height_m, ''), height) AS raw FROM {FEAT_SQL})
    WHERE raw IS NULL OR TRY_CAST(raw AS DOUBLE) IS NULL OR TRY_CAST(raw AS DOUBLE) NOT BETWEEN 1 AND 500""")
def _(t):
    return K.check_heights(feats(t), ["pos"])


@query("road_network", "P31", f"""SELECT submission, count(*) FILTER (WHERE geom_type LIKE '%Line%') AS road_lines,
    CASE WHEN count(*) FILTER (WHERE geom_type LIKE '%Line%') < 40 THEN 'FAIL' ELSE 'PASS' END AS outcome FROM {FEAT_SQL} GROUP BY 1""")
def _(t):
    return K.check_roads(feats(t), 40)


FILES = """(SELECT o_custkey AS author, CASE o_orderkey % 8 WHEN 0 THEN 'submissions/u/p/proposal.md' WHEN 1 THEN 'submissions/u/p/metrics.json' WHEN 2 THEN 'submissions/u/p/geometry/a.geojson'
    WHEN 3 THEN 'submissions/u/p/assets/a.png' WHEN 4 THEN 'submissions/u/p/drawings/a.pdf' WHEN 5 THEN 'submissions/u/p/report/a.html'
    WHEN 6 THEN 'submissions/u/p/visual/index.html' ELSE 'submissions/u/p/visual/assets/a.js' END AS path, CAST(floor(o_totalprice * 30) AS BIGINT) AS length FROM orders)"""


@query("file_sizes", "P36", f"""SELECT author, path, 'SIZE' AS check_id, 'major' AS severity, c AS detail FROM (SELECT *, unnest(list_filter([
    CASE WHEN path LIKE '%.md' AND length > 262144 THEN 'markdown' END, CASE WHEN path LIKE '%.json' AND length > 524288 THEN 'json' END,
    CASE WHEN path LIKE '%.geojson' AND length > 10485760 THEN 'geojson' END, CASE WHEN path LIKE '%/p/assets/%' AND length > 5242880 THEN 'assets' END,
    CASE WHEN path LIKE '%/drawings/%' AND length > 10485760 THEN 'drawings' END, CASE WHEN path LIKE '%.html' AND length > 2097152 THEN 'html' END,
    CASE WHEN path LIKE '%/visual/assets/%' AND length > 5242880 THEN 'visual' END], lambda x: x IS NOT NULL)) AS c FROM {FILES})
    UNION ALL SELECT author, '', 'TOTAL_SIZE', 'major', sum(length)::VARCHAR FROM {FILES} GROUP BY author HAVING sum(length) > 20971520""")
def _(t):
    return K.check_sizes(t.sql(f"SELECT * FROM {FILES}"), ["author"])


CHG = """(SELECT c_custkey, 'Alice' AS author, CASE c_custkey % 14 WHEN 0 THEN '.maintainer-review/x' WHEN 1 THEN 'submissions/README.md' WHEN 2 THEN 'gallery-publication.json' WHEN 3 THEN 'src/x.py'
    WHEN 4 THEN 'submissions/bob/p-one/proposal.md' WHEN 5 THEN 'submissions/alice/x.md' WHEN 6 THEN 'submissions/ALICE/BadSlug/proposal.md' WHEN 7 THEN 'submissions/alice/p-one/proposal.md'
    WHEN 8 THEN 'submissions/alice/p-one/assets/a.exe' WHEN 9 THEN 'submissions/alice/p-one/geometry/zz.geojson' WHEN 10 THEN 'submissions/alice/p-one/drawings/a.png'
    WHEN 11 THEN 'submissions/alice/p-one/report/x.txt' WHEN 12 THEN 'submissions/alice/p-one/visual/assets/a.exe' ELSE 'submissions/alice/p-one/other.bin' END AS path FROM customer)"""


@query("path_rules", "P37", f"""SELECT * FROM (SELECT c_custkey, path, CASE c_custkey % 14 WHEN 0 THEN 'REVIEW_ARTIFACT' WHEN 1 THEN 'MAINTAINER_ONLY' WHEN 2 THEN 'PROTECTED_FILE' WHEN 3 THEN 'OUTSIDE_SUBMISSIONS'
    WHEN 4 THEN 'NOT_OWNER' WHEN 5 THEN 'TOO_SHALLOW' WHEN 6 THEN 'SLUG_FORM' WHEN 7 THEN NULL WHEN 8 THEN 'ASSET_EXTENSION' WHEN 9 THEN 'GEOMETRY_NAME' WHEN 10 THEN 'DRAWING_EXTENSION'
    WHEN 11 THEN 'REPORT_NAME' WHEN 12 THEN 'VISUAL_EXTENSION' ELSE 'PLACEMENT' END AS check_id FROM {CHG}) WHERE check_id IS NOT NULL""")
def _(t):
    return K.check_paths(t.sql(f"SELECT * FROM {CHG}"), ["c_custkey"])


LISTED = """(SELECT source AS submission, doc_id AS pos, CASE WHEN doc_id % 17 = 0 THEN '../x' WHEN doc_id % 19 = 0 THEN 'manifest.json' ELSE 'd' || (doc_id % 700) END AS path,
    CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'wrong' ELSE sha END AS sha256 FROM (SELECT source, doc_id, {sha} AS sha FROM documents))"""
DISK = """(SELECT source AS submission, CASE WHEN doc_id % 19 = 0 THEN 'manifest.json' ELSE 'd' || doc_id END AS path, max({sha}) AS sha256 FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1, 2)"""


def listed(t):
    return t.sql(f"SELECT * FROM {LISTED.replace('{sha}', 'sha2(text, 256)')}"), t.sql(f"SELECT * FROM {DISK.replace('{sha}', 'sha2(text, 256)')}")


LISTED_SQL, DISK_SQL = LISTED.replace("{sha}", "sha256(text)"), DISK.replace("{sha}", "sha256(text)")


@query("manifest_files", "P38", f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY submission, path ORDER BY pos) AS rn FROM {LISTED_SQL}),
    b AS (SELECT l.*, d.sha256 AS dsha FROM l LEFT JOIN {DISK_SQL} d USING (submission, path) WHERE path <> '../x' AND rn = 1)
    SELECT submission, path, 'UNSAFE_PATH' AS check_id FROM l WHERE path = '../x' UNION ALL SELECT submission, path, 'DUPLICATE_PATH' FROM l WHERE rn > 1 AND path <> '../x'
    UNION ALL SELECT submission, path, 'FILE_MISSING' FROM b WHERE dsha IS NULL UNION ALL SELECT submission, path, 'HASH_MISSING' FROM b WHERE dsha IS NOT NULL AND sha256 IS NULL AND path <> 'manifest.json'
    UNION ALL SELECT submission, path, 'HASH_MISMATCH' FROM b WHERE sha256 <> dsha
    UNION ALL SELECT s.submission, r.p, 'REQUIRED_UNLISTED' FROM (SELECT DISTINCT submission FROM l UNION SELECT 'none') s, (SELECT unnest(['manifest.json','d1']) AS p) r
    WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.submission = s.submission AND l.path = r.p)""")
def _(t):
    l, d = listed(t)
    return K.check_manifest_files(l, d, ["manifest.json", "d1"], with_empty(l, "none"))


@query("manifest_header", "P38", """WITH m AS (SELECT c_custkey % 6 AS k, c_nationkey % 4 AS n, c_custkey AS submission FROM customer)
    SELECT submission, 'STAGE' AS check_id, 'error' AS severity, 'draft' AS detail FROM m WHERE k = 0 UNION ALL SELECT submission, 'PACKAGE_TYPE_ABSENT', 'warning', '' FROM m WHERE k = 1
    UNION ALL SELECT submission, 'PACKAGE_TYPE', 'error', 'odd' FROM m WHERE k = 2 UNION ALL SELECT submission, 'PACKAGE_STATE_ABSENT', 'warning', '' FROM m WHERE n = 0
    UNION ALL SELECT submission, 'SCAFFOLD', 'error', '' FROM m WHERE n = 1 UNION ALL SELECT submission, 'PACKAGE_STATE', 'error', 'odd' FROM m WHERE n = 2
    UNION ALL SELECT submission, 'SUBMISSION_TYPE', 'error', '' FROM m WHERE k = 3 UNION ALL SELECT submission, 'KNOWN_BLOCKERS', 'warning', '' FROM m WHERE k = 4""")
def _(t):
    k, n = F.col("c_custkey") % 6, F.col("c_nationkey") % 4
    m = t.customer.select(F.col("c_custkey").alias("submission"), F.when(k == 0, "draft").otherwise("formal").alias("submission_stage"),
                          F.when(k == 2, "odd").when(k != 1, "professional_design_package").alias("package_type"),
                          F.when(n == 1, "scaffold").when(n == 2, "odd").when(n == 3, "ready_for_review").alias("package_state"),
                          F.when(k != 3, "ai_agent").alias("submission_type"), F.when(k == 4, F.array(F.lit("b"))).alias("known_blockers"))
    return K.check_manifest(m)


RISK = """(SELECT c_nationkey AS submission, c_custkey AS pos, CASE WHEN c_custkey % 7 = 0 THEN 'odd' WHEN c_custkey % 7 < 4 THEN 'data_privacy' ELSE 'policy_uncertainty' END AS id,
    CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE 'label' END AS label, CASE c_custkey % 8 WHEN 0 THEN 'true' WHEN 1 THEN '9' WHEN 2 THEN '4' WHEN 3 THEN '2.5' ELSE '3' END AS score,
    CASE WHEN c_custkey % 5 = 0 THEN 'short' WHEN c_custkey % 5 = 1 THEN 'call 13912345678 now' ELSE 'a long enough note' END AS note,
    CASE WHEN c_custkey % 6 = 0 THEN '' ELSE '一定实施 mitigation' END AS mitigation, CASE WHEN c_custkey % 4 = 2 THEN 'panel review' ELSE NULL END AS human_review FROM customer)"""


@query("risk_matrix_rows", "P39", f"""WITH r AS (SELECT *, CASE WHEN regexp_matches(score, '^-?[0-9]+$') THEN score::INTEGER END AS s FROM {RISK})
    SELECT submission, pos, 'RISK_UNKNOWN' AS check_id, 'error' AS severity, id AS detail FROM r WHERE id = 'odd' UNION ALL SELECT submission, pos, 'RISK_LABEL', 'error', '' FROM r WHERE label = ' '
    UNION ALL SELECT submission, pos, 'RISK_SCORE_TYPE', 'error', '' FROM r WHERE s IS NULL UNION ALL SELECT submission, pos, 'RISK_SCORE_RANGE', 'error', '' FROM r WHERE s > 5
    UNION ALL SELECT submission, pos, 'RISK_NOTE', 'error', '' FROM r WHERE s IS NOT NULL AND note = 'short' UNION ALL SELECT submission, pos, 'RISK_MITIGATION', 'error', '' FROM r WHERE s IS NOT NULL AND mitigation = ''
    UNION ALL SELECT submission, pos, 'RISK_HUMAN_REVIEW', 'error', '' FROM r WHERE s >= 4 AND human_review IS NULL
    UNION ALL SELECT submission, pos, 'HARD_RISK', 'error', '疑似手机号' FROM r WHERE s IS NOT NULL AND contains(note, '139')
    UNION ALL SELECT submission, pos, 'SOFT_RISK', 'warning', '可能存在不可执行承诺' FROM r WHERE s IS NOT NULL AND mitigation <> ''
    UNION ALL SELECT submission, pos, 'RISK_DUPLICATE', 'error', id FROM (SELECT *, row_number() OVER (PARTITION BY submission, id ORDER BY pos) AS rn FROM r WHERE id <> 'odd') WHERE rn > 1""")
def _(t):
    return K.check_risks(t.sql(f"SELECT * FROM {RISK}"), ["submission"])


CON = """(SELECT c_nationkey AS submission, c_custkey AS pos, CASE WHEN c_custkey % 7 = 0 THEN 'X' ELSE 'item-' || (c_custkey % 50) END AS id,
    CASE WHEN c_custkey % 5 = 0 THEN 'blob' ELSE 'node' END AS type, CASE WHEN c_custkey % 9 = 0 THEN 'x' ELSE 'title' END AS title,
    CASE WHEN c_custkey % 8 = 0 THEN 'tiny' ELSE 'a long summary' END AS summary, 'src' AS source,
    CASE c_custkey % 4 WHEN 0 THEN 'provisional' WHEN 1 THEN 'hidden' ELSE 'public' END AS public_level, 'sc-' || (c_custkey % 30) AS scenario, c_custkey % 3 AS g FROM customer)"""


@query("concept_rows", "P40", f"""SELECT submission, pos, 'CONCEPT_ID' AS check_id, 'error' AS severity, id AS detail FROM {CON} WHERE id = 'X' UNION ALL SELECT submission, pos, 'CONCEPT_TYPE', 'error', '' FROM {CON} WHERE type = 'blob'
    UNION ALL SELECT submission, pos, 'CONCEPT_TITLE', 'error', '' FROM {CON} WHERE title = 'x' UNION ALL SELECT submission, pos, 'CONCEPT_SUMMARY', 'error', '' FROM {CON} WHERE summary = 'tiny'
    UNION ALL SELECT submission, pos, 'CONCEPT_LEVEL', 'error', '' FROM {CON} WHERE public_level = 'hidden' UNION ALL SELECT submission, pos, 'CONCEPT_PROVISIONAL', 'warning', '' FROM {CON} WHERE public_level = 'provisional'
    UNION ALL SELECT submission, pos, 'CONCEPT_GEOMETRY', 'error', '' FROM {CON} WHERE g = 0 UNION ALL SELECT submission, pos, 'CONCEPT_MODE', 'error', '' FROM {CON} WHERE g = 1
    UNION ALL SELECT submission, pos, 'CONCEPT_PLACE', 'error', '' FROM {CON} WHERE g = 1 UNION ALL SELECT submission, pos, 'CONCEPT_GEOMETRY_KEY', 'error', 'coordinates' FROM {CON} WHERE g = 1
    UNION ALL SELECT submission, pos, 'CONCEPT_DUPLICATE', 'error', id FROM (SELECT *, row_number() OVER (PARTITION BY submission, id ORDER BY pos) AS rn FROM {CON} WHERE id <> 'X') WHERE rn > 1
    UNION ALL SELECT submission, NULL, 'CONCEPT_TOO_MANY', 'error', count(*)::VARCHAR FROM {CON} GROUP BY submission HAVING count(*) > 24
    UNION ALL SELECT submission, pos, 'CONCEPT_SCENARIO', 'error', scenario FROM {CON} WHERE scenario NOT IN (SELECT 'sc-' || n_nationkey FROM nation)""")
def _(t):
    items = t.sql(f"SELECT * FROM {CON}").withColumn("linked_scenarios", F.array("scenario")).withColumn(
        "geometry", F.when(F.col("g") == 1, F.create_map(F.lit("coordinates"), F.lit("1,2")))
        .when(F.col("g") == 2, F.create_map(F.lit("mode"), F.lit("concept"), F.lit("label"), F.lit("place"))))
    return K.check_concepts(items, ["submission"], t.nation.select(F.concat(F.lit("sc-"), "n_nationkey").alias("id")))


MAT = """(SELECT c_nationkey AS submission, c_custkey AS pos, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'r' || (c_custkey % 40) END AS rid, CASE WHEN c_custkey % 6 = 0 THEN FALSE ELSE TRUE END AS mandatory,
    CASE WHEN c_custkey % 4 = 0 THEN 'data_gap' WHEN c_custkey % 4 = 1 THEN 'odd' ELSE 'addressed' END AS review_status, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE 'text' END AS body, c_custkey % 5 AS k FROM customer)"""
COVER = f"""SELECT s.submission, NULL AS pos, 'NOT_COVERED' AS check_id, 'major' AS severity, r.p AS detail FROM (SELECT DISTINCT submission FROM {MAT} UNION SELECT -1) s, (SELECT unnest(['r1','r2','r39','r99']) AS p) r
    WHERE NOT EXISTS (SELECT 1 FROM {MAT} m WHERE m.submission = s.submission AND m.rid = r.p)"""
ROW_ID = f"SELECT submission, pos, 'ID_MISSING' AS check_id, 'major' AS severity, '' AS detail FROM {MAT} WHERE rid = ''"
ARR = f"SELECT submission, pos, 'STRING_ARRAY' AS check_id, 'major' AS severity, 'refs' AS detail FROM {MAT} WHERE k < 2"
NEED = ["r1", "r2", "r39", "r99"]


def matrix(t, name):
    return t.sql(f"SELECT * FROM {MAT}").withColumnRenamed("rid", name).withColumn("refs", F.when(F.col("k") == 1, F.array(F.lit("a"), F.lit(" "))).when(
        F.col("k") > 1, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")))


@query("requirement_matrix", "P41", f"{ROW_ID} UNION ALL {ARR} UNION ALL SELECT submission, pos, 'NOT_MANDATORY', 'major', '' FROM {MAT} WHERE NOT mandatory UNION ALL {COVER}")
def _(t):
    m = matrix(t, "requirement_id")
    return K.check_requirements(m, NEED, ["refs"], with_empty(m, -1))


@query("standard_matrix", "P42", f"""{ROW_ID} UNION ALL {ARR} UNION ALL SELECT submission, pos, 'TEXT_MISSING', 'major', 'evidence_summary_zh' FROM {MAT} WHERE body = ' '
    UNION ALL SELECT submission, pos, 'STATUS', 'major', review_status FROM {MAT} WHERE review_status = 'odd' UNION ALL SELECT submission, pos, 'MANDATORY_NOT_ADDRESSED', 'major', '' FROM {MAT} WHERE mandatory AND review_status <> 'addressed' UNION ALL {COVER}""")
def _(t):
    m = matrix(t, "standard_id").withColumn("requirement_zh", F.lit("x")).withColumn("professional_dimension", F.lit("x")).withColumn("evidence_summary_zh", F.col("body"))
    return K.check_standards(m, NEED, ["refs"], with_empty(m, -1))


@query("depth_matrix", "P43", f"""{ROW_ID} UNION ALL {ARR} UNION ALL SELECT submission, pos, 'TEXT_MISSING', 'major', 'title_zh' FROM {MAT} WHERE body = ' '
    UNION ALL SELECT submission, pos, 'NOT_REQUIRED', 'major', '' FROM {MAT} WHERE NOT mandatory UNION ALL SELECT submission, pos, 'NOT_COMPLETE', 'major', review_status FROM {MAT} WHERE review_status <> 'addressed' UNION ALL {COVER}""")
def _(t):
    m = matrix(t, "item_id").withColumn("title_zh", F.col("body")).withColumn("professional_dimension", F.lit("x")).withColumn("evidence_summary_zh", F.lit("x"))
    m = m.withColumn("required", F.col("mandatory")).withColumn("status", F.when(F.col("review_status") == "addressed", "complete").otherwise(F.col("review_status")))
    return K.check_depth(m, NEED, ["refs"], with_empty(m, -1))


CHK = """(SELECT event_id, 'C' || user_id AS chk, CASE event_id % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'unknown' WHEN 3 THEN 'odd' ELSE 'not_applicable' END AS result,
    CASE event_id % 4 WHEN 0 THEN 'blocking' WHEN 1 THEN 'major' WHEN 2 THEN 'odd' ELSE 'info' END AS severity FROM events)"""


@query("selfcheck_rules", "P44", f"""SELECT event_id, 'RESULT' AS check_id, 'major' AS severity, 'odd' AS detail FROM {CHK} WHERE result = 'odd' UNION ALL SELECT event_id, 'SEVERITY', 'major', 'odd' FROM {CHK} WHERE severity = 'odd'
    UNION ALL SELECT event_id, 'BLOCKING_FAIL', 'major', chk FROM {CHK} WHERE result = 'fail' AND severity = 'blocking'""")
def _(t):
    return K.check_selfcheck(t.sql(f"SELECT event_id, chk AS check, result, severity FROM {CHK}"), ["event_id"])


@query("coordinate_validity", "P50", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'Polygon' WHEN 2 THEN 'LineString' WHEN 3 THEN 'Point' ELSE 'Odd' END AS geom_type FROM part
    WHERE p_partkey % 5 IN (1, 4) OR (p_partkey % 5 <> 4 AND p_size > 40)""")
def _(t):
    pt = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), y.alias("y"))
    top = F.when(F.col("p_size") > 40, 95.0).otherwise(10.0)
    a, b, c = pt(0, top), pt(1, F.lit(0.0)), pt(1, F.lit(1.0))
    k = F.col("p_partkey") % 5
    ring = (F.when(k == 0, F.array(F.array(a, b, c, a))).when(k == 1, F.array(F.array(a, b, c, b)))
            .when(k == 2, F.array(F.array(a, b))).otherwise(F.array(F.array(a))))
    kind = F.when(k < 2, "Polygon").when(k == 2, "LineString").when(k == 3, "Point").otherwise("Odd")
    return K.check_coords(t.part.select("p_partkey", kind.alias("geom_type"), ring.alias("parts")), ["p_partkey"])


@query("feature_rows", "P51", f"""SELECT submission, pos, 'NOT_A_FEATURE' AS check_id, 'major' AS severity, '' AS detail FROM {FEAT_SQL} WHERE feature_type = 'Thing'
    UNION ALL SELECT submission, pos, 'ID_MISSING', 'major', '' FROM {FEAT_SQL} WHERE feature_id = '' UNION ALL SELECT submission, pos, 'PROPERTY_MISSING', 'major', 'id' FROM {FEAT_SQL} WHERE id IS NULL
    UNION ALL SELECT submission, pos, 'PROPERTY_MISSING', 'major', 'layer' FROM {FEAT_SQL} WHERE layer = '' UNION ALL SELECT submission, pos, 'PROPERTY_MISSING', 'major', 'source_type' FROM {FEAT_SQL} WHERE source_type = ''
    UNION ALL SELECT submission, pos, 'DUPLICATE_ID', 'major', feature_id FROM (SELECT *, row_number() OVER (PARTITION BY submission, feature_id ORDER BY pos) AS rn FROM {FEAT_SQL} WHERE feature_id <> '') WHERE rn > 1""")
def _(t):
    return K.check_features(feats(t), ["submission"])


TRUST = """CASE WHEN official_boundary AND geometry_role = 'official_constraint' AND source_type IN ('official_public','official_open_data','user_provided_cleared') AND confidence NOT IN ('low','unknown') THEN 'official'
    WHEN official_boundary = FALSE AND geometry_role = 'provisional_constraint' AND source_type IN ('osm','user_provided_cleared') AND confidence <> 'unknown' THEN 'provisional' ELSE 'other' END"""


@query("boundary_class", "P52", f"SELECT pos, {TRUST} AS boundary_class FROM {FEAT_SQL}")
def _(t):
    return feats(t).select("pos", K.boundary_class().alias("boundary_class"))


@query("choose_boundary", "P53", f"""SELECT submission, pos, boundary_class FROM (SELECT *, row_number() OVER (PARTITION BY submission ORDER BY boundary_class, layer_file, pos) AS rn
    FROM (SELECT *, {TRUST} AS boundary_class FROM {FEAT_SQL}) WHERE boundary_class <> 'other' AND layer = 'SITE_BOUNDARY') WHERE rn = 1""")
def _(t):
    return K.choose_boundary(feats(t), ["submission"]).select("submission", "pos", "boundary_class")


@query("choose_key_areas", "P54", f"""WITH k AS (SELECT *, {TRUST} AS mode FROM {FEAT_SQL} WHERE layer IN ('KEY_AREA','LAND_USE','SITE_BOUNDARY','KEY_AREA-1') AND area_id IN ('area0','area1')),
    c AS (SELECT submission, layer_file, mode FROM k WHERE mode <> 'other' GROUP BY ALL HAVING count(DISTINCT area_id) = 2),
    f AS (SELECT *, row_number() OVER (PARTITION BY submission ORDER BY mode, layer_file) AS rn FROM c)
    SELECT k.submission, k.layer_file, k.mode, k.pos FROM k JOIN f USING (submission, layer_file, mode) WHERE rn = 1""")
def _(t):
    f = feats(t).withColumn("layer", F.when(F.col("layer").isin("KEY_AREA", "LAND_USE", "SITE_BOUNDARY", "KEY_AREA-1"), "KEY_AREA").otherwise("X"))
    return K.choose_key_areas(f, ["submission"], ["area0", "area1"]).select("submission", "layer_file", "mode", "pos")


@query("empty_drawings", "P58", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN octet_length(encode(text)) + 5 < 2048 WHEN 2 THEN FALSE ELSE FALSE END AS empty FROM documents""")
def _(t):
    k = F.col("doc_id") % 4
    head = F.when(k == 0, "%PDF /Count 0 ").when(k == 1, "%PDF ").when(k == 2, "%PDF /Type /Page ").otherwise("PK /Count 0 ")
    return t.documents.select("doc_id", K.empty_pdf(F.encode(F.concat(head, "text"), "UTF-8")).alias("empty"))


@query("plausible_rows", "P61", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 1000 AND 500000 AND l_quantity * 50 BETWEEN 1000 AND 2000000
    AND NOT l_quantity * 50 BETWEEN 1950 AND 2030 AND l_discount <> 0.05 GROUP BY ALL""")
def _(t):
    floor = F.concat((F.col("l_quantity") * 50).cast("bigint").cast("string"), F.when(F.col("l_discount") == 0.05, ".1234").otherwise(".5"))
    floor = F.when(F.col("l_discount") == 0.05, floor).otherwise((F.col("l_quantity") * 50).cast("bigint").cast("string"))
    df = t.lineitem.filter(K.plausible(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), floor))
    return df.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


PUB = """(SELECT c_custkey AS pos, 'submissions/u/' || (c_custkey % 1450) AS path, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS published, c_custkey % 5 = 0 AS featured,
    CASE c_custkey % 4 WHEN 0 THEN 'approved_for_publication' WHEN 1 THEN 'odd' ELSE 'not_approved' END AS review_status, CASE WHEN c_custkey % 7 = 0 THEN 'featured' ELSE 'qualified' END AS quality_tier,
    CASE WHEN c_custkey % 8 = 0 THEN 'a b' ELSE 'rev-1' END AS reviewed_by, CASE WHEN c_custkey % 9 = 0 THEN '2026-02-30' ELSE '2026-02-03' END AS reviewed_at, c_custkey % 3 = 0 AS rights_reviewed,
    CASE WHEN c_custkey % 10 = 0 THEN 'zz' ELSE {sha} END AS reviewed_package_sha256, CASE WHEN c_custkey % 11 = 0 THEN 'no ' ELSE 'reason' END AS selection_reason_zh, 'reason' AS selection_reason_en, '2026-01-01' AS selected_at FROM customer)"""
PUB_SQL = PUB.replace("{sha}", "sha256(CAST(c_custkey % 100 AS VARCHAR))")
PKG_SQL = "(SELECT 'submissions/u/' || c_custkey AS path, sha256(CAST(c_custkey % 100 AS VARCHAR)) AS sha256 FROM customer WHERE c_custkey % 13 <> 0)"


@query("publication_rules", "P62", " UNION ALL ".join(f"SELECT path, '{c}' AS check_id, 'major' AS severity, '{d}' AS detail FROM {PUB_SQL} WHERE {w}" for c, d, w in [
    ("REVIEW_STATUS", "", "review_status = 'odd'"), ("REVIEWER_FORM", "", "reviewed_by = 'a b'"), ("SHA_FORM", "", "reviewed_package_sha256 = 'zz'"),
    ("FEATURED_NOT_PUBLISHED", "", "featured AND published IS DISTINCT FROM TRUE"), ("PUBLISHED_NOT_APPROVED", "", "published AND review_status <> 'approved_for_publication'"),
    ("RIGHTS_NOT_REVIEWED", "", "published AND NOT rights_reviewed"), ("FEATURE_TIER", "", "featured AND quality_tier <> 'featured'"),
    ("TIER_WITHOUT_FEATURE", "", "NOT featured AND quality_tier = 'featured'"), ("FLAG_MISSING", "published", "published IS NULL"),
    ("DATE_FORM", "reviewed_at", "reviewed_at = '2026-02-30'"), ("REASON_SHORT", "selection_reason_zh", "selection_reason_zh = 'no '")]) + f"""
    UNION ALL SELECT e.path, CASE WHEN p.sha256 IS NULL THEN 'PACKAGE_MISSING' ELSE 'SHA_STALE' END, 'major', '' FROM {PUB_SQL} e LEFT JOIN {PKG_SQL} p USING (path) WHERE published AND (p.sha256 IS NULL OR p.sha256 <> reviewed_package_sha256)
    UNION ALL SELECT path, 'DUPLICATE_PATH', 'major', '' FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos) AS rn FROM {PUB_SQL}) WHERE rn > 1""")
def _(t):
    e = t.sql(f"SELECT * FROM {PUB.replace('{sha}', 'sha2(CAST(c_custkey % 100 AS STRING), 256)')}")
    p = t.customer.filter("c_custkey % 13 <> 0").select(F.concat(F.lit("submissions/u/"), "c_custkey").alias("path"),
                                                        F.sha2((F.col("c_custkey") % 100).cast("string"), 256).alias("sha256"))
    return K.check_publication(e, p)


LEGEND = [("built", 240, 192, 104, 55), ("limited", 248, 232, 176, 45), ("eco", 112, 160, 0, 55)]
PX = "(SELECT l_orderkey AS k, l_partkey % 256 AS r, l_suppkey * 7 % 256 AS g, CAST(l_quantity AS BIGINT) * 5 % 256 AS b FROM lineitem)"
PX_CLASS = f"""(SELECT k, r, g, b, c.n AS class FROM {PX} p JOIN (VALUES ('built',240,192,104,55),('limited',248,232,176,45),('eco',112,160,0,55)) AS c(n, lr, lg, lb, tol)
    ON abs(r - lr) <= tol AND abs(g - lg) <= tol AND abs(b - lb) <= tol WHERE abs(r - 255) + abs(g - 255) + abs(b - 255) > 60)"""


@query("classify_pixels", "P64", f"SELECT * FROM {PX_CLASS}")
def _(t):
    return K.classify_pixels(t.sql(f"SELECT * FROM {PX}"), LEGEND)


@query("pixel_counts", "G28", f"SELECT class, count(*) AS n FROM {PX_CLASS} GROUP BY class")
def _(t):
    return K.classify_pixels(t.sql(f"SELECT * FROM {PX}"), LEGEND).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("numeric_limit", "P66", """SELECT p_partkey, (CASE WHEN p_size % 3 = 0 THEN TRUE ELSE p_retailprice >= 950 END) AND (CASE WHEN p_size % 2 = 0 THEN TRUE ELSE p_retailprice <= 1050 END) AS ok FROM part""")
def _(t):
    return t.part.select("p_partkey", K.in_limit(F.col("p_retailprice"), F.when(F.col("p_size") % 3 != 0, 950.0),
                                                 F.when(F.col("p_size") % 2 != 0, 1050.0)).alias("ok"))


@query("scope_order", "P68", """SELECT c_custkey AS plan, c_custkey % 3 <> 0 AS order_ok, c_acctbal > 100 AS areas_fall FROM customer""")
def _(t):
    base = t.customer
    first = F.when(F.col("c_custkey") % 3 == 0, "other").otherwise("coordinated_research_area")
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), n.alias("scope_id"), a.alias("area_sqm")) for i, (n, a) in enumerate(
        [(first, F.col("c_acctbal") * 3), (F.lit("overall_design_area"), F.col("c_acctbal") * 2), (F.lit("key_detailed_design_area"), F.lit(200.0))])])
    return K.check_scope_order(base.select(F.col("c_custkey").alias("plan"), F.explode(rows).alias("s")).select("plan", "s.*"), ["plan"])
