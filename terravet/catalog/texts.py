"""Queries over document texts."""

from pyspark.sql import functions as F

from .. import params as P
from ..functions import text as X
from ..operators import documents as D
from . import bindings as B
from .registry import query

WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
UNESC = ("replace(replace(replace(replace(replace(replace(replace({c}, '&lt;','<'),'&gt;','>'),'&quot;','\"'),"
         "'&nbsp;', chr(160)),'&copy;','©'),'&middot;','·'),'&amp;','&')")


def sql_strip(c):
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def sql_norm(c):
    return f"trim(regexp_replace({UNESC.format(c=c)}, '{WS}+', ' ', 'g'))"


@query("normalize_space", "F1", f"SELECT page_id, {sql_norm('html')} AS value FROM pages")
def _(t):
    return t.pages.select("page_id", X.normalize_space(F.col("html")).alias("value"))


@query("compact_length", "F2", f"SELECT doc_id, length(regexp_replace(text, '{WS}+', '', 'g'))::INTEGER AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", X.compact_len(F.col("text")).alias("n"))


COUNT_TERMS = f"len(list_filter({B.SQL_EN_TERMS}, lambda k: contains(lower(text), lower(k))))::INTEGER"


@query("count_terms", "F3", f"SELECT doc_id, {COUNT_TERMS} AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", X.count_terms(F.col("text"), B.EN_TERMS).alias("n"))


@query("status_from_count", "F4", f"""SELECT doc_id, CASE WHEN n >= 3 THEN 'pass' WHEN n >= 1 THEN 'needs-work'
    ELSE 'missing' END AS status FROM (SELECT doc_id, {COUNT_TERMS} AS n FROM documents)""")
def _(t):
    return t.documents.select("doc_id", X.status_from_count(X.count_terms(F.col("text"), B.EN_TERMS)).alias("status"))


@query("slugify", "F5", """SELECT p_partkey, CASE WHEN length(s) >= 3 THEN s ELSE 'ai-submission' END AS slug FROM
    (SELECT p_partkey, regexp_replace(trim(regexp_replace(lower(p_brand || ' / ' || p_name), '[^a-z0-9-]+', '-', 'g'), '-'),
    '-{2,}', '-', 'g') AS s FROM part)""")
def _(t):
    return t.part.select("p_partkey", X.slugify(F.concat_ws(" / ", "p_brand", "p_name")).alias("slug"))


REF_TEXT = "md || ' [metric:m' || doc_id % 5 || '] [data:geometry/x.geojson#' || source || ']'"
PAIRS = r"""list_zip(regexp_extract_all({c}, '\[(source|standard|depth|data|metric):([^\]\s]+)\]', 1),
    regexp_extract_all({c}, '\[(source|standard|depth|data|metric):([^\]\s]+)\]', 2))"""


@query("extract_references", "F8", f"""SELECT doc_id, p[1] AS kind, p[2] AS value, count(*) AS n FROM
    (SELECT doc_id, unnest({PAIRS.format(c='(' + REF_TEXT + ')')}) AS p FROM {B.MARKDOWN}) GROUP BY ALL""")
def _(t):
    text = F.concat(F.col("md"), F.lit(" [metric:m"), F.col("doc_id") % 5, F.lit("] [data:geometry/x.geojson#"),
                    F.col("source"), F.lit("]"))
    refs = B.markdown(t).select("doc_id", F.explode(X.extract_refs(text)).alias("r"))
    return refs.select("doc_id", "r.kind", "r.value").groupBy("doc_id", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


LINES = r"string_split_regex({c}, '\r\n|[\n\r\x{{0B}}\x{{0C}}\x{{1C}}-\x{{1E}}\x{{85}}\x{{2028}}\x{{2029}}]')"
MD_LINES = LINES.format(c="md")


@query("extract_headings", "F9", rf"""SELECT doc_id, trim(regexp_replace(h, '^##\s+', '')) AS heading, count(*) AS n FROM
    (SELECT doc_id, unnest(list_filter({MD_LINES}, lambda x: regexp_matches(x, '^##\s+\S'))) AS h FROM {B.MARKDOWN})
    GROUP BY ALL""")
def _(t):
    return B.markdown(t).select("doc_id", F.explode(X.extract_headings(F.col("md"))).alias("heading")).groupBy(
        "doc_id", "heading").agg(F.count(F.lit(1)).alias("n"))


@query("markdown_images", "F10", """SELECT doc_id, 'figure ' || source AS alt, 'assets/' || lang || '.png' AS path
    FROM documents UNION ALL SELECT doc_id, '' AS alt, 'x.svg' AS path FROM documents""")
def _(t):
    text = F.concat(F.col("text"), F.lit("\n![ figure "), F.col("source"), F.lit(" ](assets/"), F.col("lang"),
                    F.lit('.png "title") and ![](x.svg)'))
    return t.documents.select("doc_id", F.explode(X.extract_images(text)).alias("i")).select("doc_id", "i.*")


@query("parse_tag_list", "F11", """SELECT c_custkey, unnest(['t' || c_nationkey, lower(c_mktsegment)]) AS tag FROM customer""")
def _(t):
    a, b = F.concat(F.lit("t"), F.col("c_nationkey")), F.lower("c_mktsegment")
    raw = (F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('["'), a, F.lit('", "'), b, F.lit('"]')))
           .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("["), a, F.lit(", '"), b, F.lit("',]")))
           .otherwise(F.concat(a, F.lit(" , ,"), b)))
    return t.customer.select("c_custkey", F.explode(X.parse_tag_list(raw)).alias("tag"))


@query("reference_lines", "F12", f"""SELECT doc_id, {sql_strip("substr(x, 3)")} AS line, count(*) AS n FROM
    (SELECT doc_id, {sql_strip("unnest(" + MD_LINES + ")")} AS x FROM {B.MARKDOWN})
    WHERE starts_with(x, '- ') AND {sql_strip("substr(x, 3)")} <> '' GROUP BY ALL""")
def _(t):
    return B.markdown(t).select("doc_id", F.explode(X.reference_lines(F.col("md"))).alias("line")).groupBy(
        "doc_id", "line").agg(F.count(F.lit(1)).alias("n"))


@query("iso_date", "F20", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
    ELSE left(strftime(o_orderdate, '%d/%m/%Y %H'), 10) END AS d FROM orders""")
def _(t):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).otherwise(
        F.date_format("o_orderdate", "dd/MM/yyyy HH"))
    return t.orders.select("o_orderkey", X.iso_date(raw).alias("d"))


@query("fingerprint", "F33", """SELECT event_id, left(sha256(event_type || ':' || coalesce(props, '')), 16) AS fp FROM events""")
def _(t):
    return t.events.select("event_id", X.fingerprint(F.col("event_type"), F.col("props")).alias("fp"))


SECTION_SQL = rf"""(SELECT doc_id, generate_subscripts(p, 1) - 2 AS pos, unnest(p) AS part FROM
    (SELECT doc_id, string_split_regex(chr(10) || array_to_string({MD_LINES}, chr(10)), '\n## ') AS p FROM {B.MARKDOWN}))"""
SEC_TITLE = sql_strip("split_part(ltrim(part), chr(10), 1)")
SEC_BODY = sql_strip("CASE WHEN contains(ltrim(part), chr(10)) THEN substr(ltrim(part), instr(ltrim(part), chr(10)) + 1) ELSE '' END")


@query("heading_sections", "W15", f"""SELECT doc_id, pos::INTEGER AS pos, {SEC_TITLE} AS title, {SEC_BODY} AS body
    FROM {SECTION_SQL} WHERE pos >= 0""")
def _(t):
    return B.markdown(t).select("doc_id", F.explode(X.sections(F.col("md"))).alias("s")).select("doc_id", "s.*")


@query("find_section", "F49", f"""SELECT d.doc_id, coalesce(s.body, '') AS body FROM documents d LEFT JOIN
    (SELECT doc_id, arg_min(body, pos) AS body FROM (SELECT doc_id, pos, {SEC_TITLE} AS title, {SEC_BODY} AS body
     FROM {SECTION_SQL} WHERE pos >= 0) WHERE contains(title, 'the') OR contains(title, 'la') GROUP BY doc_id) s USING (doc_id)""")
def _(t):
    return B.markdown(t).select("doc_id", X.find_section(X.sections(F.col("md")), ["the", "la"]).alias("body"))


FLAT = f"trim(regexp_replace(text, '{WS}+', ' ', 'g'))"


@query("compact_text", "F50", f"""SELECT doc_id, CASE WHEN length(v) <= 60 THEN v ELSE rtrim(left(v, 59)) || '…' END AS value
    FROM (SELECT doc_id, {FLAT} AS v FROM documents)""")
def _(t):
    return t.documents.select("doc_id", X.compact_text(F.col("text"), 60).alias("value"))


@query("module_rollup", "F51", """SELECT p_partkey, CASE WHEN length(v) <= 30 THEN v ELSE rtrim(left(v, 29)) || '…' END AS value
    FROM (SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN '；' || p_type ELSE '' END || '；' ||
    p_brand || '：' || p_size || '；a；b；c' AS v FROM part)""")
def _(t):
    items = F.array(X.keyed_text(F.col("p_brand"), F.col("p_size").cast("string")), F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))
    return t.part.select("p_partkey", X.module_rollup(
        F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")), [items], 30).alias("value"))


@query("front_matter", "S4", """SELECT doc_id, lang AS title, source AS author, text AS body FROM
    (SELECT doc_id, lang, source, regexp_replace(text, '^\\n+', '') AS text FROM documents)""")
def _(t):
    md = F.concat(F.lit("﻿\n---\n# note\ntitle: \""), F.col("lang"), F.lit("\"\nbad line\nauthor:  '"),
                  F.col("source"), F.lit("'\n---\n\n"), F.col("text"))
    f = t.documents.select("doc_id", X.front_matter(md).alias("f"))
    return f.select("doc_id", X.meta_value(F.col("f.meta"), "title").alias("title"),
                    X.meta_value(F.col("f.meta"), "author").alias("author"), F.col("f.body").alias("body"))


# ---- phrase and risk scans ---------------------------------------------------------

FORBID = ["heon、tion", "queau, zzz，the of"]
FORBID_KEYS = "(VALUES ('heon'),('tion'),('queau'),('zzz'),('the of')) AS k(keyword)"


@query("scan_forbidden", "P24", f"""SELECT doc_id, keyword, {sql_strip(
    "replace(substr(text, s, e - s + 1), chr(10), ' ')")} AS context FROM
    (SELECT doc_id, text, keyword, greatest(instr(text, keyword) - 20, 1) AS s,
     least(length(text), instr(text, keyword) - 1 + length(keyword) + 30) AS e
     FROM documents, {FORBID_KEYS} WHERE contains(text, keyword))""")
def _(t):
    return D.scan_forbidden(t.documents, "doc_id", "text", FORBID)


@query("scan_required", "P25", """SELECT doc_id, CASE WHEN len(m) > 0 THEN 'FAIL' ELSE 'PASS' END AS outcome,
    array_to_string(m, ', ') AS missing, array_to_string(f, ', ') AS found FROM (SELECT doc_id,
    list_filter(['the','la','der'], lambda k: NOT contains(text, k)) AS m,
    list_filter(['the','la','der'], lambda k: contains(text, k)) AS f FROM documents)""")
def _(t):
    return D.scan_required(t.documents, "doc_id", "text", ["the", "la", "der"])


@query("scan_concepts", "P26", """SELECT doc_id, CASE WHEN len(m) > 0 THEN 'FAIL' ELSE 'PASS' END AS outcome,
    array_to_string(m, ', ') AS missing FROM (SELECT doc_id, CASE WHEN contains(lower(text), 'erheit') THEN [] ELSE
    list_filter(['the','la'], lambda k: NOT (contains(text, k) OR contains(lower(text), CASE k WHEN 'the' THEN 'tion' ELSE 'queau' END)))
    END AS m FROM documents)""")
def _(t):
    return D.scan_concepts(t.documents, "doc_id", "text", [("the", "Tion"), ("la", "queau")], ["erheit"])


@query("missing_controls_documented", "P27", """SELECT source, CASE WHEN len(g) > 0 THEN 'FAIL' ELSE 'PASS' END AS outcome,
    array_to_string(g, ', ') AS uncovered FROM (SELECT source, list_filter(['Heon','queau','zzz'],
    lambda k: NOT CASE k WHEN 'Heon' THEN a WHEN 'queau' THEN b ELSE c END) AS g FROM
    (SELECT source, bool_or(contains(lower(text), 'heon')) AS a, bool_or(contains(lower(text), 'queau')) AS b,
    bool_or(contains(lower(text), 'zzz')) AS c FROM documents GROUP BY source)) UNION ALL SELECT 'none', 'FAIL', 'Heon, queau, zzz'""")
def _(t):
    return D.check_documented(t.documents, "source", "text", ["Heon", "queau", "zzz"], B.with_empty(t.documents, "none", "source"))


@query("source_authority_misuse", "P28", """SELECT doc_id, source, u[1] AS used_for FROM (SELECT doc_id, source,
    list_filter(['queau','heon'], lambda k: contains(lower(text), k)) AS u FROM documents
    WHERE source IN (SELECT 'src' || r_regionkey FROM region)) WHERE len(u) > 0""")
def _(t):
    ids = t.region.select(F.concat(F.lit("src"), F.col("r_regionkey")).alias("id"))
    return D.check_authority(t.documents, "doc_id", "source", "text", ids, ["queau", "heon"])


@query("crs_mention", "P29", """SELECT doc_id, CASE WHEN contains(text, '4548') THEN 'PASS' ELSE 'FAIL' END AS outcome
    FROM documents""")
def _(t):
    return D.check_crs(t.documents, "doc_id", "text")


# DuckDB has no look-around, so the number must be bounded by other characters there.
RISKY = "text || ' +1' || (3 + doc_id % 9) || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.'"
ID_NO = r"(^|[^0-9A-Za-z_])[0-9]{17}[0-9Xx]([^0-9A-Za-z_]|$)"
PHONE = r"(^|[^0-9])1[3-9][0-9]{9}([^0-9]|$)"


@query("scan_hard_risk", "P32", f"""SELECT doc_id, reason, 'error' AS severity FROM (SELECT doc_id,
    unnest(list_filter([CASE WHEN regexp_matches(t, '{ID_NO}') THEN '疑似身份证号码' END,
    CASE WHEN regexp_matches(t, '{PHONE}') THEN '疑似手机号' END], lambda x: x IS NOT NULL)) AS reason
    FROM (SELECT doc_id, {RISKY} AS t FROM documents))""")
def _(t):
    # Words beyond ASCII next to a number are joined to it by neither engine here.
    text = F.concat(F.col("text"), F.lit(" +1"), 3 + F.col("doc_id") % 9, F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit("."))
    return D.scan_hard_risk(t.documents.select("doc_id", text.alias("t")), "doc_id", "t")


@query("scan_soft_risk", "P33", """SELECT doc_id, reason, 'warning' AS severity FROM (SELECT doc_id,
    unnest(list_filter([CASE WHEN regexp_matches(text, '(heon|queau)') THEN 'a' END,
    CASE WHEN regexp_matches(text, '(tion|ssch)') THEN 'b' END], lambda x: x IS NOT NULL)) AS reason FROM documents)""")
def _(t):
    return D.scan_soft_risk(t.documents, "doc_id", "text", [("(heon|queau)", "a"), ("(tion|ssch)", "b")])


def _html_cases(patterns):
    return ", ".join("CASE WHEN regexp_matches(html, '" + p.replace("'", "''") + f"') THEN '{r}' END" for p, r in patterns)


@query("scan_report_html", "P34", f"""SELECT page_id, 'REPORT_ACTIVE_CONTENT' AS check_id, 'major' AS severity, d AS detail FROM
    (SELECT page_id, unnest([{_html_cases(P.REPORT_HTML_PATTERNS)}]) AS d FROM pages) WHERE d IS NOT NULL
    UNION ALL SELECT page_id, 'REPORT_FIGURE_MISSING', 'major', f FROM pages, (SELECT unnest({
    ['../' + p for p in P.REQUIRED_IMAGES]}) AS f) WHERE NOT contains(html, f)
    UNION ALL SELECT page_id, 'REPORT_INCOMPLETE', 'major', 'not a complete HTML document' FROM pages
    WHERE NOT contains(html, '<main') OR NOT contains(html, '</html>')""")
def _(t):
    return D.scan_report_html(t.pages, "page_id", "html")


@query("scan_visual_html", "P35", f"""SELECT page_id, 'VISUAL_REMOTE_OR_ACTIVE_CONTENT' AS check_id, 'blocking' AS severity,
    d AS detail FROM (SELECT page_id, unnest([{_html_cases(P.VISUAL_HTML_PATTERNS)}]) AS d FROM pages) WHERE d IS NOT NULL
    UNION ALL SELECT page_id, 'VISUAL_REQUIRED_SECTION_MISSING', 'major', m FROM (SELECT page_id, {UNESC.format(
    c="regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '" + WS + "+', ' ', 'g')")} AS p FROM pages),
    (SELECT unnest(['the','© www','heon tion','&copy']) AS m) WHERE NOT contains(p, m)""")
def _(t):
    return D.scan_visual_html(t.pages, "page_id", "html", ["the", "© www", "heon tion", "&copy"])


class CLEN:  # length without white space, in SQL
    @staticmethod
    def format(c):
        return f"length(regexp_replace({c}, '{WS}+', '', 'g'))"


@query("required_sections", "P46", f"""WITH s AS (SELECT doc_id, {SEC_TITLE} AS title, {SEC_BODY} AS body FROM {SECTION_SQL}
    WHERE pos >= 0), r AS (SELECT unnest(['the','la','heon']) AS name),
    m AS (SELECT d.doc_id, r.name, count(s.title) AS n, max({CLEN.format(c='body')}) AS longest
    FROM documents d CROSS JOIN r LEFT JOIN s ON s.doc_id = d.doc_id AND contains(s.title, r.name) GROUP BY ALL)
    SELECT doc_id, 'SECTION_MISSING' AS check_id, 'major' AS severity, name AS detail FROM m WHERE n = 0
    UNION ALL SELECT doc_id, 'SECTION_TOO_THIN', 'major', name FROM m WHERE n > 0 AND longest < 280
    UNION ALL SELECT doc_id, 'BODY_TOO_SHORT', 'major', '' FROM {B.MARKDOWN} WHERE {CLEN.format(c='md')} < 5000""")
def _(t):
    return D.check_sections(B.markdown(t), "doc_id", "md", ["the", "la", "heon"])


@query("scan_placeholder", "P57", f"""SELECT doc_id, 'PLACEHOLDER_MARKER' AS check_id, 'major' AS severity, m AS detail
    FROM documents, (SELECT unnest(['heon','queau']) AS m) WHERE contains(text, m)
    UNION ALL SELECT doc_id, 'STATEMENT_TOO_SHORT', 'major', '' FROM documents WHERE length({sql_strip('text')}) < 180""")
def _(t):
    return D.scan_placeholder(t.documents, "doc_id", "text", "text", ["heon", "queau"])


@query("scan_boilerplate", "P56", f"""WITH d AS (SELECT doc_id, md,
    length(chr(10) || md) - length(replace(chr(10) || md, chr(10) || '## ', chr(10) || '##')) AS h,
    (length(md) - length(replace(md, 'tion', 'tio'))) + (length(md) - length(replace(md, 'heon', 'heo'))) AS k
    FROM {B.MARKDOWN}), f AS (SELECT d.doc_id, md, h, k, coalesce(n, 0) AS n FROM d LEFT JOIN
    (SELECT p_size::BIGINT AS doc_id, count(*) AS n FROM part GROUP BY 1) USING (doc_id))
    SELECT doc_id, 'FEW_HEADINGS' AS check_id, 'major' AS severity, h::VARCHAR AS detail FROM f WHERE h < 8
    UNION ALL SELECT doc_id, 'STOCK_PHRASES', 'major', k::VARCHAR FROM f WHERE k > 5
    UNION ALL SELECT doc_id, 'OPERATIONS_MISSING', 'major', '' FROM f WHERE NOT contains(md, 'queau')
    UNION ALL SELECT doc_id, 'FEW_LAND_USE_FEATURES', 'major', n::VARCHAR FROM f WHERE n <= 4""")
def _(t):
    land = t.part.select(F.col("p_size").cast("bigint").alias("doc_id"))
    return D.scan_boilerplate(B.markdown(t), "doc_id", "md", land, ["tion", "heon"], ["queau"])


@query("scan_exact", "P65", """SELECT doc_id, array_to_string(list_filter(['heon','tion, the','queau'],
    lambda k: contains(text, k)), '|') AS forbidden, contains(text, 'the ') AS has_wording FROM documents""")
def _(t):
    return D.scan_exact(t.documents, "doc_id", "text", ["heon", "tion, the", "queau"], "the ")


@query("section_minimum", "P67", f"""SELECT doc_id, CASE WHEN pos = 0 THEN false ELSE length({sql_strip(
    "CASE WHEN instr(substr(r, 7), chr(10) || '## ') > 0 THEN left(r, 6 + instr(substr(r, 7), chr(10) || '## ') - 1) ELSE r END")}) >= 100
    END AS long_enough FROM (SELECT doc_id, instr(md, '## The') AS pos, substr(md, greatest(instr(md, '## The'), 1)) AS r
    FROM {B.MARKDOWN})""")
def _(t):
    return D.section_min(B.markdown(t), "doc_id", "md", "## The", 100)


@query("changelog_rules", "P45", f"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '# 方案迭代记录' || chr(10) ELSE '' END ||
    CASE WHEN doc_id % 3 = 0 THEN '## v0.' || doc_id || ' - 2026-06-14 ' || chr(10) ELSE '' END || text AS t FROM documents)
    SELECT doc_id, 'CHANGELOG_TITLE' AS check_id, 'error' AS severity, '# 方案迭代记录' AS detail FROM c WHERE doc_id % 2 = 1
    UNION ALL SELECT doc_id, 'CHANGELOG_VERSION', 'error', '' FROM c WHERE doc_id % 3 <> 0
    UNION ALL SELECT doc_id, 'CHANGELOG_SHORT', 'warning', '' FROM c WHERE {CLEN.format(c='t')} < 80
    UNION ALL SELECT doc_id, 'HARD_RISK', 'error', '疑似身份证号码' FROM c WHERE regexp_matches(t, '{ID_NO}')
    UNION ALL SELECT doc_id, 'HARD_RISK', 'error', '疑似手机号' FROM c WHERE regexp_matches(t, '{PHONE}')""")
def _(t):
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, P.CHANGELOG_TITLE + "\n").otherwise(""),
                    F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("## v0."), F.col("doc_id"), F.lit(" - 2026-06-14 \n"))).otherwise(""),
                    F.col("text"))
    return D.check_changelog(t.documents.select("doc_id", text.alias("t")), "doc_id", "t")


TAGS = "[lower(c_mktsegment), 'n-' || c_nationkey, 'n-' || (c_nationkey + c_custkey % 7), 'Bad id']"


@query("tag_rules", "P48", f"""WITH g AS (SELECT c_custkey, list_filter({TAGS}, lambda x: x <> 'Bad id' OR c_custkey % 5 = 0) AS t FROM customer),
    one AS (SELECT c_custkey, unnest(t) AS tag FROM g)
    SELECT c_custkey, 'TOO_MANY_TAGS' AS check_id, 'major' AS severity, len(t)::VARCHAR AS detail FROM g WHERE len(t) > 3
    UNION ALL SELECT c_custkey, 'DUPLICATE_TAG', 'major', '' FROM g WHERE len(list_distinct(t)) < len(t)
    UNION ALL SELECT c_custkey, 'MALFORMED_TAG', 'major', tag FROM one WHERE NOT regexp_matches(tag, '^[a-z0-9][a-z0-9-]{{2,63}}$')
    UNION ALL SELECT c_custkey, 'UNKNOWN_TAG', 'major', tag FROM one WHERE regexp_matches(tag, '^[a-z0-9][a-z0-9-]{{2,63}}$')
    AND tag NOT IN (SELECT 'n-' || n_nationkey FROM nation)""")
def _(t):
    n = F.col("c_nationkey")
    raw = F.concat_ws(",", F.lower("c_mktsegment"), F.concat(F.lit("n-"), n),
                      F.concat(F.lit("n-"), n + (F.col("c_custkey") % 7).cast("int")),
                      F.when(F.col("c_custkey") % 5 == 0, "Bad id"))
    known = t.nation.select(F.concat(F.lit("n-"), F.col("n_nationkey")).alias("id"))
    return D.check_tags(t.customer.select("c_custkey", raw.alias("raw")), "c_custkey", "raw", known, 3)


@query("image_rules", "P49", """WITH d AS (SELECT doc_id, source, lang, CASE doc_id % 5 WHEN 0 THEN 'https://x.org/a.png'
    WHEN 1 THEN 'assets/' || lang || '.png' WHEN 2 THEN 'assets/' || lang || '.bmp' WHEN 3 THEN 'other/a.png'
    ELSE 'assets/../b.png' END AS p, CASE WHEN doc_id % 2 = 0 THEN 'long alt text' ELSE 'alt' END AS alt FROM documents)
    SELECT doc_id, 'IMAGE_NOT_LOCAL' AS check_id, 'major' AS severity, p AS detail FROM d WHERE doc_id % 5 IN (0, 4)
    UNION ALL SELECT doc_id, 'IMAGE_OUTSIDE_ASSETS', 'major', p FROM d WHERE doc_id % 5 = 3
    UNION ALL SELECT doc_id, 'IMAGE_EXTENSION', 'major', p FROM d WHERE doc_id % 5 = 2
    UNION ALL SELECT doc_id, 'IMAGE_ALT', 'major', p FROM d WHERE doc_id % 5 IN (1, 2) AND doc_id % 2 = 1
    UNION ALL SELECT doc_id, 'IMAGE_MISSING', 'major', p FROM d WHERE doc_id % 5 IN (1, 2) AND NOT (doc_id % 5 = 1 AND lang = 'en')
    UNION ALL SELECT doc_id, 'REQUIRED_IMAGE', 'major', r FROM d, (SELECT unnest(['assets/en.png','assets/zz.png']) AS r)
    WHERE p <> r""")
def _(t):
    m = F.col("doc_id") % 5
    path = (F.when(m == 0, "https://x.org/a.png").when(m == 1, F.concat(F.lit("assets/"), F.col("lang"), F.lit(".png")))
            .when(m == 2, F.concat(F.lit("assets/"), F.col("lang"), F.lit(".bmp"))).when(m == 3, "other/a.png")
            .otherwise("assets/../b.png"))
    alt = F.when(F.col("doc_id") % 2 == 0, "long alt text").otherwise("alt")
    docs = t.documents.select("doc_id", F.concat(F.col("text"), F.lit("\n!["), alt, F.lit("]("), path, F.lit(")")).alias("md"))
    files = t.documents.select("doc_id", F.lit("assets/en.png").alias("path"))
    return D.check_images(docs, "doc_id", "md", files, ["assets/en.png", "assets/zz.png"])


FM_LANG = "CASE doc_id % 3 WHEN 0 THEN 'zh' WHEN 1 THEN 'en' ELSE 'fr' END"


@query("front_matter_rules", "P47", f"""WITH d AS (SELECT doc_id, text, {FM_LANG} AS lang FROM documents),
    i AS (SELECT unnest({P.REQUIRED_IMAGES}) AS img)
    SELECT doc_id, 'FIELD_MISSING' AS check_id, 'major' AS severity, 'summary' AS detail FROM d
    UNION ALL SELECT doc_id, 'LANGUAGE', 'major', 'fr' FROM d WHERE lang = 'fr'
    UNION ALL SELECT doc_id, 'FIELD_MISSING', 'major', 'summary_zh' FROM d WHERE lang = 'en'
    UNION ALL SELECT doc_id, 'LICENSE', 'major', 'MIT' FROM d WHERE doc_id % 4 = 0
    UNION ALL SELECT doc_id, 'VERSION_FORM', 'major', 'version' FROM d WHERE doc_id % 7 = 0
    UNION ALL SELECT doc_id, 'ENGLISH_TOO_SHORT', 'major', 'characters' FROM d WHERE lang = 'en' AND {CLEN.format(c='text')} < 300
    UNION ALL SELECT doc_id, 'ENGLISH_TOO_SHORT', 'major', 'letters' FROM d WHERE lang = 'en'
      AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < 200
    UNION ALL SELECT doc_id, 'TRANSLATION_TOO_SHORT', 'major', '' FROM d WHERE lang = 'en' AND {CLEN.format(c="'##part' || text")} < 300
    UNION ALL SELECT doc_id, 'TRANSLATION_SECTION_MISSING', 'major', 'other' FROM d WHERE lang = 'en'
    UNION ALL SELECT doc_id, 'TRANSLATION_SECTION_THIN', 'major', 'part' FROM d WHERE lang = 'en' AND {CLEN.format(c='text')} < 100
    UNION ALL SELECT doc_id, 'TRANSLATION_SECTION_REFERENCE', 'major', 'part' FROM d WHERE lang = 'en'
    UNION ALL SELECT doc_id, 'TRANSLATION_IMAGE', 'major', img FROM d, i WHERE lang = 'en'""")
def _(t):
    lang = F.when(F.col("doc_id") % 3 == 0, "zh").when(F.col("doc_id") % 3 == 1, "en").otherwise("fr")
    md = F.concat(F.lit("---\ntitle: t\nauthor_github: a\nlanguage: "), lang, F.lit("\nlicense: "),
                  F.when(F.col("doc_id") % 4 == 0, "MIT").otherwise("CC-BY-4.0"), F.lit("\ntitle_zh: z\n"),
                  F.lit("chinese_translation: included\nversion: "),
                  F.when(F.col("doc_id") % 7 == 0, "one").otherwise("v0.1"), F.lit("\n---\n"), F.col("text"),
                  F.lit("\n" + P.TRANSLATION_HEADING + "\n## part\n"), F.col("text"))
    return D.check_front_matter(t.documents.select("doc_id", md.alias("md")), "doc_id", "md", ["part", "other"], 300, 100, 200)
