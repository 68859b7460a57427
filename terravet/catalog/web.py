"""Queries over pages and URLs."""

from pyspark.sql import functions as F

from .. import params as P
from ..functions import web as W
from ..plans import discovery as D
from .registry import query
from .texts import sql_norm

YEAR = 2025
TERMS = ["the", "of", "heon", "tion the", "erheit", "queau"]
SQL_TERMS = str(TERMS)

MASKED = """replace(regexp_replace(html, '<!--.*?-->', '<!>', 'gs'), 'var t="</p>"', 'var t="' || chr(1) || '/p>"')"""
TAG = """</?[A-Za-z](?:"[^"]*"|''[^'']*''|[^''">]+)*>|<[!?][^>]*>"""


def sql_text(c):
    return f"replace({sql_norm(f"regexp_replace({c}, '{TAG}', ' ', 'g')")}, chr(1), '<')"


TITLE = sql_norm("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
TEXT = sql_text(MASKED)
HOST = "lower(regexp_extract({u}, '^https?://([^/?#]*)', 1))"
PATH = "regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1)"
QUERY = r"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"


def sql_canonical(u, drop=True):
    q = QUERY.format(u=u)
    if drop:
        q = f"""array_to_string(list_filter(string_split({q}, '&'), lambda x: x <> '' AND
            NOT regexp_matches(lower(x), '^(utm_|spm|from|share)')), '&')"""
    base = f"lower(regexp_extract({u}, '^(https?://[^/?#]*)', 1)) || regexp_replace({PATH.format(u=u)}, '/+', '/', 'g')"
    return f"({base} || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END)"


SQL_LINKS = f"""(SELECT page_id, url, pos, href, anchor FROM (SELECT page_id, url, generate_subscripts(a, 1) - 1 AS pos,
    unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href,
    unnest(a) AS anchor FROM (SELECT page_id, url, html,
    list_transform(regexp_extract_all(html, '(?s)<a href="[^"]*">(.*?)</a>', 1), lambda x: {sql_text('x')}) AS a FROM pages)))"""


@query("page_metadata", "S6", f"SELECT page_id, {TITLE} AS title, '' AS description, {TEXT} AS text FROM pages")
def _(t):
    return t.pages.select("page_id", F.inline(F.array(W.page_metadata(F.col("html"))))).drop("meta")


MESSY = "replace(replace(url, 'http', ' HTTP'), '.example', '.EXAMPLE')"


@query("canonicalize_url", "F13", f"SELECT page_id, {sql_canonical('trim(' + 'url' + ')')} AS url FROM pages")
def _(t):
    messy = F.concat(F.lit(" "), F.replace(F.replace("url", F.lit("http"), F.lit("HTTP")), F.lit(".example"), F.lit(".EXAMPLE")))
    doubled = F.regexp_replace(messy, "(EXAMPLE[.a-z]*)/", "$1//")
    return t.pages.select("page_id", W.canonicalize_url(doubled).alias("url"))


@query("canonicalize_url_keep_query", "F14", f"SELECT page_id, {sql_canonical('url', False)} AS url FROM pages")
def _(t):
    return t.pages.select("page_id", W.canonicalize_url_keep_query(F.col("url")).alias("url"))


@query("host_of", "F15", f"SELECT page_id, {HOST.format(u='url')} AS host FROM pages")
def _(t):
    return t.pages.select("page_id", W.host_of(F.upper("url")).alias("host"))


MIME = "CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/json' WHEN 2 THEN 'text/csv' WHEN 3 THEN 'text/HTML; charset=x' ELSE '' END"
EXT_URL = "url || CASE WHEN page_id % 3 = 0 THEN '.DOCX' WHEN page_id % 3 = 1 THEN '.xyz' ELSE '' END"


@query("content_kind", "F16", f"""SELECT page_id, CASE WHEN contains(m, 'pdf') THEN 'pdf' WHEN p LIKE '%.docx' THEN 'docx'
    WHEN contains(m, 'html') OR p LIKE '%.html' OR NOT contains(string_split(p, '/')[-1], '.') THEN 'html'
    WHEN contains(m, 'json') THEN 'json' WHEN contains(m, 'csv') THEN 'csv' ELSE 'other' END AS kind FROM
    (SELECT page_id, lower({MIME}) AS m, lower({PATH.format(u='(' + EXT_URL + ')')}) AS p FROM pages)""")
def _(t):
    return t.sql(f"SELECT page_id, {MIME} AS m, {EXT_URL} AS u FROM pages").select(
        "page_id", W.content_kind(F.col("m"), F.col("u")).alias("kind"))


LINK_URL = f"regexp_extract(url, '^(https?://[^/?#]*)', 1) || href"


@query("extract_links", "F17", f"""SELECT page_id, u AS url, arg_min(anchor, pos) AS anchor FROM
    (SELECT page_id, pos, anchor, lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || href AS u FROM {SQL_LINKS})
    GROUP BY page_id, u""")
def _(t):
    return t.pages.select("page_id", F.explode(W.extract_links(F.col("html"), F.col("url"))).alias("l")).select("page_id", "l.*")


DATE_TEXT = """CASE o_orderkey % 6 WHEN 0 THEN 'on 20' || (10 + o_orderkey % 20) || '-' || (1 + o_orderkey % 14) || '-' || (1 + o_custkey % 33) || 'x'
    WHEN 1 THEN 't20' || (10 + o_orderkey % 20) || '0' || (1 + o_orderkey % 9) || (10 + o_custkey % 25) || '_1'
    WHEN 2 THEN '20' || (10 + o_orderkey % 20) || '年' || (1 + o_orderkey % 15) || '月'
    WHEN 3 THEN 'P020' || (10 + o_orderkey % 20) || '01175350' WHEN 4 THEN 'year 20' || (10 + o_orderkey % 20) || ' only' ELSE 'none' END"""


def sql_date(c):
    g = lambda p, i: f"regexp_extract({c}, '{p}', {i})"
    full, tight = r"(20\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})日?", r"(20\d{2})(\d{2})(\d{2})"
    month = r"(20\d{2})[-/.年](\d{1,2})"
    d = lambda p: (f"strftime(TRY_CAST({g(p, 1)} || '-' || lpad({g(p, 2)}, 2, '0') || '-' || lpad({g(p, 3)}, 2, '0') AS DATE), '%Y-%m-%d')")
    return f"""coalesce({d(full)}, {d(tight)}, {d('t' + tight)}, CASE WHEN TRY_CAST({g(month, 2)} AS INTEGER) BETWEEN 1 AND 12
        THEN {g(month, 1)} || '-' || lpad({g(month, 2)}, 2, '0') END, {g(r'(20\d{2})', 1)})"""


@query("parse_dateish", "F18", f"SELECT o_orderkey, {sql_date('d')} AS d FROM (SELECT o_orderkey, {DATE_TEXT} AS d FROM orders)")
def _(t):
    return t.sql(f"SELECT o_orderkey, {DATE_TEXT} AS d FROM orders").select("o_orderkey", W.parse_dateish(F.col("d")).alias("d"))


PUBLISHED = sql_date(f"({TITLE} || '  ' || url || ' ' || html)")


@query("published_date", "F19", f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '2024-03-0' || (1 + page_id % 9)
    ELSE {PUBLISHED} END AS d FROM pages""")
def _(t):
    tag = F.when(F.col("page_id") % 3 == 0, F.concat(
        F.lit("<META content='2024/3/"), 1 + F.col("page_id") % 9, F.lit("' Name = PubDate>"))).otherwise("")
    html = F.concat(F.col("html"), tag)
    p = t.pages.select("page_id", "url", "html", F.inline(F.array(W.page_metadata(html))))
    return p.select("page_id", W.published_date(F.col("meta"), F.col("title"), F.col("description"),
                                                F.col("url"), F.col("html")).alias("d"))


HOSTED = """CASE page_id % 7 WHEN 0 THEN 'https://www.oecd.org/a/' || page_id WHEN 1 THEN 'https://data.beijing.gov.cn/' || page_id
    WHEN 2 THEN 'http://www.gov.cn/x/' || page_id WHEN 3 THEN 'https://a.bjhd.gov.cn/y' WHEN 4 THEN 'https://lab.x.edu.cn/z'
    WHEN 5 THEN 'https://xinhuanet.com/n' ELSE url END"""
HEADLINE = """CASE page_id % 4 WHEN 0 THEN '实施方案 2035 the_site' WHEN 1 THEN 'x_通知' WHEN 2 THEN '登录 page' ELSE '文化 of heon' END"""
AUTH_IN = f"(SELECT page_id, {HOSTED} AS u, {HEADLINE} AS title, html AS body FROM pages)"
FORMAL = "|".join(P.FORMAL_DOC_TERMS)


def sql_authority(u, title, text):
    main = f"regexp_extract({title}, '^([^_|｜]*)', 1)"
    host = HOST.format(u=u)
    tx = f"lower({main} || ' ' || {text} || ' ' || {u})"
    return f"""CASE WHEN contains({tx}, 'ssologin') OR contains({title}, '登录') THEN 'X'
      WHEN {host} IN ({str(P.INTERNATIONAL_HOSTS)[1:-1]}) THEN 'A3' WHEN {host} IN ({str(P.MEDIA_HOSTS)[1:-1]}) THEN 'A2'
      WHEN ({host} LIKE '%.gov.cn' OR {host} = 'cac.gov.cn') AND ({host} = 'data.beijing.gov.cn' OR regexp_matches(lower({main} || ' ' || {u}), '{FORMAL}')
        OR (contains({tx}, '政府公报') AND regexp_matches({tx}, '规划纲要|实施方案|通知'))) THEN 'A0'
      WHEN {host} LIKE '%.gov.cn' OR {host} = 'cac.gov.cn' OR {host} LIKE '%.edu.cn' THEN 'A1' ELSE 'A2' END"""


def sql_recency(pub, title, text):
    y = f"TRY_CAST(regexp_extract({pub}, '^(20[0-9][0-9])', 1) AS INTEGER)"
    hay = f"lower({title} || ' ' || {text})"
    return f"""CASE WHEN {y} >= {YEAR} THEN 'T0' WHEN {y} = {YEAR - 1} THEN 'T1'
      WHEN regexp_matches({hay}, '{"|".join(P.PLAN_PERIOD_WORDS)}') THEN 'T2'
      WHEN regexp_matches({hay}, '{"|".join(P.HERITAGE_WORDS)}') THEN 'T3' ELSE 'T4' END"""


def sql_hits(title, text, url):
    hay = f"replace(lower({title} || ' ' || {text} || ' ' || {url}), ' ', '')"
    return f"list_sort(list_filter({SQL_TERMS}, lambda k: contains({hay}, replace(lower(k), ' ', ''))))"


@query("classify_authority", "F23", f"SELECT page_id, {sql_authority('u', 'title', 'body')} AS authority FROM {AUTH_IN}")
def _(t):
    return t.sql(f"SELECT * FROM {AUTH_IN}").select("page_id", W.classify_authority(
        F.col("u"), F.col("title"), F.col("body")).alias("authority"))


PUB_IN = "CASE page_id % 5 WHEN 0 THEN '2026-01-01' WHEN 1 THEN '2025' WHEN 2 THEN '2024-07' WHEN 3 THEN '2019' ELSE '' END"


@query("classify_recency", "F24", f"SELECT page_id, {sql_recency(PUB_IN, 'title', 'body')} AS recency FROM {AUTH_IN}")
def _(t):
    return t.sql(f"SELECT *, {PUB_IN} AS pub FROM {AUTH_IN}").select("page_id", W.classify_recency(
        F.col("pub"), F.col("title"), F.col("body"), YEAR).alias("recency"))


@query("topic_hits", "F25", f"SELECT page_id, array_to_string({sql_hits('title', 'body', 'u')}, '|') AS hits FROM {AUTH_IN}")
def _(t):
    return t.sql(f"SELECT * FROM {AUTH_IN}").select("page_id", F.array_join(
        W.topic_hits(F.col("title"), F.col("body"), F.col("u"), TERMS), "|").alias("hits"))


def sql_scored(source):
    """Adds kind-independent score parts to a relation with seq, u, title, body, pub and kind_points."""
    return f"""(SELECT *, greatest(0, least(100, CASE authority WHEN 'A0' THEN 48 WHEN 'A1' THEN 38 WHEN 'A2' THEN 20 WHEN 'A3' THEN 26 ELSE -50 END
      + CASE recency WHEN 'T0' THEN 26 WHEN 'T1' THEN 21 WHEN 'T2' THEN 19 WHEN 'T3' THEN 10 ELSE 0 END
      + least(28, 4 * len(hits)) + kind_points
      + CASE WHEN regexp_matches(lower(title || ' ' || u), '{FORMAL}') THEN 6 ELSE 0 END
      - CASE WHEN draft THEN 8 ELSE 0 END - CASE WHEN len(hits) = 0 AND authority NOT IN ('A0','A3') THEN 12 ELSE 0 END))::INTEGER AS score,
      array_to_string(list_filter([CASE WHEN draft THEN 'draft_or_consultation' END, CASE WHEN authority = 'X' THEN 'excluded_or_login' END,
        CASE WHEN len(hits) = 0 AND authority NOT IN ('A0','A3') THEN 'low_topic_match' END], lambda x: x IS NOT NULL), ';') AS notes
      FROM (SELECT *, {sql_authority('u', 'title', 'body')} AS authority, {sql_recency('pub', 'title', 'body')} AS recency,
        {sql_hits('title', 'body', 'u')} AS hits, contains(title || ' ' || body, '征求意见') AS draft FROM {source}))"""


SCORE_IN = f"""(SELECT page_id, {HOSTED} AS u, {HEADLINE} || CASE WHEN page_id % 11 = 0 THEN '征求意见' ELSE '' END AS title,
    CASE WHEN page_id % 3 = 0 THEN 'zz' ELSE html END AS body, {PUB_IN} AS pub,
    CASE WHEN page_id % 2 = 0 THEN 'application/pdf' ELSE 'text/html' END AS mime,
    CASE WHEN page_id % 2 = 0 THEN 5 ELSE 0 END AS kind_points FROM pages)"""


@query("score_candidate", "F26", f"""SELECT page_id, score, authority, recency, array_to_string(hits, '|') AS hits, notes
    FROM {sql_scored(SCORE_IN)}""")
def _(t):
    s = t.sql(f"SELECT * FROM {SCORE_IN}").select("page_id", W.score_candidate(
        F.col("u"), F.col("title"), F.col("body"), F.col("pub"), F.col("mime"), YEAR, TERMS).alias("s"))
    return s.select("page_id", F.inline(F.array("s"))).select(
        "page_id", "score", "authority", "recency", F.array_join("topic_hits", "|").alias("hits"), "notes")


@query("review_bucket", "F27", """SELECT event_id, CASE WHEN v >= 75 THEN 'core_review' WHEN v >= 55 THEN 'secondary_review'
    WHEN v >= 35 THEN 'background' ELSE 'low_priority' END AS bucket FROM (SELECT event_id, (event_id % 101) AS v FROM events)""")
def _(t):
    return t.events.select("event_id", W.review_bucket(F.col("event_id") % 101).alias("bucket"))


def sql_relevance(u, anchor):
    hay = f"replace(lower({anchor} || '  ' || {u}), ' ', '')"
    host = HOST.format(u=u)
    return f"""(6 * len(list_filter({SQL_TERMS}, lambda k: contains({hay}, replace(lower(k), ' ', ''))))
      + CASE WHEN {host} LIKE '%.gov.cn' OR {host} = 'cac.gov.cn' THEN 12 ELSE 0 END
      + CASE WHEN regexp_matches({anchor} || ' ' || {u}, '{FORMAL}') THEN 8 ELSE 0 END
      + CASE WHEN regexp_matches({anchor} || ' ' || {u}, '20(25|26)') THEN 5 ELSE 0 END)::INTEGER"""


@query("link_relevance", "F28", f"SELECT page_id, {sql_relevance('u', 'title')} AS score FROM {AUTH_IN}")
def _(t):
    return t.sql(f"SELECT * FROM {AUTH_IN}").select("page_id", W.link_relevance(F.col("u"), F.col("title"), TERMS).alias("score"))


@query("title_from_url", "F47", f"""SELECT page_id, {sql_norm("regexp_replace(n, '[_-]+', ' ', 'g')")} AS title FROM
    (SELECT page_id, string_split(rtrim({PATH.format(u='url')}, '/'), '/')[-1] || '_a-b c' AS n FROM pages)""")
def _(t):
    u = F.concat(F.regexp_replace("url", r"/?([?#].*)?$", ""), F.lit("_a-b%20c//?x=1"))
    return t.pages.select("page_id", W.title_from_url(u).alias("title"))


URL_MIX = "CASE page_id % 6 WHEN 0 THEN 'ftp://x/y' WHEN 1 THEN 'https://map.baidu.com/' || page_id WHEN 2 THEN url || '' WHEN 3 THEN 'https://e.org/a.JPG?x' WHEN 4 THEN 'https://www.bing.com/q' ELSE 'https://e.org/Login' END"


def sql_supported(u):
    return f"""(regexp_matches({u}, '^https?://') AND NOT regexp_matches(lower({u}), 'map\\.baidu|amap\\.com|qq\\.com/map|google\\.com/maps')
      AND NOT regexp_matches(lower({PATH.format(u=u)}), '\\.(jpg|jpeg|png|gif|webp|svg|css|js|ico|mp4|mp3|zip|rar)$'))"""


@query("supported_url", "P59", f"SELECT page_id, {sql_supported('u')} AS ok FROM (SELECT page_id, {URL_MIX} AS u FROM pages)")
def _(t):
    return t.sql(f"SELECT page_id, {URL_MIX} AS u FROM pages").select("page_id", W.supported_url(F.col("u")).alias("ok"))


@query("search_result_url", "P60", f"""SELECT page_id, {sql_supported('u')} AND {HOST.format(u='u')} NOT IN ('www.bing.com','cn.bing.com','baidu.com','www.baidu.com','')
    AND NOT regexp_matches(lower(u || ' ' || a), 'javascript|login|sso') AS ok
    FROM (SELECT page_id, {URL_MIX} AS u, CASE WHEN page_id % 4 = 0 THEN 'SSO' ELSE 'read' END AS a FROM pages)""")
def _(t):
    return t.sql(f"SELECT page_id, {URL_MIX} AS u, CASE WHEN page_id % 4 = 0 THEN 'SSO' ELSE 'read' END AS a FROM pages").select(
        "page_id", W.result_url(F.col("u"), F.col("a")).alias("ok"))


# ---- discovery jobs -------------------------------------------------------------------

ITEM_URL = "replace(url, 'page=2', 'utm_z=1')"
SEEDS = f"SELECT {ITEM_URL} AS url, page_id AS seq FROM pages WHERE page_id % 3 <> 1"
SEARCHES = f"SELECT lower({ITEM_URL}) AS url, page_id AS seq, 'q' || page_id % 5 AS query FROM pages WHERE page_id % 3 <> 0"
SEED_LINKS = f"SELECT replace({ITEM_URL}, '/en/', '//en/') AS url, page_id AS seq, url AS source_seed FROM pages WHERE page_id % 2 = 0"
ITEMS = f"""(SELECT url, 'seed' AS method, '' AS query, '' AS source_seed, 0 AS method_rank, seq FROM ({SEEDS}) WHERE {sql_supported('url')}
    UNION ALL SELECT url, 'search', query, '', 1, seq FROM ({SEARCHES}) UNION ALL SELECT url, 'seed_link', '', source_seed, 2, seq FROM ({SEED_LINKS}))"""


def _items(t):
    return D.all_items(t.sql(SEEDS), t.sql(SEARCHES), t.sql(SEED_LINKS))


@query("all_items", "U1", f"SELECT * FROM {ITEMS}")
def _(t):
    return _items(t)


@query("first_per_url", "W2", f"""SELECT url, method, query, source_seed, method_rank, seq, canonical FROM (SELECT *, row_number() OVER
    (PARTITION BY canonical ORDER BY method_rank, seq) AS rn FROM (SELECT *, {sql_canonical('url')} AS canonical FROM {ITEMS})) WHERE rn = 1""")
def _(t):
    return D.first_per_url(_items(t))


CAND = "SELECT event_id AS seq, 'k' || user_id AS canonical, event_type AS authority, props AS title, CAST(floor(value) AS INTEGER) AS score FROM events"


@query("best_per_url", "W1", f"""SELECT seq, canonical, authority, title, score FROM (SELECT *, row_number() OVER
    (PARTITION BY canonical ORDER BY score DESC, seq) AS rn FROM ({CAND})) WHERE rn = 1""")
def _(t):
    return D.best_per_url(t.sql(CAND))


@query("rank_candidates", "O1", f"""SELECT * FROM ({CAND}) WHERE score >= 5 ORDER BY score DESC, authority, title, canonical, seq LIMIT 40""")
def _(t):
    # A unique key keeps the cut the same in both engines.
    return D.rank_candidates(t.sql(CAND).withColumn("canonical", F.concat("canonical", F.format_string("%012d", "seq"))), 5, 40).withColumn(
        "canonical", F.expr("substr(canonical, 1, length(canonical) - 12)"))


REL = f"""(SELECT url AS seed_url, pos, u, anchor, {sql_relevance('u', 'anchor')} AS relevance FROM
    (SELECT url, pos, anchor, lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || href AS u FROM {SQL_LINKS}))"""


@query("rank_links", "W17", f"""SELECT seed_url, u AS url, anchor, relevance, rank FROM (SELECT *, row_number() OVER
    (PARTITION BY seed_url ORDER BY relevance DESC, pos)::INTEGER AS rank FROM {REL} WHERE relevance > 0) WHERE rank <= 3""")
def _(t):
    return D.rank_links(D.seed_page_links(t.pages, TERMS), 3).drop("pos")


PAGE_IN = f"""(SELECT page_id AS seq, url AS u, {TITLE} AS title, ' ' || {TEXT} || ' ' || html AS body,
    {PUBLISHED} AS pub, 0 AS kind_points FROM pages)"""
FOUND = f"""(SELECT * FROM (SELECT *, {sql_canonical('u')} AS canonical FROM {sql_scored(PAGE_IN)}) WHERE authority <> 'X')"""
BUCKETS = "CASE WHEN score >= 75 THEN 'core_review' WHEN score >= 55 THEN 'secondary_review' WHEN score >= 35 THEN 'background' ELSE 'low_priority' END"


def _pages(t):
    return t.pages.select(F.col("page_id").alias("seq"), "url", "html", F.lit("text/html").alias("content_type"))


@query("source_discovery", "C16", f"""SELECT seq, u AS url, canonical, title, pub AS published_date, 'text/html' AS content_type, score, authority, recency,
    array_to_string(hits, '|') AS topic_hits, notes, {BUCKETS} AS review_bucket FROM (SELECT *, row_number() OVER
    (PARTITION BY canonical ORDER BY score DESC, seq) AS rn FROM {FOUND}) WHERE rn = 1 AND score >= 20""")
def _(t):
    return D.discover(_pages(t), YEAR, 20, terms=TERMS).withColumn("topic_hits", F.array_join("topic_hits", "|"))


RANKED = f"(SELECT *, {BUCKETS} AS review_bucket FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY score DESC, seq) AS rn FROM {FOUND}) WHERE rn = 1)"


@query("discovery_summary", "G3", f"""SELECT 'bucket' AS kind, review_bucket AS value, count(*) AS n FROM {RANKED} GROUP BY 2
    UNION ALL SELECT 'authority', authority, count(*) FROM {RANKED} GROUP BY 2
    UNION ALL SELECT 'recency', recency, count(*) FROM {RANKED} GROUP BY 2
    UNION ALL SELECT 'top_urls_sha256', sha256(string_agg(canonical, chr(10) ORDER BY score DESC, authority, title, canonical)), 1
    FROM (SELECT * FROM {RANKED} ORDER BY score DESC, authority, title, canonical LIMIT 50)""")
def _(t):
    return D.discovery_summary(D.best_per_url(D.candidates(_pages(t), YEAR, TERMS).filter("authority <> 'X'")))


# ---- registry drafts --------------------------------------------------------------------

@query("normalize_id", "F30", """SELECT c_custkey, 'DRAFT-' || CASE WHEN b = '' THEN 'URL-' || upper(left(sha1(c_name), 10)) ELSE b END AS id
    FROM (SELECT c_custkey, c_name, upper(trim(regexp_replace(CASE WHEN c_custkey % 3 = 0 THEN '--' ELSE c_mktsegment || ' / ' || c_name END,
    '[^A-Za-z0-9]+', '-', 'g'), '-')) AS b FROM customer)""")
def _(t):
    v = F.when(F.col("c_custkey") % 3 == 0, "--").otherwise(F.concat_ws(" / ", "c_mktsegment", "c_name"))
    return t.customer.select("c_custkey", W.normalize_id(v, F.col("c_name")).alias("id"))


SEED_ROWS = f"""SELECT page_id AS seq, CASE WHEN page_id % 4 = 0 THEN 'src ' || page_id % 9 ELSE '' END AS id,
    CASE WHEN page_id % 5 = 0 THEN '' ELSE 'title 办法 ' || page_id % 20 END AS title, {HOSTED} AS url,
    CASE WHEN page_id % 6 = 0 THEN 'auto_pdf' WHEN page_id % 6 = 1 THEN 'keyed_api' WHEN page_id % 6 = 2 THEN 'metadata_html' ELSE '' END AS type,
    CASE WHEN page_id % 3 = 0 THEN 'osm|x y' ELSE '' END AS topic, CASE WHEN page_id % 7 = 2 THEN 'a|b|c|d|e|f' ELSE '' END AS topic_hits,
    CASE WHEN page_id % 8 = 0 THEN '征求意见 open_data' ELSE 'odd 2021-02-03' END AS notes, '' AS published_date, '' AS authority, '' AS recency,
    'text/html' AS content_type, '' AS accessed_date FROM pages"""
KNOWN_ROWS = "SELECT url FROM pages WHERE page_id % 13 = 0"
DERIVED = f"""(SELECT *, CASE WHEN title = '' THEN url ELSE title END AS ttl, {sql_canonical('url', False)} AS canonical FROM ({SEED_ROWS}))"""
DRAFT_BASE = f"""(SELECT *, {sql_authority('url', 'ttl', 'notes')} AS auth, {sql_date("(ttl || ' ' || url || ' ' || notes)")} AS dt,
    CASE WHEN regexp_matches(lower(type || ' ' || notes || ' ' || url), 'keyed_api|userkey|登录') THEN 'restricted_or_unknown' ELSE 'public_url' END AS access
    FROM {DERIVED} WHERE canonical NOT IN (SELECT {sql_canonical('url', False)} FROM ({KNOWN_ROWS})))"""
DRAFT_KIND = """CASE WHEN regexp_matches(hay, 'openstreetmap|odbl') THEN 'open_license_reference' WHEN auth = 'A3' THEN 'international_reference'
    WHEN auth = 'A2' THEN 'media_report' WHEN contains(url, 'data.beijing.gov.cn') OR regexp_matches(hay, 'open_data|数据目录') THEN 'official_open_data'
    WHEN regexp_matches(ttl, '标准|办法|导则|指南') OR contains(hay, 'standard') THEN 'official_standard'
    WHEN regexp_matches(ttl, '公告|资格预审') THEN 'official_announcement' WHEN auth IN ('A0','A1') THEN 'official_news' ELSE 'media_report' END"""
DRAFT_FILE = """CASE WHEN contains(type, 'pdf') THEN 'pdf' WHEN type = 'metadata_html' THEN 'webpage' ELSE 'html' END"""
DRAFT_FORMAL = "CASE WHEN access = 'restricted_or_unknown' THEN 'no' WHEN auth IN ('A0','A1','A3') THEN 'background_only' ELSE 'no' END"


@query("registry_derivations", "F29", f"""SELECT seq, {DRAFT_FILE} AS file_type, {DRAFT_KIND} AS source_kind, access, {DRAFT_FORMAL} AS formal,
    (1 + CASE WHEN topic <> '' THEN 1 ELSE 0 END + CASE WHEN auth = 'A0' THEN 1 ELSE 0 END)::INTEGER AS n_allowed,
    (3 + CASE WHEN access <> 'public_url' THEN 1 ELSE 0 END + CASE WHEN contains(ttl || notes, '征求意见') THEN 1 ELSE 0 END)::INTEGER AS n_prohibited
    FROM (SELECT *, lower(ttl || ' ' || url || ' ' || topic || ' ' || notes) AS hay, CASE WHEN regexp_matches(lower(type || ' ' || notes || ' ' || url),
    'keyed_api|userkey|登录') THEN 'restricted_or_unknown' ELSE 'public_url' END AS access, {sql_authority('url', 'ttl', 'notes')} AS auth FROM {DERIVED})""")
def _(t):
    r = t.sql(SEED_ROWS).withColumn("title", F.when(F.col("title") == "", F.col("url")).otherwise(F.col("title")))
    r = r.withColumn("auth", W.classify_authority(F.col("url"), F.col("title"), F.col("notes")))
    r = r.withColumn("access", W.registry_access(F.col("type"), F.col("notes"), F.col("url")))
    return r.select("seq", W.registry_file_type(F.col("type"), F.col("content_type"), F.col("url")).alias("file_type"),
                    W.registry_source_kind(F.col("auth"), F.col("url"), F.col("title"), F.col("topic"), F.col("notes")).alias("source_kind"),
                    "access", W.registry_formal_use(F.col("auth"), F.col("access")).alias("formal"),
                    F.size(W.registry_allowed_uses(F.col("topic"), F.col("auth"))).alias("n_allowed"),
                    F.size(W.registry_prohibited_uses(F.col("title"), F.col("notes"), F.col("access"))).alias("n_prohibited"))


@query("new_urls", "J5", f"""SELECT seq, canonical FROM {DERIVED} WHERE canonical NOT IN (SELECT {sql_canonical('url', False)} FROM ({KNOWN_ROWS}))""")
def _(t):
    return D.new_urls(t.sql(SEED_ROWS), t.sql(KNOWN_ROWS)).select("seq", "canonical")


# A fourth of the rows form a family whose natural ids meet generated ones.
SUFFIX_IN = """(SELECT c_custkey AS seq, CASE c_custkey % 40 WHEN 0 THEN 'X' WHEN 1 THEN 'X' WHEN 2 THEN 'X-2-2' WHEN 3 THEN 'X-2' WHEN 4 THEN 'X-4' WHEN 5 THEN 'X-2'
    WHEN 6 THEN 'Y-7' WHEN 7 THEN 'Z-2' ELSE c_mktsegment END AS id FROM customer)"""


@query("suffix_ids", "W4", f"""WITH RECURSIVE f AS (SELECT seq, id, row_number() OVER (ORDER BY seq) AS i FROM {SUFFIX_IN} WHERE starts_with(id, 'X')),
    st AS (SELECT 0::BIGINT AS i, 0::BIGINT AS seq, '' AS source_id, []::VARCHAR[] AS used UNION ALL
      SELECT i, seq, made, list_append(used, made) FROM (SELECT f.i, f.seq, used, CASE WHEN NOT list_contains(used, id) THEN id ELSE id || '-' ||
        list_min(list_filter(range(2, f.i + 2), lambda k: NOT list_contains(used, id || '-' || k))) END AS made FROM st JOIN f ON f.i = st.i + 1))
    SELECT seq, source_id FROM st WHERE i > 0 UNION ALL
    SELECT seq, CASE WHEN rn = 1 THEN id ELSE id || '-' || rn END FROM (SELECT seq, id, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM {SUFFIX_IN} WHERE NOT starts_with(id, 'X'))""")
def _(t):
    return D.suffix_ids(t.sql(f"SELECT seq, id AS source_id FROM {SUFFIX_IN}"), block=100)


DRAFT_ID = """'DRAFT-' || upper(trim(regexp_replace(CASE WHEN id <> '' THEN id ELSE ttl || '-' || left(sha1(url), 8) END, '[^A-Za-z0-9]+', '-', 'g'), '-'))"""


@query("registry_draft", "C17", f"""SELECT seq, CASE WHEN rn = 1 THEN sid ELSE sid || '-' || rn END AS source_id, ttl AS title, {DRAFT_KIND} AS source_kind,
    CASE WHEN regexp_matches(dt, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN dt END AS published_date, {DRAFT_FILE} AS file_type, auth2 AS authority_level,
    {sql_recency("CASE WHEN regexp_matches(dt, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN dt ELSE '' END", 'ttl', 'notes')} AS timeliness_level,
    access AS public_access_status, {DRAFT_FORMAL} AS usable_for_formal,
    array_to_string(list_filter(string_split_regex(CASE WHEN topic <> '' THEN topic WHEN topic_hits <> '' THEN topic_hits ELSE 'public_source_candidate' END,
    '[|,;\\s]+'), lambda x: x <> ''), '|') AS topics
    FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY seq) AS rn FROM (SELECT *, {DRAFT_ID} AS sid, CASE WHEN auth = 'X' THEN 'A2' ELSE auth END AS auth2,
    lower(ttl || ' ' || url || ' ' || topic || ' ' || notes) AS hay, row_number() OVER (PARTITION BY canonical ORDER BY seq) AS un FROM {DRAFT_BASE}) WHERE un = 1)""")
def _(t):
    return D.registry_draft(t.sql(SEED_ROWS), t.sql(KNOWN_ROWS), YEAR, "2026-01-01").select(
        "seq", "source_id", "title", "source_kind", "published_date", "file_type", "authority_level", "timeliness_level",
        "public_access_status", "usable_for_formal", F.array_join("topics", "|").alias("topics"))
