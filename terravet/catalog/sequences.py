"""Window, token and indicator queries."""

from pyspark.sql import functions as F

from ..functions import indicators as I
from ..operators import sequences as S
from ..plans import indicators as PI
from . import bindings as B
from .registry import query

HOUR = F.date_trunc


@query("dedupe_codes", "W3", """SELECT c_custkey, c FROM (SELECT *, row_number() OVER (PARTITION BY g, c ORDER BY c_custkey) AS rn FROM
    (SELECT c_custkey, c_nationkey AS g, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'P' || (c_custkey % 9) END AS c FROM customer)) WHERE c = '' OR rn = 1""")
def _(t):
    r = t.customer.select("c_custkey", F.col("c_nationkey").alias("g"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(
        F.concat(F.lit("P"), F.col("c_custkey") % 9)).alias("c"))
    return S.dedupe_codes(r, ["g"], "c", "c_custkey").select("c_custkey", "c")


RES = "SELECT user_id AS run_key, CAST(floor(event_id / 200) AS BIGINT) AS run_no, event_type AS fingerprint, CASE WHEN value > 25 THEN 'FAIL' ELSE 'PASS' END AS outcome FROM events"


@query("stall", "W6", f"""WITH s AS (SELECT run_key, run_no, list_sort(list_distinct(list(fingerprint) FILTER (WHERE outcome = 'FAIL'))) AS f FROM ({RES}) GROUP BY 1, 2)
    SELECT run_key, run_no, coalesce(len(f), 0)::INTEGER AS failures, coalesce(len(f) > 0 AND f = lag(f) OVER (PARTITION BY run_key ORDER BY run_no), FALSE) AS stalled FROM s""")
def _(t):
    return S.stall(t.sql(RES), block=10)


HIST = "SELECT user_id % 7 AS run_key, event_id AS seq, ts, event_type AS fingerprint, CASE WHEN value > 5 THEN 'build' ELSE 'check' END AS phase FROM events"


@query("stall_n", "W7", f"""SELECT run_key, seq, coalesce(phase = p1 AND phase = p2 AND fingerprint = f1 AND fingerprint = f2, FALSE) AS stalled FROM (SELECT *, lag(phase) OVER w AS p1, lag(phase, 2) OVER w AS p2,
    lag(fingerprint) OVER w AS f1, lag(fingerprint, 2) OVER w AS f2 FROM ({HIST}) WINDOW w AS (PARTITION BY run_key ORDER BY ts, seq))""")
def _(t):
    return S.stall_n(t.sql(HIST), 3).select("run_key", "seq", "stalled")


@query("ratchet", "W8", f"""SELECT run_key, seq, failures, best_before, CASE WHEN best_before IS NULL OR failures < best_before THEN 'promote' WHEN failures > best_before THEN 'rollback' ELSE 'keep' END AS action,
    least(best_before, failures) AS best FROM (SELECT *, min(failures) OVER (PARTITION BY run_key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM {B.RUNS})""")
def _(t):
    return S.ratchet(B.runs(t)).select("run_key", "seq", "failures", "best_before", "action", "best")


@query("quota_latch", "W9", """WITH r AS (SELECT o_orderkey, o_custkey % 5 AS k, CASE WHEN o_totalprice > 490000 THEN 'quota_exceeded' ELSE 'ok' END AS status, o_orderkey % 3 = 0 AS done FROM orders)
    SELECT o_orderkey, CASE WHEN done THEN 'skipped_resume' WHEN coalesce(max(CASE WHEN NOT done AND status = 'quota_exceeded' THEN 1 ELSE 0 END) OVER
    (PARTITION BY k ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'quota_exceeded' ELSE status END AS final_status FROM r""")
def _(t):
    r = t.orders.select("o_orderkey", (F.col("o_custkey") % 5).alias("k"), F.when(F.col("o_totalprice") > 490000, "quota_exceeded").otherwise("ok").alias("status"),
                        (F.col("o_orderkey") % 3 == 0).alias("done"))
    return S.quota_latch(r, "k", ["o_orderkey"], F.floor(F.col("o_orderkey") / 1000)).select("o_orderkey", "final_status")


TOK = """(SELECT l_orderkey AS page, l_linenumber * 37 + l_partkey % 20 AS y, l_suppkey AS x, l_linenumber AS seq, CASE WHEN l_partkey % 5 = 0 THEN '总计' WHEN l_partkey % 5 = 1 THEN CAST(l_extendedprice AS {t}) ELSE CAST(l_quantity AS {t}) END AS text FROM lineitem)"""
TOK_SQL, TOK_SPARK = TOK.replace("{t}", "DECIMAL(12,2)"), TOK.replace("{t}", "DECIMAL(12,2)")
TOK_SQL = TOK_SQL.replace("THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE CAST(l_quantity AS DECIMAL(12,2)) END", "THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) ELSE CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR) END")
TOK_SPARK = TOK_SPARK.replace("THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE CAST(l_quantity AS DECIMAL(12,2)) END", "THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) ELSE CAST(CAST(l_quantity AS DECIMAL(12,2)) AS STRING) END")


def tokens(t):
    return t.sql(f"SELECT * FROM {TOK_SPARK}")


@query("token_bands", "W10", f"""WITH RECURSIVE ys AS (SELECT DISTINCT page, y FROM {TOK_SQL}), st AS (SELECT page, min(y) AS s FROM ys GROUP BY page
    UNION ALL SELECT st.page, (SELECT min(y) FROM ys WHERE ys.page = st.page AND ys.y > st.s + 25) AS s FROM st WHERE EXISTS (SELECT 1 FROM ys WHERE ys.page = st.page AND ys.y > st.s + 25))
    SELECT t.page, t.y, t.x, t.seq, max(s) AS band, count(*) OVER (PARTITION BY t.page, t.y, t.x, t.seq) AS copies FROM (SELECT *, row_number() OVER () AS u FROM {TOK_SQL}) t JOIN st ON st.page = t.page AND st.s <= t.y
    GROUP BY t.page, t.y, t.x, t.seq, t.u""")
def _(t):
    from pyspark.sql import Window
    b = S.bands(tokens(t), ["page"])
    return b.select("page", "y", "x", "seq", "band").withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("page", "y", "x", "seq")))


@query("merge_token_rows", "W11", """WITH c AS (SELECT l_orderkey AS page, l_linenumber * 3 + l_partkey % 3 AS yk, 'c' || (l_suppkey % 2) AS col, max(l_partkey) AS v FROM lineitem GROUP BY 1, 2, 3),
    k AS (SELECT page, yk, sum(g) OVER (PARTITION BY page ORDER BY yk) AS bucket FROM (SELECT page, yk, CASE WHEN yk - lag(yk) OVER (PARTITION BY page ORDER BY yk) <= 2 THEN 0 ELSE 1 END AS g FROM (SELECT DISTINCT page, yk FROM c)))
    SELECT page, bucket::BIGINT AS bucket, col, CASE WHEN p IS NOT NULL AND p % 2 = 0 AND v % 2 = 1 THEN p || '.' || v ELSE CASE WHEN v % 2 = 0 THEN v || '.' ELSE v || '' END END AS value FROM
    (SELECT page, bucket, col, v, row_number() OVER (PARTITION BY page, bucket, col ORDER BY yk DESC) AS rn, lag(v) OVER (PARTITION BY page, bucket, col ORDER BY yk) AS p FROM c JOIN k USING (page, yk)) WHERE rn = 1""")
def _(t):
    c = t.lineitem.select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 3 + F.col("l_partkey") % 3).alias("yk"),
                          F.concat(F.lit("c"), F.col("l_suppkey") % 2).alias("col"), "l_partkey").groupBy("page", "yk", "col").agg(F.max("l_partkey").alias("v"))
    c = c.withColumn("value", F.when(F.col("v") % 2 == 0, F.concat("v", F.lit("."))).otherwise(F.col("v").cast("string"))).drop("v")
    return S.merge_rows(c, ["page"])


@query("assign_column", "W12", f"""SELECT page, seq, x, y, arg_min(c, d * 10 + p) AS col FROM (SELECT t.page, t.seq, t.x, t.y, h.c, h.p, abs(t.x - (h.hx + t.page % 7)) AS d, u FROM (SELECT *, row_number() OVER () AS u FROM {TOK_SQL}) t,
    (VALUES (0, 'land', 20), (1, 'far', 48), (2, 'h', 60)) AS h(p, c, hx)) WHERE d < 15 GROUP BY page, seq, x, y, u""")
def _(t):
    h = t.orders.select(F.col("o_orderkey").alias("page"), F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("col"), F.lit(x).alias("b"))
                        for i, (c, x) in enumerate([("land", 20), ("far", 48), ("h", 60)])])).alias("h")).select(
        "page", "h.pos", "h.col", (F.col("h.b") + F.col("page") % 7).alias("x"))
    return S.assign_column(tokens(t), h, "page").select("page", "seq", "x", "y", "col")


WORDS = """(SELECT l_orderkey AS doc, l_linenumber % 4 AS page, CAST(50 + l_partkey % 170 AS DOUBLE) AS y, CAST(130 + l_suppkey * 3 AS DOUBLE) AS x,
    CASE l_partkey % 7 WHEN 0 THEN '用地规模' WHEN 1 THEN '控制高度' WHEN 2 THEN '容积' WHEN 3 THEN '地上建筑' WHEN 4 THEN '绿地' WHEN 5 THEN '建筑密' ELSE 'x' END AS text FROM lineitem)"""


@query("pick_header", "W13", f"""WITH h AS (SELECT doc, page, CASE text WHEN '用地规模' THEN 0 WHEN '控制高度' THEN 1 WHEN '容积' THEN 2 WHEN '地上建筑' THEN 3 WHEN '绿地' THEN 4 ELSE 5 END AS pos, x FROM {WORDS} WHERE y > 40 AND x >= 140 AND text <> 'x'),
    c AS (SELECT doc, page, pos::INTEGER AS pos, CASE WHEN pos = 0 THEN hi ELSE lo END AS x FROM (SELECT doc, page, pos, max(x) AS hi, min(x) AS lo FROM h GROUP BY doc, page, pos)), p AS (SELECT doc, page, max(x) - min(x) AS spread FROM c GROUP BY ALL HAVING count(*) >= 4),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY spread DESC, page) AS rn FROM p) SELECT c.doc, c.page, c.pos, ['land','h','far','floor','green','density'][pos + 1] AS col, x, spread FROM c JOIN b USING (doc, page) WHERE rn = 1""")
def _(t):
    return S.pick_header(t.sql(f"SELECT * FROM {WORDS}"), "doc")


ATT = """(SELECT o_custkey AS notice, o_orderkey AS pos, CASE o_orderkey % 5 WHEN 0 THEN '规划条件' WHEN 1 THEN '挂牌文件' WHEN 2 THEN '多规合一 规划意见' WHEN 3 THEN '京土整储' ELSE 'other' END || o_orderkey AS name FROM orders)"""


@query("pick_attachments", "W14", f"""SELECT notice, priority::INTEGER AS priority, kind, arg_min(name, pos) AS name FROM {ATT} JOIN (VALUES (0,'dghy','多规合一'),(1,'plancond','规划条件|规划意见'),(2,'gpfile','挂牌文件|京土整储')) AS k(priority, kind, pat)
    ON regexp_matches(name, pat) GROUP BY ALL""")
def _(t):
    return S.pick_attachments(t.sql(f"SELECT * FROM {ATT}"))


@query("total_neighbourhood", "W18", f"""WITH t AS (SELECT * FROM {TOK_SQL}), a AS (SELECT page, first(y ORDER BY seq, y, x) AS y0 FROM t WHERE text = '总计' GROUP BY page),
    n AS (SELECT page, list(text::DOUBLE ORDER BY x, seq, text) AS v FROM t JOIN a USING (page) WHERE abs(y - y0) <= 40 AND text <> '总计' AND text::DOUBLE >= 100 GROUP BY page)
    SELECT page, v[1] AS total_land, v[2] AS total_floor FROM n WHERE len(v) >= 2""")
def _(t):
    return S.totals(tokens(t), ["page"])


@query("token_table_scan", "S10", """SELECT l_orderkey AS doc, l_linenumber + 0 AS y, l_suppkey AS x, l_returnflag || 'z' AS text, count(*) AS n FROM lineitem GROUP BY ALL""")
def _(t):
    from ..sources.readers import read_tokens
    line = F.concat_ws("\t", F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"), F.concat("l_returnflag", F.lit("z")))
    # Parts follow the splits of the input, so that what a task sorts does not grow with the table.
    dealt = t.lineitem.repartition(16 * t.lineitem.rdd.getNumPartitions(), "l_orderkey")
    docs = dealt.groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return read_tokens(docs, "doc", "text").groupBy("doc", F.col("y").cast("int").alias("y"), "x", "text").agg(F.count(F.lit(1)).alias("n"))


# ---- indicator reads ------------------------------------------------------------------------------

@query("normalize_plot_code", "F6", """SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN 'X-' || p_partkey ELSE 'HD00-0' || (400 + p_size) || '-' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 4, '0') END AS code FROM part""")
def _(t):
    tail = F.lpad((F.col("p_partkey") % 1000).cast("string"), 4, "0")
    raw = F.when(F.col("p_size") % 3 == 2, F.concat(F.lit("X-"), F.col("p_partkey"))).when(
        F.col("p_size") % 3 == 0, F.concat(F.lit("hdOO- O"), 400 + F.col("p_size"), F.lit("<"), tail)).otherwise(
        F.concat(F.lit("HDo0=0"), 400 + F.col("p_size"), F.lit("-<"), tail))
    return t.part.select("p_partkey", I.normalize_plot_code(raw).alias("code"))


@query("notice_date", "F21", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders")
def _(t):
    raw = F.when(F.col("o_orderkey") % 4 == 0, "none").otherwise(F.concat(F.lit("于 "), F.date_format("o_orderdate", "yyyy 年M 月 d日"), F.lit(" 发布")))
    return t.orders.select("o_orderkey", I.notice_date(raw).alias("d"))


@query("document_numbers", "F22", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '京规自（海）供审函〔2020〕' || c_custkey || '号' WHEN 1 THEN '2018规土（海）条供字' || c_custkey || '号' ELSE '' END AS doc_no,
    CASE WHEN c_custkey % 2 = 0 THEN '京土储挂（海）[2019]0' || c_custkey || '号' ELSE '' END AS notice_no FROM customer""")
def _(t):
    k, n = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    text = F.concat(F.when(k == 0, F.concat(F.lit("x京规自（海）供审函[2020] "), n, F.lit(" 号y"))).when(k == 1, F.concat(F.lit("2018 规 土(海)条侗 字"), n, F.lit("号"))).otherwise("-"),
                    F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" 京土整储招(海)〔2019〕0"), n, F.lit("号"))).otherwise(""))
    return t.customer.select("c_custkey", I.doc_no(text).alias("doc_no"), I.notice_no(text).alias("notice_no"))


@query("label_reads", "F38", """SELECT p_partkey, CAST(p_size AS VARCHAR) AS far, CASE WHEN p_size % 2 = 0 THEN CAST(p_size + 10 AS VARCHAR) END AS h, '30' AS green, CAST(p_partkey AS VARCHAR) || '.5' AS land, NULL::VARCHAR AS floor FROM part""")
def _(t):
    text = F.concat(F.lit("容积率 ： "), F.col("p_size"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\n控制高度:"), F.col("p_size") + 10, F.lit("米"))).otherwise(""),
                    F.lit("\n绿地率：≥30 %\n建设用地规模："), F.col("p_partkey"), F.lit(".5 平方米"))
    return t.part.select("p_partkey", F.inline(F.array(I.label_reads(text)))).select("p_partkey", "far", "h", "green", "land", "floor")


@query("announcement_reads", "F39", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '1' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') WHEN 1 THEN CAST(p_partkey + 1000 AS VARCHAR) || '.0' ELSE NULL END AS land,
    CASE p_size % 3 WHEN 0 THEN '7000' WHEN 1 THEN CAST(p_partkey + 3000 AS VARCHAR) ELSE NULL END AS floor FROM part""")
def _(t):
    k = F.col("p_partkey")
    a = F.concat(F.lit("总用地面积：1"), F.lpad(k.cast("string"), 6, "0"), F.lit(" 平方米 建筑控制规模:7,000平方米"))
    b = F.concat(F.lit("挂牌编号 （平方米） 12 "), k + 1000, F.lit(" "), k + 1000, F.lit(" "), k + 3000, F.lit(" 起始价 99999999"))
    text = F.when(F.col("p_size") % 3 == 0, a).when(F.col("p_size") % 3 == 1, b).otherwise("nothing")
    return t.part.select("p_partkey", F.inline(F.array(I.announcement_reads(text))))


@query("six_column_rows", "F40", """SELECT p_partkey, 'B地块' AS code, 'R2' AS lu, CAST(p_partkey + 5000 AS VARCHAR) || '.77' AS land, '2.5' AS far, CAST(p_size + 10000 AS VARCHAR) AS floor, '45' AS h, '30' AS density, '35' AS green FROM part""")
def _(t):
    text = F.concat(F.lit("表 B 地块 R2 用 地 "), F.col("p_partkey") + 5000, F.lit(". 77 | 2.5 "), F.col("p_size") + 10000, F.lit(" 45 | 30 35 end"))
    r = t.part.select("p_partkey", F.explode(I.six_column_rows(text)).alias("r"))
    return r.select("p_partkey", "r.code", "r.lu", "r.vals.land", "r.vals.far", "r.vals.floor", "r.vals.h", "r.vals.density", "r.vals.green")


@query("match_row_values", "F41", """SELECT p_partkey, CAST(p_partkey + 100 AS VARCHAR) || '.5' AS land, '2.5' AS far, CASE WHEN p_size % 2 = 0 THEN '40' END AS density,
    CASE WHEN p_size % 2 = 0 THEN '36' ELSE '40' END AS h, '9000' AS floor, CASE WHEN p_size % 4 < 2 THEN '33' END AS green FROM part WHERE p_size % 5 <> 0""")
def _(t):
    nums = F.array(F.lit(3.0), F.col("p_partkey") + 100.5, F.lit(9.0), F.lit(2.5), F.lit(40.0), F.lit(36.0),
                   F.when(F.col("p_size") % 5 == 0, 5.0).otherwise(9000.9), F.when(F.col("p_size") % 4 < 2, 33.0).otherwise(5.0))
    v = t.part.select("p_partkey", I.match_values(nums, F.col("p_size") % 2 == 0).alias("v")).filter("v IS NOT NULL")
    return v.select("p_partkey", "v.land", "v.far", "v.density", "v.h", "v.floor", "v.green")


def plain_texts(t):
    """Notice text per part: two plot rows and a total that agrees for most of them."""
    p = F.col("p_partkey")
    text = F.concat(F.lit("指标表 容积率 建筑密度\nHD00-0403-0"), 100 + p % 800, F.lit(" "), 2000 + p, F.lit(". 5 2.1\n30 24 "), 7000 + F.col("p_size"), F.lit(" 35\nHDoo-0404-0001 3000 1.5 30 20 8000 30\n总 计 "),
                    5000 + p + F.when(F.col("p_size") % 4 == 0, 900).otherwise(0), F.lit(".5 "), 15000 + F.col("p_size"))
    return t.part.select(F.col("p_partkey").alias("doc"), text.alias("text"))


@query("plot_code_windows", "F42", """SELECT p_partkey AS doc, 'HD00-0403-0' || (100 + p_partkey % 800) AS code, CAST(2000 + p_partkey AS VARCHAR) || '.5' AS land, '2.1' AS far, '30' AS density, '24' AS h, CAST(7000 + p_size AS VARCHAR) AS floor, '35' AS green FROM part
    UNION ALL SELECT p_partkey, 'HD00-0404-0001', '3000', '1.5', '30', '20', '8000', '30' FROM part""")
def _(t):
    r = plain_texts(t).select("doc", F.inline(I.plot_rows_plain(F.col("text"))))
    return r.select("doc", "code", "vals.land", "vals.far", "vals.density", "vals.h", "vals.floor", "vals.green")


@query("single_land_code", "F46", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'R2' WHEN 1 THEN '' ELSE 'B23' END AS code FROM part""")
def _(t):
    text = F.when(F.col("p_size") % 3 == 0, "用地R2居住 R22").when(F.col("p_size") % 3 == 1, "B1 and F1").otherwise("none")
    return t.part.select("p_partkey", I.only_land_code(text, F.when(F.col("p_size") % 3 == 2, "地块B23。")).alias("code"))


@query("detail_url", "F48", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'http://x.gov.cn/z/' || p_partkey || '/1.html' WHEN 1 THEN 'https://x.gov.cn/z/' || p_partkey || '/2.html' END AS url FROM part""")
def _(t):
    p = F.col("p_partkey").cast("string")
    a = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("see http://x.gov.cn/z/"), p, F.lit("/1.html")))
    b = F.when(F.col("p_size") % 3 == 1, F.concat(F.lit("z/"), p, F.lit("/2.html and more")))
    return t.part.select("p_partkey", I.detail_url([a, b, F.lit(None).cast("string")], "x.gov.cn", "z").alias("url"))


@query("parcel_indicators", "C21", """WITH r AS (SELECT p_partkey AS doc, p_size AS sz, 'HD00-0403-0' || (100 + p_partkey % 800) AS code, 2000 + p_partkey + 0.5::DOUBLE AS land, (7000 + p_size)::DOUBLE AS floor, 5000 + p_partkey + 0.5::DOUBLE AS t FROM part
    UNION ALL SELECT p_partkey, p_size, 'HD00-0404-0001', 3000.0::DOUBLE, 8000.0::DOUBLE, 5000 + p_partkey + 0.5::DOUBLE FROM part)
    SELECT doc, code, land, floor, 'matched' AS note FROM r WHERE NOT (sz % 4 = 0 AND 900 / (t + 900) > 0.01)""")
def _(t):
    return PI.extract(plain_texts(t)).select("doc", "code", "land", "floor", "note")
