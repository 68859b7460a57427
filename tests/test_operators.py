"""Small fixtures: one change, one expected finding; identities and determinism."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terravet import params as P
from terravet.functions import geo as G
from terravet.functions import indicators as I
from terravet.functions import text as X
from terravet.functions import web as W
from terravet.operators import aggregates as A
from terravet.operators import checks as K
from terravet.operators import documents as D
from terravet.operators import joins as J
from terravet.operators import overlay as O
from terravet.operators import sequences as S
from terravet.plans import boundaries, corridor, discovery, landuse, rules, spatial_review
from terravet.scale import blocked_lag, blocked_row_number, blocked_running

RING = "array<struct<x:double,y:double>>"


def box(x0, y0, x1, y1):
    return [{"x": float(a), "y": float(b)} for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]


# ---- text ----------------------------------------------------------------------------------

def test_space_and_entities(one):
    assert one(X.normalize_space(F.lit(" a&nbsp;　b&amp;lt; &#20013;&#x6587; "))) == "a b&lt; 中文"
    assert one(X.compact_len(F.lit("a 　b\n"))) == 2


def test_front_matter_and_sections(one):
    md = "﻿\n---\n# c\ntitle: \"T\"\ntags: [a, \"b\"]\n---\n\n# top\n## One \nbody\n## Two\n"
    f = one(X.front_matter(F.lit(md)))
    assert {m["key"]: m["value"] for m in f["meta"]} == {"title": "T", "tags": "[a, \"b\"]"} and f["body"].startswith("# top")
    secs = one(X.sections(F.lit(md)))
    assert [(s["title"], s["body"]) for s in secs] == [("One", "body"), ("Two", "")]


@pytest.mark.parametrize("raw,want", [('["a"," b "]', ["a", "b"]), ("[a, 'b',]", ["a", "b"]), ("a,,b", ["a", "b"]), ("", [])])
def test_tag_list(one, raw, want):
    assert one(X.parse_tag_list(F.lit(raw))) == want


def test_hard_risks(spark):
    rows = [(1, "call 13912345678."), (2, "x11010519491231002X"), (3, "no 1391234567"), (4, "已获市政府批准")]
    got = {(r.k, r.reason) for r in D.scan_hard_risk(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    assert {k for k, _ in got} == {1, 4}


def test_forbidden_context(spark):
    docs = spark.createDataFrame([(1, "a" * 30 + "\n承诺落地" + "b" * 50)], "k int, t string")
    r = D.scan_forbidden(docs, "k", "t", ["其他、承诺落地"]).collect()
    assert len(r) == 1 and r[0].context == "a" * 19 + " 承诺落地" + "b" * 30


# ---- web -------------------------------------------------------------------------------------

def test_page_metadata(one):
    html = ("<html><head><title>plain</title><meta content='Article &amp; more' name=\"ArticleTitle\">"
            "<script>if (a<b) t('</p>')</script></head><body><!-- <b>no</b> -->Hi<p>there</body></html>")
    m = one(W.page_metadata(F.lit(html)))
    assert m["title"] == "Article & more" and "Hi there" in m["text"] and "if (a<b)" in m["text"] and "no" not in m["text"].split()


def test_links_are_resolved(one):
    html = '<a href="../x/./y?utm_source=1&k=v#f">One</a><a href="mailto:a@b">m</a><a href="//h.org/z.png">p</a><a href="../x/y?k=v">two</a>'
    links = one(W.extract_links(F.lit(html), F.lit("https://Site.org/a/b/c.html")))
    assert [(x["url"], x["anchor"]) for x in links] == [("https://site.org/a/x/y?k=v", "One")]


@pytest.mark.parametrize("text,want", [
    ("2026年5月9日", "2026-05-09"), ("t20260509_1", "2026-05-09"), ("P0202501175350", "2025-01-17"),
    ("2025-13-40", "2025"), ("2025-02-30", "2025-02"), ("2024/7", "2024-07"), ("none", "")])
def test_dates(one, text, want):
    assert one(W.parse_dateish(F.lit(text))) == want


def test_authority_and_score(one):
    assert one(W.classify_authority(F.lit("https://ghzrzyw.beijing.gov.cn/a"), F.lit("公告_站"), F.lit(""))) == "A0"
    assert one(W.classify_authority(F.lit("https://x.gov.cn/a"), F.lit("news"), F.lit(""))) == "A1"
    assert one(W.classify_authority(F.lit("https://x.org"), F.lit("请登录"), F.lit(""))) == "X"
    s = one(W.score_candidate(F.lit("https://www.gov.cn/a.pdf"), F.lit("百年京张 人工智能 规划公告"), F.lit("海淀"), F.lit("2026-01-01"), F.lit(""), 2026))
    assert s["score"] >= 80 and s["recency"] == "T0"


def test_registry_draft_suffixes_and_known_urls(spark):
    cols = "seq long, id string, title string, url string, type string, topic string, topic_hits string, notes string, published_date string, authority string, recency string, content_type string, accessed_date string"
    blank = [""] * 5
    rows = [(1, "a", "t", "https://x.org/1", "keyed_api", "", "", *blank, ""), (2, "a", "t", "https://x.org/2", "", "k|l", "", *blank, ""),
            (3, "a", "t", "https://x.org//2", "", "", "", *blank, ""), (4, "b", "t", "https://known.org/", "", "", "", *blank, "")]
    known = spark.createDataFrame([("https://KNOWN.org/",)], "url string")
    out = {r.url: r for r in discovery.registry_draft(spark.createDataFrame(rows, cols), known, 2026, "2026-01-01").collect()}
    assert set(out) == {"https://x.org/1", "https://x.org/2"}
    assert sorted(r.source_id for r in out.values()) == ["DRAFT-A", "DRAFT-A-2"]
    assert out["https://x.org/1"].public_access_status == "restricted_or_unknown" and out["https://x.org/1"].usable_for_formal == "no"


# ---- corridor ----------------------------------------------------------------------------------

def test_corridor_invariants(spark):
    random.seed(3)
    rows = [(random.choice("ab"), random.uniform(116.2, 116.5), random.uniform(39.9, 40.1), random.choice(["ok", "ok", "error"])) for _ in range(500)]
    for r in corridor.facility_summary(spark.createDataFrame(rows, "category string, lon double, lat double, status string")).collect():
        assert r.corridor_in + r.corridor_out == r.geocoded_ok and r.geocoded_ok + r.not_geocoded == r.total


# ---- blocked scans against brute force, with one hot key ------------------------------------------

def test_blocked_scans(spark):
    random.seed(5)
    rows = [(0 if i % 3 else i % 5, i, random.randint(0, 50)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, s long, v int")
    blk = F.floor(F.col("s") / 37)
    got = {r.s: r for r in blocked_running(df, ["k"], ["s"], blk, {"m": ("min", F.col("v")), "t": ("sum", F.col("v"))}, False).collect()}
    num = {r.s: r.rn for r in blocked_row_number(df, ["k"], ["s"], blk).collect()}
    lag = {r.s: r.p for r in blocked_lag(df, ["k"], ["s"], blk, {"p": F.col("v")}).collect()}
    seen = {}
    for k, s, v in rows:
        before = seen.setdefault(k, [])
        assert got[s].m == (min(before) if before else None) and got[s].t == sum(before)
        assert num[s] == len(before) + 1 and lag[s] == (before[-1] if before else None)
        before.append(v)


def test_mentions_gram_join_equals_scan(spark):
    random.seed(9)
    text = lambda n: "".join(random.choice("abcd") for _ in range(n))
    docs = [(i, text(200)) for i in range(40)]
    tokens = sorted({text(random.choice([1, 2, 3, 5, 9])) for _ in range(60)})
    d, t = spark.createDataFrame(docs, "k int, t string"), spark.createDataFrame([(x,) for x in tokens], "token string")
    want = {(k, x) for k, s in docs for x in tokens if x in s}
    for small in (0, 1000):
        assert {(r.k, r.token) for r in J.mentions(d, "k", "t", t, small=small).collect()} == want
    rows = J.mentions(d, "k", "t", t, small=0, shard=2).collect()
    assert {(r.k, r.token) for r in rows} == want and len(rows) == len(want)


# ---- geometry ----------------------------------------------------------------------------------------

def test_projection_and_hole(one):
    p = one(G.project(F.struct(F.lit(117.0).alias("x"), F.lit(0.0).alias("y"))))
    assert abs(p["x"] - 500000) < 1e-6 and abs(p["y"]) < 1e-6
    # A degree of the equator near the central meridian.
    q = one(G.project(F.struct(F.lit(117.01).alias("x"), F.lit(0.0).alias("y"))))
    assert abs(q["x"] - 500000 - 6378137 * math.radians(0.01)) < 1e-3


def star(rng, cx, cy, r, n):
    a = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    pts = [{"x": cx + r * rng.uniform(.4, 1) * math.cos(t), "y": cy + r * rng.uniform(.4, 1) * math.sin(t)} for t in a]
    return pts + pts[:1]


def test_overlay_identities(spark):
    rng = random.Random(11)
    rows = [(i, [star(rng, rng.uniform(0, 4), rng.uniform(0, 4), 3, rng.randint(5, 14))]) for i in range(16)]
    f = spark.createDataFrame(rows, f"pos int, rings array<{RING}>").withColumn("g", F.lit(1))
    a, b = f.filter("pos < 8"), f.filter("pos >= 8")
    cover = O.coverage(a, b, ["g"], 2.0).first()
    ua = O.union_area(a, ["g"], 1.0).first().union_area
    uall = O.union_area(f, ["g"], 4.0).first().union_area
    assert abs(cover.layer_area - ua) < 1e-9 * ua
    assert abs(cover.covered_area + cover.outside_area - ua) < 1e-9 * ua
    assert abs(uall - (cover.layer_area + cover.site_area - cover.covered_area)) < 1e-9 * uall
    pair = f.alias("p").join(f.alias("q"), F.col("p.pos") < F.col("q.pos"))
    direct = {(r.i, r.j): r.v for r in pair.select(F.col("p.pos").alias("i"), F.col("q.pos").alias("j"), G.intersection_area(
        F.col("p.rings"), F.col("q.rings")).alias("v")).collect() if r.v > 1e-12}
    tiled = {(r.pos, r.other_pos): r.overlap_area for r in O.overlap_pairs(f, ["g"], tolerance=1e-12, tile=1.5).collect()}
    assert direct.keys() == tiled.keys() and all(abs(direct[k] - tiled[k]) < 1e-9 for k in direct)
    for r in O.against(a, b, ["g"], "pos", 1.0).collect():
        assert abs(r.inside_area + r.outside_area - r.area) < 1e-9


# ---- joins of features are dealt to the tasks --------------------------------------------------

def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Broadcast")


def some_boxes(spark, side=3):
    rows = [(i, f"f{i}", [box(2 * i, 0, 2 * i + side, side)]) for i in range(6)]
    return spark.createDataFrame(rows, f"pos int, feature_id string, rings array<{RING}>").withColumn("submission", F.lit("s"))


def test_self_crossing_edges_are_not_broadcast(spark):
    f = some_boxes(spark).withColumn("geom_type", F.lit("Polygon"))
    assert broadcasts(O.self_crossing(f, ["pos"], 4.0)) == 0
    assert broadcasts(spatial_review.validity(f, ["pos"], 4.0)) == 0


def test_overlap_pairs_are_not_broadcast(spark):
    pairs = O.overlap_pairs(some_boxes(spark), ["submission"], tile=4.0)
    assert broadcasts(pairs) == 0 and pairs.count() == 5


def test_matched_rings_are_not_broadcast(spark):
    r = some_boxes(spark).select(F.col("pos").alias("part_id"), F.col("rings")[0].alias("ring"))
    same = J.match_rings(r, r.withColumnRenamed("part_id", "zone_id"))
    assert broadcasts(same) == 0 and same.count() == 6


@pytest.mark.parametrize("side", [3, 90])
def test_overlays_are_not_broadcast(spark, side):
    f, site = some_boxes(spark, side), some_boxes(spark, 5).filter("pos = 1").select("submission", "rings")
    assert broadcasts(O.union_area(f, ["submission"], 4.0)) == 0
    assert broadcasts(O.coverage(f, site, ["submission"], 4.0)) == 0
    assert broadcasts(O.against(f, site, ["submission"], "pos", 4.0)) == 0


def test_key_area_audit_does_not_broadcast_features(spark):
    f = some_boxes(spark).withColumns({"area_id": F.lit("x"), "official_boundary": F.lit(True), "geometry_role": F.lit("official_constraint"),
                                       "official_area_sqm": F.lit(9.0)})
    audit = spatial_review.key_area_audit(f, some_boxes(spark).filter("pos = 1").select("submission", "rings"), {"x": 9.0}, 4.0)
    assert broadcasts(audit) == 0


def test_small_zones_are_filed_uncut(spark, monkeypatch):
    from terravet.operators import overlay

    def refused(*_):
        raise AssertionError("a small zone was cut")
    monkeypatch.setattr(overlay, "cover", refused)
    rng = random.Random(5)
    rows = [(i, [star(rng, rng.uniform(0, 9), rng.uniform(0, 9), 3, 9)]) for i in range(9)]
    zones = spark.createDataFrame(rows, f"zone int, rings array<{RING}>")
    points = spark.createDataFrame([(i, rng.uniform(-3, 12), rng.uniform(-3, 12)) for i in range(200)], "p int, x double, y double")
    hit = overlay.points_in_zones(points, zones, 2.0)
    assert broadcasts(hit) == 0
    want = points.crossJoin(zones).filter(G.point_in_rings(F.struct("x", "y"), F.col("rings"))).select("p", "zone")
    assert {tuple(r) for r in hit.select("p", "zone").collect()} == {tuple(r) for r in want.collect()} != set()


def test_snap_looks_at_few_of_many_near_segments(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(J, "cut_lineage", lambda df: kept.append(df.localCheckpoint()) or kept[-1])
    rng = random.Random(3)
    place = lambda: (116 + rng.uniform(0, 0.004), 39 + rng.uniform(0, 0.004))
    segs = [(i, x, y, x + rng.uniform(-2e-4, 2e-4), y + rng.uniform(-2e-4, 2e-4)) for i, (x, y) in ((i, place()) for i in range(600))]
    segs += [(600 + i, *s[1:]) for i, s in enumerate(segs[:300])]  # copies with larger ids
    vertices = [(i, *place()) for i in range(300)] + [(300, 117.0, 39.0), (301, None, 39.0)]
    v = spark.createDataFrame(vertices, "vertex_id int, lon double, lat double")
    got = {r.vertex_id: r for r in J.snap(v, spark.createDataFrame(segs, "segment_id int, x1 double, y1 double, x2 double, y2 double")).collect()}
    assert got[300].snap_lon is None and got[301].snap_lon is None and len(got) == 302
    for k, x, y in vertices[:300]:
        def foot(s):
            dx, dy = s[3] - s[1], s[4] - s[2]
            t = max(0.0, min(1.0, ((x - s[1]) * dx + (y - s[2]) * dy) / (dx * dx + dy * dy)))
            return math.hypot(x - s[1] - t * dx, y - s[2] - t * dy), s[1] + t * dx, s[2] + t * dy
        _, px, py = min(map(foot, segs))
        assert abs(got[k].snap_lon - px) < 1e-12 and abs(got[k].snap_lat - py) < 1e-12
    crowds = [r[0] for r in kept[-1].groupBy("cx", "cy").count().select("count").collect()]
    assert sum(n * n for n in crowds) / sum(crowds) <= J.CROWD < 200


def test_gate_joins_once_for_all_issue_tables(spark):
    from terravet.plans import reviews
    stages = spark.createDataFrame([("a", "formal"), ("b", "formal"), ("b", "formal"), (None, "draft")], "submission string, stage string")
    issues = spark.createDataFrame([("a", "minor"), ("b", "major"), (None, "error"), ("z", "error")], "submission string, severity string")
    none = issues.filter("false")
    got = reviews.self_check(issues, none, issues.filter("severity = 'minor'"), none, stages)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert sorted((r.submission or "", r.validation, r.spatial, r.visual, r.stage) for r in got.collect()) == [
        ("", True, True, True, "unknown"), ("a", True, True, True, "formal"), ("b", False, True, True, "formal"), ("b", False, True, True, "formal")]


def test_token_texts_are_dealt_by_input_splits(spark, tmp_path):
    import __spark_entry__ as contract
    rows = [(k, n, k % 5, "ab"[n % 2]) for k in range(50) for n in range(4)] + [(None, 1, 2, "a")]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = contract.queries()["token_table_scan"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    assert sorted((r.doc is None, r.doc, r.y, r.x, r.text, r.n) for r in got.filter("doc IS NOT NULL").collect()) == sorted(
        (False, k, n, s, f + "z", 1) for k, n, s, f in rows[:-1]) and got.count() == 201


# ---- a text is cut once --------------------------------------------------------------------

SPLIT = "##(?="


def splits(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count(SPLIT)


def test_translation_is_cut_into_sections_once(spark):
    md = ("---\nlanguage: en\nchinese_translation: included\n---\nbody\n" + P.TRANSLATION_HEADING + "\n## part\nshort\n")
    docs = spark.createDataFrame([(1, md), (2, None), (3, "---\nlanguage: zh\n---\nx")], "k int, t string")
    got = D.check_front_matter(docs, "k", "t", ["part", "other"], 300, 100, 200)
    assert splits(got) == 1
    found = {(r.k, r.check_id, r.detail) for r in got.collect()}
    assert {(1, "TRANSLATION_SECTION_MISSING", "other"), (1, "TRANSLATION_SECTION_THIN", "part"), (1, "ENGLISH_TOO_SHORT", "characters")} <= found
    assert not any(k != 1 and c.startswith(("TRANSLATION", "ENGLISH")) for k, c, _ in found)


def test_advisory_score_keeps_its_sections(spark):
    from terravet.plans import reviews
    docs = spark.createDataFrame([("a", "## x\ny\n")], "submission string, text string")
    src = spark.createDataFrame([("s", "", "", "")], "id string, citation string, path string, url string")
    got = reviews.advisory_score(docs, src)
    assert splits(got) == 0 and got.count() == len(P.SCORE_DIMENSIONS)


def test_strip_and_compact_length_know_all_white_space(one):
    space = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    assert sorted(X.WS_CHARS) == sorted(space)
    assert one(X.strip(F.lit(space + "a \u2003 b" + space))) == "a \u2003 b" and one(X.strip(F.lit(space))) == ""
    assert one(X.compact_len(F.lit(space + "a b" + space))) == 2


def lines(spark, **kw):
    rows = [("r", k, [box(*v)]) for k, v in kw.items()]
    return spark.createDataFrame(rows, f"region string, line string, rings array<{RING}>")


FAR = dict(farmland=(100, 100, 110, 110), redline=(200, 200, 210, 210), boundary=(-50, -50, 50, 50))


@pytest.mark.parametrize("change,want", [
    ({}, "ALLOWED"), ({"redline": (5, 5, 15, 15), "boundary": (-5, -5, 5, 5)}, "REJECTED_ECOLOGICAL_REDLINE"),
    ({"farmland": (10, 0, 20, 10), "boundary": (-5, -5, 10, 50)}, "ALLOWED"), ({"farmland": None}, "FAIL_CLOSED"),
    ({"boundary": (-5, -5, 8, 20)}, "REJECTED_OUTSIDE_BOUNDARY"), ({"farmland": (5, 5, 60, 60)}, "FAIL_CLOSED")])
def test_three_lines(spark, change, want):
    spec = {k: v for k, v in {**FAR, **change}.items() if v}
    parcel = spark.createDataFrame([("r", 1, [box(0, 0, 10, 10)]), ("r", 2, None)], f"region string, parcel_id int, rings array<{RING}>")
    got = {r.parcel_id: r for r in landuse.three_lines(parcel, lines(spark, **spec), tile=16.0).collect()}
    assert got[1].verdict == want and got[2].verdict == "FAIL_CLOSED"
    assert (got[1].evidence[-1].outcome == "violation") == (want != "ALLOWED")


@pytest.mark.parametrize("split,want", [((6, 10), "ECOLOGICAL"), ((4, 10), "URBAN"), ((5, 10), "FAIL_CLOSED")])
def test_three_zones(spark, split, want):
    cut, end = split
    rows = [("r", "ecological", [box(0, 0, cut, 10)]), ("r", "urban", [box(cut, 0, end, 10)]), ("r", "agricultural", [box(90, 90, 99, 99)])]
    z = spark.createDataFrame(rows, f"region string, zone string, rings array<{RING}>")
    parcel = spark.createDataFrame([("r", 1, [box(0, 0, 10, 10)])], f"region string, parcel_id int, rings array<{RING}>")
    assert landuse.three_zones(parcel, z, tile=16.0).first().verdict == want


def test_convex_hull(one):
    pts = F.array(*[G.pt(F.lit(float(x)), F.lit(float(y))) for x, y in [(0, 0), (2, 1), (4, 0), (4, 4), (2, 2), (0, 4), (2, 0), (2, 4)]])
    ring = [(p["x"], p["y"]) for p in one(G.convex_hull(pts))]
    assert ring == [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]


def test_shift_is_idempotent(spark):
    f = spark.createDataFrame([("z", [[box(0, 0, .01, .01)]], None)], f"feature_id string, polys array<array<{RING}>>, anchor_corrected boolean")
    s = spark.createDataFrame([("z", .5, 0.0)], "feature_id string, dlon double, dlat double")
    once = boundaries.translate(f, s).drop("area_before", "area_after")
    again = boundaries.translate(once, s).drop("area_before", "area_after")
    back = boundaries.translate(again, s, revert=True)
    assert once.first().polys == again.first().polys and again.first().polys[0][0][0].x == .5
    assert abs(back.first().polys[0][0][0].x) < 1e-12


# ---- indicators and history ------------------------------------------------------------------------------

def test_token_table_rows(one):
    text = "10\t5\tHD00-0403-0043\n12\t60\t2000. 5\n11\t80\t1.8\n9\t95\t35\n30\t99\t7000\n200\t1\t总计"
    rows = [r for r in one(I.plot_rows_tokens(F.lit(text))) if r["vals"]]
    assert len(rows) == 1 and rows[0]["code"] == "HD00-0403-0043" and rows[0]["vals"]["land"] == "2000.5" and rows[0]["vals"]["floor"] == "7000"


def test_bands_anchor_on_the_first_row(spark):
    t = spark.createDataFrame([(1, y, 0) for y in (0, 20, 40, 45, 60, 200)], "page int, y int, x int")
    assert sorted((r.y, r.band) for r in S.bands(t, ["page"]).collect()) == [(0, 0), (20, 0), (40, 40), (45, 40), (60, 40), (200, 200)]


def test_weighted_score_first_wins(spark):
    rows = [(1, i, d, 5) for i, d in enumerate(P.RUBRIC_WEIGHTS)] + [(1, 90, "originality", 0), (1, 91, "odd", 5)]
    r = A.weighted_score(spark.createDataFrame(rows, "submission int, pos int, dimension string, score int"), P.RUBRIC_WEIGHTS).first()
    assert r.weighted_score == 100.0 and r.duplicate_rows == 1 and r.unknown_rows == 1 and r.missing == ""


# ---- rules -------------------------------------------------------------------------------------------------

def test_every_checker_runs(spark):
    ring = f"array<{RING}>"
    feature = "submission string, layer_file string, pos int, feature_id string, layer string, geom_type string, rings " + ring
    rows = [("s", "site_boundary.geojson", 0, "a", "SITE_BOUNDARY", "Polygon", [box(0, 0, 10, 10)]), ("s", "land_use.geojson", 0, "b", "LAND_USE", "Polygon", [box(0, 0, 10, 8)]),
            ("s", "roads.geojson", 0, "c", "ROAD_CENTERLINE", "LineString", [[{"x": 1.0, "y": 1.0}, {"x": 2.0, "y": 30.0}]]), ("s", "green_space.geojson", 0, "d", "GREEN_SPACE", "Polygon", [box(0, 0, 5, 5)]),
            ("s", "buildings.geojson", 0, "e", "BUILDING_FOOTPRINT", "Polygon", [box(1, 1, 2, 2)])]
    f = spark.createDataFrame(rows, feature)
    for c in ("geometry_role", "boundary_precision", "land_use_code", "building_type", "road_class", "height_m", "building_height_m", "height"):
        f = f.withColumn(c, F.lit(None).cast("string"))
    f = f.withColumn("official_boundary", F.lit(True))
    df = spark.createDataFrame
    tables = {"submissions": df([("s",)], "submission string"), "features": f, "metrics": df([("s", "far", 2.0)], "submission string, metric string, value double"),
              "files": df([("s", "geometry/land_use.geojson")], "submission string, path string"), "docs": df([("s", "proposal.md", "概念建议 禁语"), ("s", "metrics.json", "EPSG:4548")], "submission string, file string, text string"),
              "assumptions": df([("s", "FAR is missing")], "submission string, entry string"), "sources": df([("s", "P", "used as official_boundary")], "submission string, source_id string, row_text string"),
              "matrix": df([("s", "agent.1", 0)], "submission string, requirement_id string, evidence_count int")}
    params = {"verify_required_layers": '{"required_layers":["LAND_USE","PHASE"]}', "verify_features_within_boundary": '{"generated_layers":["ROAD_CENTERLINE"]}',
              "verify_area_tolerance": '{"metric_key":"far","declared_area_sqm":2.0}', "verify_task_coverage": '{"requirement_id":"agent.1"}', "grep_forbidden_patterns": '{"forbidden_patterns":["别的、禁语"]}',
              "verify_required_wording": '{"required_phrases":["概念建议","参考方案"]}', "verify_missing_controls_documented": '{"missing_controls":["far","height"]}',
              "verify_source_authority": '{"provisional_source_ids":["P"],"formal_required_fields":["official_boundary"]}', "verify_sanity_bounds": '{"metric_key":"far","min_val":0,"max_val":1}',
              "verify_enum_values": '{"enum_name":"x","valid_codes":["1"],"target_geojson_field":"land_use_code"}', "verify_locked_layers": '{"locked_layers":["GREEN_SPACE"]}', "verify_layer_names": '{"valid_layers":["LAND_USE"]}'}
    rule = df([(n, n, "CODE", n, params.get(n, "{}"), "high", "c", True) for n in rules.CHECKERS], rules.RULE_SCHEMA)
    got = {r.constraint_id: r.outcome for r in rules.evaluate(rule, tables).collect()}
    want_fail = {"verify_required_layers", "verify_features_within_boundary", "verify_land_use_coverage", "verify_task_coverage", "grep_forbidden_patterns", "verify_required_wording",
                 "verify_missing_controls_documented", "verify_source_authority", "verify_sanity_bounds", "verify_locked_layers", "verify_layer_names", "check_land_use_classification",
                 "check_three_lines_awareness", "check_building_height", "check_road_network"}
    assert len(got) == 22 and {k for k, v in got.items() if v == "FAIL"} == want_fail, got
    assert "ERROR" not in got.values()


def test_key_area_messages(spark):
    rows = [("s", 0, "k1", "x", True, "official_constraint", 100.0, [box(0, 0, 10, 10)]), ("s", 1, "k2", "y", False, "provisional_constraint", 1.0, [box(5, 5, 15, 15)]), ("s", 2, "k3", "z", None, "design", None, [box(95, 0, 105, 10)])]
    f = spark.createDataFrame(rows, f"submission string, pos int, feature_id string, area_id string, official_boundary boolean, geometry_role string, official_area_sqm double, rings array<{RING}>")
    site = spark.createDataFrame([("s", [box(0, 0, 100, 100)])], f"submission string, rings array<{RING}>")
    got = {(r.check_id, r.feature_id) for r in spatial_review.key_area_audit(f, site, {"x": 100.0, "q": 1.0}, 16.0).collect()}
    assert got == {("KEY_AREA_OVERLAP", "k1"), ("KEY_AREA_PROVISIONAL", "k2"), ("KEY_AREA_NOT_OFFICIAL", "k3"), ("KEY_AREA_OUTSIDE_SITE", "k3"), ("KEY_AREA_MISSING", None)}


def test_registry_messages(spark):
    cols = "pos int, source_id string, review_status string, usable_for_formal string, public_access_status string, authority_level string, url string, license_summary string"
    df = spark.createDataFrame([(1, "A", "approved", "no", "restricted_or_unknown", "A0", "https://x", "long text"), (2, "A", "provisional", "yes", "public_url", "A0", "ftp://x", "no")], cols)
    got = {(r.pos, r.check_id) for r in K.check_registry_cross(df, ["pos"]).collect()}
    assert got == {(1, "RESTRICTED_APPROVED"), (2, "FORMAL_NOT_APPROVED"), (2, "PROVISIONAL_FORMAL"), (2, "PUBLIC_URL_NOT_HTTP"), (2, "LICENSE_TOO_SHORT")}


def test_line_over_a_notch_leaves_the_site(spark):
    from pyspark.sql import functions as F
    from terravet.plans.spatial_review import not_contained
    ring = lambda *ps: [[{"x": float(x), "y": float(y)} for x, y in ps]]
    kind = "array<array<struct<x:double,y:double>>>"
    site = spark.createDataFrame([("s", ring((0, 0), (30, 0), (30, 20), (20, 20), (20, 5), (10, 5), (10, 20), (0, 20), (0, 0)))],
                                 f"submission string, rings {kind}")
    rows = [("over", "LineString", ring((5, 15), (25, 15))), ("around", "LineString", ring((5, 15), (5, 2), (25, 2), (25, 15))),
            ("edge", "LineString", ring((1, 1), (29, 1))), ("out", "LineString", ring((5, 15), (5, 25))), ("dot", "LineString", ring((15, 10), (15, 10))),
            ("point", "Point", ring((15, 10))), ("inside", "Point", ring((15, 2)))]
    f = spark.createDataFrame([("s", *r) for r in rows], f"submission string, feature_id string, geom_type string, rings {kind}")
    for tile in (4.0, 64.0):
        assert {r.feature_id for r in not_contained(f, site, tile=tile).collect()} == {"over", "out", "dot", "point"}
    assert not_contained(f.filter(F.lit(False)), site).count() == 0


def test_rings_that_touch_or_overlap_are_invalid(spark):
    from terravet.plans.spatial_review import validity
    ring = lambda *ps: [{"x": float(x), "y": float(y)} for x, y in ps]
    square = ring((0, 0), (8, 0), (8, 8), (0, 8), (0, 0))
    rows = [("fine", [square]), ("repeat", [ring((0, 0), (8, 0), (8, 0), (8, 8), (0, 8), (0, 0))]),
            ("touch", [ring((0, 0), (4, 4), (8, 0), (8, 8), (4, 4), (0, 8), (0, 0))]), ("spike", [ring((0, 0), (8, 0), (12, 0), (8, 0), (8, 8), (0, 0))]),
            ("hole", [square, ring((2, 2), (4, 2), (4, 4), (2, 2))]), ("point", [square, ring((0, 4), (4, 2), (4, 6), (0, 4))]),
            ("outside", [square, ring((9, 9), (11, 9), (11, 11), (9, 9))]), ("twice", [square, square])]
    df = spark.createDataFrame([(k, "Polygon", r) for k, r in rows], "id string, geom_type string, rings array<array<struct<x:double,y:double>>>")
    for cell in (1.0, 4.0, 100.0):
        found = {(r.id, r.reason) for r in validity(df, ["id"], cell).collect()} - {("twice", "ZERO_AREA")}
        assert found == {("touch", "SELF_CROSSING"), ("spike", "SELF_CROSSING"), ("outside", "HOLE_OUTSIDE"), ("twice", "SELF_CROSSING")}


def test_ids_take_the_first_free_form(spark):
    from terravet.plans.discovery import suffix_ids
    def plain(ids):
        used, out = set(), []
        for i in ids:
            made, n = i, 2
            while made in used:
                made, n = f"{i}-{n}", n + 1
            used.add(made)
            out.append(made)
        return out
    import random
    rng = random.Random(1)
    for ids in (["X", "X", "X-2", "X-2-x"], ["X-2", "X", "X", "X"], ["a", "a", "b"],
                [rng.choice(["X", "X-2", "X-3", "X-2-2", "Y", "Y-5", "Z"]) for _ in range(300)]):
        rows = spark.createDataFrame(list(enumerate(ids)), "seq bigint, source_id string")
        got = [r.source_id for r in suffix_ids(rows, block=50).orderBy("seq").collect()]
        assert got == plain(ids) and len(set(got)) == len(got)


def test_whole_texts_are_read(one):
    from pyspark.sql import functions as F
    from terravet.functions import indicators as I, web as W
    page = "<html><head><title>t</title></head><body>" + "<p>filler words here</p>" * 6_000 + "<p>lastword</p></body></html>"
    assert one(W.page_metadata(F.lit(page)))["text"].endswith("lastword")
    long = "x " * 50_000
    assert one(W.topic_hits(F.lit("t"), F.lit(long + "lastword"), F.lit("u"), ["lastword"])) == ["lastword"]
    text = "密度 HD00-0403-0043\n" + "\n" * 40 + "2000.5 2.1 30 24 7000 35"
    assert one(I.plot_rows_plain(F.lit(text)))[0]["vals"]["land"] == "2000.5"


def test_throwing_checkers_take_no_outcome_of_others(spark):
    from pyspark.sql import functions as F
    subs = spark.createDataFrame([(f"s{i}", "xs" if i == 5 else str(i)) for i in range(40)], "submission string, text string")

    def checker(fault):
        def run(tables, rule):
            rows = tables["submissions"].join(F.broadcast(rule.select("constraint_id")))
            return rows.select("submission", "constraint_id", F.when(fault().isNotNull(), "PASS").otherwise("FAIL").alias("outcome"),
                               F.lit("").alias("detail"), F.lit("").alias("evidence"))
        return run

    def refuses(tables, rule):
        raise ValueError("not today")

    @F.udf("int")
    def odd(x):
        if x == "b2":
            raise TypeError("odd one")
        return 1
    checkers = {"cast": checker(lambda: F.col("text").cast("int")), "zero": checker(lambda: F.lit(1) / (F.length("constraint_id") - 2)),
                "refuses": refuses, "python": checker(lambda: odd("constraint_id")), "fine": checker(lambda: F.lit(1))}
    names = [("c1", "cast"), ("c2", "cast"), ("z1", "zero"), ("r1", "refuses"), ("r2", "refuses"), ("b1", "python"), ("b2", "python"), ("f1", "fine"), ("n1", "none")]
    rule = spark.createDataFrame([(i, i, "CODE", f, "{}", "high", "c", True) for i, f in names], rules.RULE_SCHEMA)
    rows = rules.evaluate(rule, {"submissions": subs}, checkers).collect()
    got = {(r.submission, r.constraint_id): r.outcome for r in rows}
    assert len(rows) == len(got) == 40 * len(names)
    error = {k for k, v in got.items() if v == "ERROR"}
    assert error == {(f"s{i}", c) for i in range(40) for c in ("z1", "r1", "r2", "b2")} | {("s5", "c1"), ("s5", "c2")}
    assert {v for k, v in got.items() if k not in error and k[1] != "n1"} == {"PASS"}
    details = {r.constraint_id: r.detail for r in rows if r.outcome == "ERROR"}
    assert details["r1"] == "Checker error: ValueError: not today" and "CAST_INVALID_INPUT" in details["c1"] and "DIVIDE_BY_ZERO" in details["z1"]


def _star(cx, cy, outer, inner, points, turn=0.0):
    import math
    ring = []
    for k in range(2 * points):
        r, a = (outer if k % 2 == 0 else inner), turn + math.pi * k / points
        ring.append({"x": cx + r * math.cos(a), "y": cy + r * math.sin(a)})
    return ring + ring[:1]


def test_cells_follow_the_border(spark):
    from terravet.operators import overlay
    site = spark.createDataFrame([("s", [box(0.5, 0.5, 600.5, 600.5)])], f"g string, rings array<{RING}>")
    cells = overlay.cover(site, 1.0, 4).collect()
    assert len(cells) < 10_000 and sum(not c.whole for c in cells) == 2400
    assert sum((4.0 ** c.lev) ** 2 for c in cells if c.whole) == 599.0 ** 2 and all(c.lev == 0 for c in cells if not c.whole)


def test_overlay_of_large_and_small_features(spark):
    """The hierarchy, flat tiles and closed forms agree, holes, copies and nested sites included."""
    from terravet.functions import geo
    from terravet.operators import overlay
    from pyspark.sql import functions as F
    kind = f"g string, k int, rings array<{RING}>"
    holed = [box(0, 0, 200, 200), box(50, 50, 150, 150)]
    layers = [("s", 0, holed), ("s", 1, holed), ("s", 2, [_star(120, 90, 90, 30, 7)]), ("s", 3, [_star(40.3, 160.7, 35, 20, 5, 0.4)]),
              ("t", 4, [box(-70.5, -70.5, 64, 64)]), ("t", 5, [box(10, 10, 12, 12)])]
    small = [("s", 100 + i, [_star(7.7 * i, 150 - 4.3 * i, 2.0, 1.0, 4, 0.1 * i)]) for i in range(40)]
    other, features = spark.createDataFrame(layers, kind), spark.createDataFrame(small + layers[2:], kind)

    def rounded(df, *keys):
        return sorted((tuple(r[k] for k in keys), *(round(r[c], 6) for c in df.columns if c not in keys)) for r in df.collect())
    found = {}
    for flat in (16, 10 ** 9):
        overlay.FLAT, before = flat, overlay.FLAT
        try:
            united = overlay.union_area(other, ["g"], 2.0)
            cover = overlay.coverage(features, other, ["g"], 2.0)
            inside = overlay.against(features, other, ["g"], "k", 2.0)
            found[flat] = rounded(united, "g"), rounded(cover, "g"), rounded(inside, "g", "k")
        finally:
            overlay.FLAT = before
    assert found[16] == found[10 ** 9]
    area = {r.k: r.a for r in features.select("k", geo.even_odd_area(F.col("rings")).alias("a")).collect()}
    assert all(abs(row[1] - area[row[0][1]]) < 1e-6 for row in found[16][2])
    assert dict((r[0][0], r[1]) for r in found[16][0])["t"] == round(134.5 ** 2, 6)


def test_points_meet_whole_cells(spark):
    from terravet.operators import overlay
    zones = spark.createDataFrame([(1, [box(0, 0, 300, 300), box(100, 100, 200, 200)]), (2, [box(250, 250, 252, 252)])], f"zone int, rings array<{RING}>")
    points = spark.createDataFrame([(i, 3.7 * i + 0.1, 2.9 * i + 0.1) for i in range(100)], "p int, x double, y double")
    got = {(r.p, r.zone) for r in overlay.points_in_zones(points, zones, 2.0).collect()}
    inside = lambda x, y, b: b[0] <= x < b[2] and b[1] <= y < b[3]
    want = {(r.p, 1) for r in points.collect() if inside(r.x, r.y, (0, 0, 300, 300)) and not inside(r.x, r.y, (100, 100, 200, 200))}
    want |= {(r.p, 2) for r in points.collect() if inside(r.x, r.y, (250, 250, 252, 252))}
    assert got == want and want


def test_exact_quantiles_equal_percentile(spark):
    from pyspark.sql import functions as F
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 1.0, rng.uniform(-1e9, 1e9), rng.gauss(0, 1e-9)])) for _ in range(900)] + [("c", 5.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        want = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("v", q).alias("p")).collect() if r.p is not None}
        got = {r.g: r.p for r in A.exact_quantile(df, ["g"], "v", q, "p").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-9 * max(1, abs(want[k])) for k in want)
    whole = A.exact_quantile(df, [], "v", 0.5, "p").collect()
    assert [round(r.p, 6) for r in whole] == [round(df.agg(F.percentile("v", 0.5)).first()[0], 6)]
    assert A.exact_quantile(df.limit(0), ["g"], "v", 0.5, "p").count() == 0
