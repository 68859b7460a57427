"""Archives read back, revisits and the merged index against plain sorting."""

import hashlib
import random
from datetime import datetime

import pytest
from hypothesis import given, strategies as st

from terravet.llm import warc

TRAP = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 20
SCHEMA = "page_id bigint, url string, html string, payload_bytes int, run bigint"


@given(st.lists(st.lists(st.integers(0, 30)), max_size=9))
def test_loser_tree_merges(streams):
    held = [sorted(s) for s in streams]
    merged = list(warc.LoserTree([iter([(k, (k, n)) for k in s]) for n, s in enumerate(held)]))
    assert merged == sorted((k, n) for n, s in enumerate(held) for k in s)


@pytest.mark.parametrize("url, key", [
    (None, ""), ("", ""), ("http://a.B.example.com/x?q=1#top", "com,example,b,a)/x?q=1"), ("https://u:p@example.org:443", "org,example)/"),
    ("example.org:8080?a", "org,example:8080)/?a"), ("no url at all", "no url at all)/")])
def test_url_keys(url, key):
    assert warc.url_key(url) == key


def plain_types(rows):
    """(page_id, digest, type, refers_to) of distinct page ids."""
    top = {}
    for page_id, _, html, *_ in rows:
        top[html or ""] = max(top.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html, *_ in rows:
        body = (html or "").encode()
        small = len(body) < warc.LEAST_REVISIT or top[html or ""] == page_id
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "response" if small else "revisit",
                    None if small else top[html or ""]))
    return sorted(out, key=str)


def test_round_trip_and_order(spark, tmp_path):
    rng = random.Random(8)
    bodies = [TRAP, "é" * 499, "é" * 500, "x" * 999, "x" * 1000, "", None, "long " * 400_000]
    rows = [(k, rng.choice(["http://one.example/", "http://b.example/p?x", "http://c.example/%d" % k, None]), rng.choice(bodies[:-1]), 1, 2)
            for k in range(300)] + [(900, "http://b.example/long", bodies[-1], 1, 2)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(5)
    folder = warc.write_archives(pages, path=f"{tmp_path}/w")
    runs = warc.capture_runs(spark, folder)
    assert runs.select("run").distinct().count() > 1 and runs.filter("not intact").count() == 0
    out = warc.merged_index(runs, captures=40).orderBy("position").collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out]
    assert sorted(got, key=str) == plain_types(rows)
    assert [r.position for r in out] == list(range(len(rows)))
    places = [(r.url_key.encode(), r.date, r.record_id) for r in out]
    assert places == sorted(places)
    seen = {}
    for r in out:
        seen[r.url_key] = seen.get(r.url_key, 0) + 1
        assert r.capture_no == seen[r.url_key]
    urls = {k: u for k, u, *_ in rows}
    assert all(r.url == urls[r.page_id] for r in out)
    ids = {r.record_id: r.page_id for r in out}
    assert all(ids[r.refers_to_id] == r.refers_to for r in out if r.record_type == "revisit")


def test_rows_alike_and_odd_rows(spark):
    body = "word " * 300
    rows = [(7, "http://a.example/", body, 1, 1)] * 5 + [(7, "http://b.example/", body, 1, 1), (None, "http://z.example/", body, 1, 1),
            (3, None, body, 1, 1), (None, None, None, 1, 1), (None, None, None, 1, 1), (4, "http://a.example/\r\nX: y", "", 1, 1)]
    out = warc.merged_index(warc.capture_runs(spark, warc.write_archives(spark.createDataFrame(rows, SCHEMA)))).collect()
    assert len(out) == len(rows) and sorted(r.position for r in out) == list(range(len(rows)))
    (response,) = [r for r in out if r.payload_bytes == 1500 and r.record_type == "response"]
    assert (response.page_id, response.url) == (7, "http://b.example/")
    rest = [r for r in out if r.payload_bytes == 1500 and r.record_type == "revisit"]
    assert len(rest) == 7 and {r.refers_to_id for r in rest} == {response.record_id} and {r.refers_to for r in rest} == {7}
    assert [r.url for r in out if r.page_id == 4] == ["http://a.example/%0D%0AX: y"]
    alike = spark.createDataFrame(rows[:5] + rows[6:8], SCHEMA)
    out = warc.merged_index(warc.capture_runs(spark, warc.write_archives(alike))).collect()
    assert sorted(r.record_type for r in out if r.page_id == 7) == ["response"] + ["revisit"] * 4
    assert len(out) == 7 and len({r.record_id for r in out}) == 7
    none = warc.merged_index(warc.capture_runs(spark, warc.write_archives(alike.limit(0))))
    assert none.count() == 0


def test_dates_of_the_table(spark):
    rows = [(1, "http://a.example/", "x", datetime(2020, 5, 1, 3)), (2, "http://a.example/", "y", datetime(2019, 5, 1, 3)),
            (3, "http://a.example/", "z", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, at timestamp")
    out = warc.merged_index(warc.capture_runs(spark, warc.write_archives(pages, date="at"))).orderBy("capture_no").collect()
    assert [(r.page_id, r.date) for r in out] == [(3, ""), (2, "2019-05-01T03:00:00Z"), (1, "2020-05-01T03:00:00Z")]


def test_broken_archives_are_refused():
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    with pytest.raises(ValueError):
        list(warc.parse(b"no archive"))
