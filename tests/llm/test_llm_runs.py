"""Runs of words against a plain search over all stretches and periods."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from terravet.llm import runs


def plain_runs(words):
    """Every stretch that keeps a period q and cannot be extended, with its smallest period."""
    n, best = len(words), {}
    for q in range(1, n // runs.LEAST_TURNS + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(runs.LEAST_WORDS, runs.LEAST_TURNS * q):
                best[(i, length)] = min(best.get((i, length), q), q)
            i = j
    return sorted((i, length, q) for (i, length), q in best.items())


def plain_row(text):
    words = re.findall(runs.WORD, text or "")
    found = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    drop = {k for a, b, q in found for k in range(a + q, a + b)}
    top = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
    return (len(found), *top, 1000 * top[1] // top[2] if found else None,
            hashlib.sha256("".join(f"{a},{b},{q}\n" for a, b, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in drop).encode()).hexdigest())


FIELDS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def made_rows(texts):
    made = runs.work(texts)
    return list(zip(*(made[f].to_pylist() for f in FIELDS)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60).map(" ".join), max_size=6))
def test_small_alphabets(texts):
    assert made_rows(texts) == [plain_row(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), min_size=1, max_size=5), st.integers(1, 9)), max_size=12))
def test_built_from_powers(blocks):
    text = "\n".join("\t ".join(part * times) for part, times in blocks)
    assert made_rows([text, "", text]) == [plain_row(text), plain_row(""), plain_row(text)]


def test_one_word_for_very_long():
    text = "a " * 30_000
    (row,) = made_rows([text])
    assert row[:5] == (1, 0, 30_000, 1, 30_000_000)


def test_long_period_beside_natural_words():
    rng = random.Random(3)
    head = [f"w{rng.randint(0, 5000)}" for _ in range(3000)]
    tail = [f"v{rng.randint(0, 400)}" for _ in range(700)]
    text = " ".join(head + tail * 5 + tail[:123])
    (row,) = made_rows([text])
    assert row[0] >= 1 and (row[2], row[3]) == (700 * 5 + 123, 700)


def plain_edit(doc_id, text):
    h = zlib.crc32(str(doc_id).encode())
    words = re.findall(runs.WORD, text or "")
    n, g = len(words), h // 10
    if h % 10 or not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))


def test_query_equals_plain_search(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = runs.op11_periodic_runs(spark, folder).collect()
    assert len(out) == len(texts) and sum(r.n_runs > 0 for r in out) >= 10
    short = [r for r in out if len(texts[r.doc_id]) < 12_000]
    assert len(short) > 150
    for r in short:
        assert tuple(r[f] for f in FIELDS) == plain_row(plain_edit(r.doc_id, texts[r.doc_id]))


def test_odd_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "  \n\t ", 7), (None, "a b " * 10, 7), (3, "x", 7), (3, "x", 7), (4, "é\x1cx " * 8, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_runs int")
    out = runs.periodic_runs(docs).collect()
    assert sorted((r.doc_id or 0, r.n_runs) for r in out) == [(0, 1), (1, 0), (2, 0), (3, 0), (3, 0), (3, 0), (4, 1)]
    assert {(r.start, r.runs_sha256, r.collapsed) for r in out if r.doc_id in (1, 2)} == {(None, hashlib.sha256(b"").hexdigest(), "")}
    assert [r.collapsed for r in out if r.doc_id is None] == ["a b"]
    assert [[(x.start, x.length, x.period) for x in r.runs] for r in out if r.doc_id == 4] == [[(0, 8, 1)]]
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    edited = docs.select("doc_id", runs.planted(docs.doc_id, docs.text).alias("t")).collect()
    assert [r.t for r in edited if r.doc_id is None] == ["a b " * 10]


@pytest.mark.parametrize("pairs", [[(0, 5, 9)], []])
def test_pairs_need_different_left_words(pairs):
    lefts = [-1, 3] if pairs else [3, 3]
    assert runs.maximal_pairs([0, 5], lefts, [9]) == ([] if 5 > 9 // 3 else pairs)
    assert runs.maximal_pairs([0, 3], lefts, [9]) == ([(0, 3, 9)] if pairs else [])
