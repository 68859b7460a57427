import random
import re

import pytest

from terravet.llm import near_dup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width):
    w = WORD.findall(low(text))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def brute(docs, width, percent):
    """Components by comparing all pairs."""
    sets = [(d, shingles(t, width)) for d, t in docs if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in parent}


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


def corpus():
    """Unrelated texts, exact copies, small groups, and one large group whose copies vary in likeness."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(60)]
    texts += [texts[3]] * 4 + [texts[5].upper()]
    base = rng.choices(vocabulary, k=150)
    texts += [edited(base, rng.randint(0, 14), rng) for _ in range(150)]
    for k in range(12):
        small = rng.choices(vocabulary, k=80)
        texts += [edited(small, rng.randint(0, 3), rng) for _ in range(4)]
    texts += ["", None, " \n ", "one", "one two", "One  Two", "one two three", None]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_components_equal_all_pairs(spark, width, percent):
    docs = corpus()
    want = brute(docs, width, percent)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    out = near_dup.near_duplicates(df, width, percent).collect()
    assert len(out) == len(docs)
    text = dict(docs)
    for r in out:
        assert r.n_shingles == len(shingles(text[r.doc_id], width))
        assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_match_threshold_bounds_the_miss():
    from math import comb
    for percent in (80, 85):
        t = near_dup.match_threshold(32, percent)
        p = percent / 100
        assert sum(comb(32, i) * p ** i * (1 - p) ** (32 - i) for i in range(t)) <= near_dup.MISS


def test_odd_rows(spark):
    a = "one two three four five six seven"
    rows = [(5, a, 1), (5, a, 1), (None, a, 2), (None, None, 3), (7, a, 4), (8, "other words are in this text here", 5),
            (8, a, 6), (9, "", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept int")
    out = near_dup.near_duplicates(df).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in out} == {
        (5, 5, True), (None, None, True), (7, 5, False), (8, 5, False), (8, 8, True), (9, 9, True)}
    left = near_dup.without_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, 5), (False, 8), (False, 9), (True, 0), (True, 0)]
    assert [r.text[:5] for r in left.filter("doc_id = 8").collect()] == ["other"]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0
    assert near_dup.without_near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.label for r in near_dup.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
