"""Source divergence against plain whole-number arithmetic over all terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from terravet.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n bigint, id bigint"


def plain(rows, least=3):
    """(lang, source, part, item, value, rank) by the definition."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        found = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in found]
        counts[(lang or "", source or "")].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for (lang, source), own in counts.items():
        kept = [t for t, k in docs[lang].items() if k >= least]

        def shares(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        def price(p, q):
            return (p - q) * (p - q) // q
        p = shares(own)
        others = [(s, shares(c)) for (at, s), c in counts.items() if at == lang and s != source]
        found = {"pair": [(sum(price(p[t], q[t]) for t in kept), s) for s, q in others]}
        q = shares(sum((c for (at, _), c in counts.items() if at == lang), Counter()))
        found["term"] = [(price(p[t], q[t]), t) for t in kept if own[t] and p[t] > q[t]]
        for part, items in found.items():
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, v, k + 1) for k, (v, item) in enumerate(items) if part == "pair" or k < 200]
    return sorted(out)


def made(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


def random_rows(seed, docs, words, sources):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice(['Ab', 'zé', 'Éa', '中'])}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(words)]
    return [(k, " ".join(rng.choices(vocabulary, [1 / (1 + i) for i in range(words)], k=rng.randint(0, 60))).replace(" ", rng.choice(" 1-_@")),
             rng.choice(["en", "de", None]), f"s{int(rng.random() ** 3 * sources)}", "x", 1, 2) for k in range(docs)]


def test_small_blocks_and_tiles(spark):
    rows = random_rows(1, 400, 150, 9)
    want = plain(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert made(divergence.audit(docs, block=16, tile=2)) == want
    assert made(divergence.audit(docs)) == want


def test_more_terms_than_ranks(spark):
    rows = random_rows(2, 300, 900, 2)
    want = plain(rows, 1)
    assert any(r[5] == 200 and r[2] == "term" for r in want)
    assert made(divergence.audit(spark.createDataFrame(rows, SCHEMA), least=1)) == want


def test_odd_rows(spark):
    rows = [(1, None, "en", "a", "t", 1, 1), (None, "", "en", "b", "t", 1, 1), (2, "x y", None, None, "t", 1, 1),
            (3, "word Word WORD é É " * 3000, "fr", "a", "t", 1, 1), (3, "word", "fr", "a", "t", 1, 1), (3, "word", "fr", "a", "t", 1, 1),
            (4, "1 2 3", "fr", "c", "t", 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = made(divergence.audit(docs))
    assert out == plain(rows)
    assert ("en", "a", "pair", "b", 0, 1) in out and not [r for r in out if r[0] == ""]
    assert made(divergence.audit(docs.limit(0))) == []


def test_equal_subtrees_are_one_node_and_prices_are_exact():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 3, (6, 64)) * (rng.random((6, 64)) < 0.2)
    counts[3] = counts[1]
    counts[:, 50:] = -1
    tree = divergence.consed(counts)
    values, levels, roots = tree
    assert roots[3] == roots[1] and len(set(roots.tolist())) == 5
    assert len(levels[0][0]) < 6 * 32 / 4  # equal pairs of leaves are shared
    total = np.arange(100, 106)
    one, two = np.triu_indices(6, 1)
    there, back = divergence.compare(tree, one, two, total)
    for i, j, v, w in zip(one, two, there, back):
        p = [1 + 10**9 * (int(c) + 1) // int(total[i]) for c in counts[i, :50]]
        q = [1 + 10**9 * (int(c) + 1) // int(total[j]) for c in counts[j, :50]]
        assert v == sum((a - b) ** 2 // b for a, b in zip(p, q)) and w == sum((a - b) ** 2 // a for a, b in zip(p, q))


def test_counts_beyond_a_machine_word():
    count, total = np.array([0, 10**13]), np.array([3 * 10**13, 3 * 10**13])
    assert divergence._share(count, total).tolist() == [1 + 10**9 // (3 * 10**13), 1 + 10**9 * (10**13 + 1) // (3 * 10**13)]
