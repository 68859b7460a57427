import random

import numpy as np

from terravet.llm import decontaminate as dc


def distance(item, text):
    """Least word edits between the item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


def fixture():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 50)))) for i in range(25)]
    docs = []
    for d in range(220):
        words = rng.choices(vocabulary, k=rng.randint(0, 120))
        if d % 2:
            item = items[rng.randrange(25)][1].split()
            for _ in range(rng.randint(0, len(item) // 4)):
                kind, at = rng.randrange(3), rng.randrange(len(item))
                item[at:at + (kind != 1)] = [] if kind == 2 else [f"e{rng.randrange(99)}"]
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() for w in item] if d % 4 == 1 else item
        docs.append((d, " ".join(words)))
    return items, docs


def test_leaks_equal_plain_search(spark):
    items, docs = fixture()
    want = {}
    for d, text in docs:
        words = text.lower().split()
        for i, item in items:
            n = distance(item.split(), words)
            if n <= len(item.split()) * 20 // 100:
                want[(d, i)] = n
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = dc.leaks(df, bench).collect()
    got = {(r.doc_id, r.item_id): r.distance for r in rows}
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.99 * len(want) > 60
    text = dict(docs)
    exact = [r for r in rows if r.distance == 0]
    assert exact and all(text[r.doc_id][r.start:r.end].lower() == dict(items)[r.item_id] for r in exact)
    kept = {r.doc_id for r in dc.without_leaks(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    items, docs = fixture()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = {(r.doc_id, r.item_id, r.distance) for r in dc.leaks(df, bench).collect()}
    monkeypatch.setattr(dc, "BLOCK_WORDS", 200)
    parts = {(r.doc_id, r.item_id, r.distance) for r in dc.leaks(df, bench).collect()}
    assert len(whole ^ parts) <= 0.02 * len(whole)


def test_closest_stretch():
    item, text = np.array([1, 2, 3, 4], np.uint64), np.array([9, 1, 2, 7, 3, 4, 9], np.uint64)
    assert dc.closest(item, text) == (1, 1, 6)
    assert dc.closest(item, text[:0])[0] == 4


def test_odd_rows(spark):
    item = "a b c d e f g h i j k l"
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, f"z {item} z", "x"), (3, f"z {item} z", "x"), (None, item, None),
                                (5, "long " * 100_000 + item, "x")], "doc_id bigint, text string, leaks string")
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, item), (4, "too short")],
                                  "item_id bigint, text string")
    rows = dc.leaks(df, bench).collect()
    assert sorted((((r.doc_id or 0), r.item_id, r.distance) for r in rows), key=str) == sorted(
        [(d, i, 0) for d in (0, 3, 3, 5) for i in (None, 1)], key=str)
    left = dc.without_leaks(df, bench)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [1, 2]
    assert dc.leaks(df, bench.limit(0)).count() == 0 and dc.without_leaks(df, bench.limit(0)).count() == 6
    assert dc.leaks(df.limit(0), bench).count() == 0


def items_of(folder):
    import pyarrow.parquet as pq
    return [(r["item_id"], r["text"]) for r in pq.read_table(f"{folder}/benchmark.parquet").to_pylist() if r["text"]]


def block(texts):
    symbols, owner = dc.words([t.lower() for t in texts])
    split = np.split(symbols, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])
    return dc.Items(list(range(len(texts))), split, 80)


def edited_text(item, edits, rng):
    row = item.split()
    for k in range(edits):
        at, kind = rng.randrange(len(row)), rng.randrange(3)
        row[at:at + (kind != 1)] = [] if kind == 2 else [f"new{rng.randrange(10 ** 6)}"]
    return row


def recall(texts, copies, rng):
    """Share of copies with as many edits as the bound allows that are found, by item."""
    items, found = block(texts), []
    noise = [f"n{k}" for k in range(300)]
    for i, text in enumerate(texts):
        edits = int(items.edits(len(text.split())))
        docs = [" ".join([*rng.choices(noise, k=20), *edited_text(text, edits, rng), *rng.choices(noise, k=20)]) for _ in range(copies)]
        found.append(sum(any(m[0] == i for m in row) for row in items.matches(docs)) / copies)
    return found


def test_recall_of_every_given_item():
    texts = [t for _, t in items_of("/root/testdata/sf0.01")]
    found = recall(texts, 40, random.Random(12))
    assert min(found) >= 0.9 and np.mean(found) >= 0.995 and sum(f < 0.95 for f in found) <= len(found) // 50


def test_recall_of_mixed_sizes():
    rng = random.Random(2)
    texts = [" ".join(f"v{rng.randrange(400)}" for _ in range(n)) for n in [12] * 30 + [8] * 10 + [25] * 5 + [300] * 2]
    found = recall(texts, 30, rng)
    assert min(found) >= 0.9 and np.mean(found) >= 0.99


def test_short_items_are_found_exactly(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocabulary, k=1 + i % 7))) for i in range(28)] + [(None, "w1 w2 w3 w4 w5")]
    docs = [(d, " ".join(rng.choices(vocabulary, k=rng.randint(0, 25)))) for d in range(150)]
    want = {}
    for d, text in docs:
        for i, item in items:
            n = distance(item.split(), text.split())
            if n <= len(item.split()) // 5 and text:
                want[(d, i)] = n
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in dc.leaks(df, bench).collect()}
    assert got == want and any(k[1] is None for k in got) and 1 in got.values()
    long = {i for i, t in items if len(t.split()) >= 3}
    assert {r.doc_id for r in dc.without_leaks(df, bench).collect()} == {d for d, _ in docs} - {d for d, i in want if i in long}
