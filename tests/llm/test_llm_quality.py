import numpy as np
import pytest

from terravet.llm import quality


def test_pairs_separate_good_from_bad():
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(["the", "river", "runs", "slowly", "home."], 40)) for _ in range(80)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choice(["buy", "now", "cheap", "deal"], 40)) for _ in range(20)]
    x = np.array([quality.features(t) for t in good + bad])
    y = np.array([1] * 80 + [0] * 20)
    model = quality.fit_pairs(x, y)
    assert ((model.score(x) >= quality.CUT_SCORE) == (y == 1)).all()
    assert quality.fit_pairs(x[:80], y[:80]) is None


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scores = quality.op7_quality_scores(spark, "/root/testdata/sf0.01")
    part = scores.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in part) / len(part) > 0.95
    assert scores.count() == docs.count()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 1), (2, "", 1), (None, "word " * 50_000, 2), (4, "a b.", 3)],
                                 "doc_id bigint, text string, y int")
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (2, None), (1, 1)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    out = quality.accepted(docs.withColumnRenamed("y", "score"), model)
    assert out.columns == ["doc_id", "text", "score"]
    rows = quality.classify(docs, model, ["doc_id"]).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= quality.CUT_SCORE) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 2}) == 1
    assert quality.train(docs.limit(0), labels) is None
    assert quality.classify(docs.limit(0), None, ["doc_id"]).count() == 0


@pytest.mark.parametrize("text", ["", " ", "\n\n", "é", "\ud800"])
def test_features_are_finite(text):
    assert np.isfinite(quality.features(text)).all()
