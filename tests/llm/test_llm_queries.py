"""The registered queries, their SQL and the pipeline."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import oracle  # noqa: E402

import corpus_pipeline  # noqa: E402
from terravet.llm import queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    numbers = {name.split("_")[0] for name in queries.QUERIES if name.startswith("op")}
    assert numbers == {f"op{n}" for n in range(1, 14)} and "pipeline" in queries.QUERIES


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert oracle.compare(queries.QUERIES[name](spark, FOLDER), oracle.connect(FOLDER), queries.ORACLES[name]) == []


def test_pipeline_stages(spark):
    docs = corpus_pipeline.read(spark, FOLDER, "documents")
    columns, before = docs.columns, docs
    from terravet.llm import decontaminate, quality
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stored(stage(spark, before, FOLDER), name)
        assert after.columns == columns
        counts.append(after.count())
        before = after
    assert len(corpus_pipeline.STAGES) == 5 and counts == sorted(counts, reverse=True) and counts[-1] > 0
    labels = corpus_pipeline.read(spark, FOLDER, "labels")
    good = docs.join(labels, "doc_id").filter("quality = 1")
    kept = corpus_pipeline.keep_good(spark, docs, FOLDER).join(labels, "doc_id").filter("quality = 1")
    assert kept.count() >= 0.97 * good.count()
    assert decontaminate.leaks(before, corpus_pipeline.read(spark, FOLDER, "benchmark")).count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, before, FOLDER)
    assert out.count() == counts[-1] and out.filter("not lossless").count() == 0
    assert quality.MAX_LABELLED == 20_000


def test_pipeline_of_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", None, None), (None, "", None, "s", 0), (3, "plain words of a text.", "en", "s", 22),
            (3, "plain words of a text.", "en", "s", 22)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean"
    docs = spark.createDataFrame([(*r, 0.1, False) for r in rows], schema)
    for frame, name in ((docs, "documents"), (spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), "labels"),
                        (spark.createDataFrame([], "item_id bigint, text string"), "benchmark")):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 1, 3]
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
