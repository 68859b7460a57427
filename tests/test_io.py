"""Files in, files out, and the stream forms."""

import json

from pyspark.sql import functions as F

from terravet.sources import readers as R
from terravet.sources import writers as W
from terravet.streaming import history as H


def test_layers_and_documents(spark, tmp_path):
    folder = tmp_path / "geo"
    folder.mkdir()
    good = {"type": "Feature", "properties": {"a": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0, 5], [1, 0, 5], [1, 1, 5], [0, 0, 5]]]}}
    (folder / "a.geojson").write_text("﻿" + json.dumps({"type": "FeatureCollection", "features": [good, {**good, "geometry": None}]}), encoding="utf-8")
    (folder / "b.geojson").write_text("{broken", encoding="utf-8")
    expected = spark.createDataFrame([(f"file://{folder}/a.geojson",), ("file:///gone.geojson",)], "file string")
    features, issues = R.read_layers(spark, str(folder), expected)
    rows = features.collect()
    assert [(r.feature_id, len(r.polys[0][0])) for r in rows] == [("feature-0", 4)]
    assert sorted(r.check_id for r in issues.collect()) == ["GEOMETRY_FILE_MISSING", "GEOMETRY_PARSE", "LAYER_JSON"]
    docs = R.read_json_docs(spark, str(folder))
    assert docs.filter("doc IS NULL").count() == 1


def test_points_lines_packages_dims(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿name,地址,geocode_query,lon_wgs84,lat_wgs84,geocode_status\nx,,q,1,2,ok\n", encoding="utf-8")
    r = R.read_points_csv(spark, str(tmp_path / "p.csv")).first()
    assert (r["_addr"], r["_lon"], r["_status"], r["name"]) == ("q", "1", "ok", "x")
    (tmp_path / "q.txt").write_text("b\n# c\n\n a \nb\n", encoding="utf-8")
    assert [x.query for x in R.read_lines(spark, str(tmp_path / "q.txt")).collect()] == ["a", "b"]
    pkg = tmp_path / "pkg"
    (pkg / "d").mkdir(parents=True)
    (pkg / "d" / "f.txt").write_bytes(b"abc")
    (pkg / "exhibit.json").write_text("{}")
    assert [(x.path, x.length) for x in R.list_package(spark, str(pkg)).collect()] == [("d/f.txt", 3)]
    h = R.package_files(spark, str(pkg / "d")).first()
    assert h.sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    (tmp_path / "t.json").write_text(json.dumps({"tracks": [{"id": " a ", "title": "A"}, {"id": ""}]}), encoding="utf-8")
    assert [(x.id, x.title) for x in R.read_dim(spark, str(tmp_path / "t.json"), "tracks").collect()] == [("a", "A")]
    (tmp_path / "n.json").write_text(json.dumps([{"landid": "京土整储挂（海）[2019]034号", "memo2": "z"}, {"landid": "k", "memo2": "z"}, {"landid": "m", "memo2": ""}]), encoding="utf-8")
    done = spark.createDataFrame([("京土储挂（海）[2019]034号",)], "notice_no string")
    assert [x.notice_no for x in R.read_notices(spark, str(tmp_path / "n.json"), done).collect()] == ["k"]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", None, "x,y")], "a string, b string, c string")
    W.write_csv(df, ["c", "b", "z"], str(tmp_path / "csv"))
    r = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert r.columns == ["c", "b", "z"] and r.first().c == "x,y"
    pts = spark.createDataFrame([("k", 1.5, 2.5)], "category string, lon double, lat double")
    W.write_geojson(pts, {"title": "t"}, str(tmp_path / "geo"), lines=False)
    doc = json.loads(spark.read.text(str(tmp_path / "geo")).first().value)
    assert doc["features"][0]["geometry"]["coordinates"] == [1.5, 2.5] and doc["metadata"]["title"] == "t"
    counts = spark.createDataFrame([("k", "a", 2), ("k", "b", 1)], "kind string, value string, n long")
    W.write_summary(counts, str(tmp_path / "sum"), runs=3)
    assert json.loads(spark.read.text(str(tmp_path / "sum")).first().value) == {"runs": 3, "counts": {"k": {"a": 2, "b": 1}}}
    W.write_registry(spark.createDataFrame([("B", "t"), ("A", "t")], "source_id string, title string"), str(tmp_path / "reg"), "2026-01-01")
    assert [s["source_id"] for s in json.loads(spark.read.text(str(tmp_path / "reg")).first().value)["sources"]] == ["A", "B"]
    roles = spark.createDataFrame([("background", 1, "A", "t")], "role string, rank int, source_id string, title string")
    W.publish_registry(counts, roles, str(tmp_path / "pub"), "2026-01-01")
    assert json.loads(spark.read.text(str(tmp_path / "pub")).first().value)["roles"]["background"][0]["source_id"] == "A"
    W.write_packet_index(spark.createDataFrame([("p", "t", "a", "s", True)], "path string, title string, author string, status string, can_enter_formal_review boolean"), str(tmp_path / "idx"))
    assert spark.read.json(str(tmp_path / "idx")).first().path == "p"


def test_history_stream_equals_batch(spark, tmp_path):
    rows = [("a", i, "x" if i % 4 else "y", (i * 7) % 5) for i in range(20)] + [("b", 1, "x", 2)]
    runs = spark.createDataFrame(rows, "run_key string, seq long, fingerprint string, failures long")
    runs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(runs.schema).parquet(str(tmp_path / "in"))
    q = H.history_stream(stream).writeStream.format("memory").queryName("hist").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.run_key, r.seq): r.action for r in spark.table("hist").collect()}
    from terravet.operators.sequences import ratchet
    want = {(r.run_key, r.seq): r.action for r in ratchet(runs, order=["seq"], block=F.floor(F.col("seq") / 3)).collect()}
    assert got == want


def test_streams_resume_and_validate(spark, tmp_path):
    df = spark.createDataFrame([("submissions/u/p/a.json",)], "path string")
    df.write.parquet(str(tmp_path / "in"))
    packages = spark.createDataFrame([("submissions/u/p/proposal.md",), ("submissions/v/q/proposal.md",)], "proposal string")
    H.validate_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), packages, lambda d: d.withColumn("ok", F.lit(True)),
                      str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r.proposal for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["submissions/u/p/proposal.md"]
    for _ in range(2):
        H.resume_stream(spark, "path string", str(tmp_path / "in"), lambda d: d, str(tmp_path / "o2"), str(tmp_path / "cp2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 1
