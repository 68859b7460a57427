"""Chat formatting, fingerprints, shards and licence scan."""

import hashlib
import re
import zlib

from terravet.llm import chat, fingerprints, licences, shards


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, prompt string")


def test_common_prefix_is_rendered_once(spark):
    rows = [(1, 0, "user", "hi", "p"), (1, 1, "assistant", "yes", "p"), (1, 2, "user", "so?", "p"), (1, 3, "assistant", "good", "p"),
            (2, 0, "user", "hi", "p"), (2, 1, "assistant", "yes", "p"), (2, 2, "user", "so?", "p"), (2, 3, "assistant", "bad", "p"),
            (3, 0, None, None, "p"), (3, 0, None, None, "p")]
    pairs = spark.createDataFrame([(1, 1, 2), (2, 1, 1), (3, 3, 2), (4, 3, 99)], "pair_id bigint, chosen_id bigint, rejected_id bigint")
    out = {r.pair_id: r for r in chat.format_preferences(turns(spark, rows), pairs).collect()}
    one = out[1]
    assert one.n_common == 3 and one.usable
    assert one.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\nso?<|end|>\n"
    assert one.chosen == "<|assistant|>\ngood<|end|>\n" and one.rejected == "<|assistant|>\nbad<|end|>\n"
    at, kept = 0, []
    for s in one.chosen_mask:
        if s.train:
            kept.append(one.chosen[at:at + s.chars])
        at += s.chars
    assert kept == ["good<|end|>\n"] and at == len(one.chosen)
    assert out[2].n_common == 4 and out[2].chosen == out[2].rejected == "" and not out[2].usable
    assert out[3].n_common == 0 and out[3].chosen.startswith("<||>\n<|end|>") and not out[3].usable
    assert out[4].rejected == "" and out[4].n_common == 0
    assert chat.format_preferences(turns(spark, rows).limit(0), pairs).count() == 0


def test_branches_of_one_conversation_and_none(spark):
    one = turns(spark, [(7, 0, "user", "a", ""), (7, 1, "assistant", "b", ""), (None, 0, "user", "x", "")])
    rows = chat.format_sides(chat.branches(one), ["pair_id"]).collect()
    assert len(rows) == 1 and rows[0].n_common == 2
    assert chat.format_sides(chat.branches(one.limit(0)), ["pair_id"]).count() == 0


def sets(text):
    w = [x for x in re.split(r"[ \t-\r]+", (text or "").lower()) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_probe_sequences_visit_every_bin():
    for start, stride in zip(*fingerprints.probes()):
        assert {(start + k * stride) % fingerprints.BINS for k in range(fingerprints.BINS)} == set(range(fingerprints.BINS))


def test_likeness_without_bias(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = {r.doc_id: r for r in fingerprints.op9_fingerprints(spark, "/root/testdata/sf0.001").collect()}
    ids, errors, prints = sorted(docs, reverse=True), [], {}
    for i, d in enumerate(ids):
        follow = docs[ids[(i + 1) % len(ids)]]
        third = len(docs[d]) // 3
        edited = docs[d][:len(docs[d]) - third] + follow[:third]
        r = out[d]
        assert r.n_chars == len(docs[d]) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for value, other in ((r.near_edited, edited), (r.near_next, follow)):
            a, b = sets(docs[d]), sets(other)
            errors.append(value - len(a & b) / len(a | b))
        assert prints.setdefault(docs[d], r.fingerprint) == r.fingerprint
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.25


def test_odd_fingerprints(spark):
    rows = [(1, None, 5), (2, "", 5), (2, "", 5), (2, "a b", 5), (None, "x y z u v w " * 5000, 5), (9, "é", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, h int")
    out = fingerprints.compared_to_next(df).collect()
    assert len(out) == len(rows)
    assert {r.fingerprint for r in out if r.doc_id == 1} == {""}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    order = [(9, "é"), (2, None), (2, None), (1, ""), (None, None)]
    assert {r.n_chars for r in out if r.doc_id == 9} == {1} and len(order) == 5
    assert fingerprints.compared_to_next(df.limit(0)).count() == 0
    assert fingerprints.fingerprint(df.select("doc_id", "text")).columns == ["doc_id", "text", "fingerprint"]


def check_shards(rows, texts, count=16):
    total, before, slot = sum(r.size for r in rows), 0, {}
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size)):
        assert r.shard == (2 * before + r.size) * count // (2 * total)
        assert r.slot == slot.get(r.shard, 0)
        slot[r.shard] = r.slot + 1
        before += r.size


def test_shards_equal_prefix_sums(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = shards.op10_balanced_shards(spark, "/root/testdata/sf0.01").collect()
    text = {r.doc_id: r.text for r in df.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    check_shards(rows, text)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_odd_shards(spark):
    rows = [(None, None, 1), (None, "b", 1), (3, "", 1), (3, "", 1), (3, "é" * 50_000, 1), (4, "z", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, part int")
    out = shards.shard(df, 4).collect()
    check_shards(out, None, 4)
    assert len(out) == 6 and [r.size for r in out if r.size > 9] == [100_001]
    assert shards.shard(df.limit(0)).count() == 0


def test_licences_and_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(1, "LICENSE", mit), (2, "a/b/c.txt", "no notice"), (3, "a/LICENSE.md", apache), (4, "a/x.txt", f"text\n{mit}\nmore"),
            (5, "z/q.txt", None), (6, None, ""), (7, "a/bb/LICENSE", "license plates of cars are many"), (2, "a/b/c.txt", "no notice")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "file_id bigint, path string, text string, score double")
    out = {r.file_id: r for r in licences.scan(df).collect()}
    assert licences.scan(df).count() == 8
    assert out[1].own_licence == "MIT" and out[4].own_licence == "MIT" and out[3].licence == "Apache-2.0"
    assert (out[2].licence, out[2].inherited_from) == ("Apache-2.0", "a")
    assert (out[5].licence, out[5].inherited_from) == ("MIT", "") and out[6].licence == "MIT"
    assert out[7].own_licence is None and out[7].licence == "Apache-2.0"
    assert licences.scan(df.limit(0)).count() == 0


def test_other_licences_are_not_inherited_over(spark):
    rows = [(1, "LICENSE", "Released under the MIT License."), (2, "a/x.txt", "text\nLicensed under CC BY-NC 4.0.\nmore"),
            (3, "a/y.txt", "Licensed under the Acme Terms of 1999, see the office."), (4, "a/z.txt", "no notice"),
            (5, "b/LICENSE", "Licensed under the Acme Terms of 1999."), (6, "b/c/z.txt", "no notice"),
            (7, "c/x.txt", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
            (8, "c/y.txt", "Licensed under CC BY-ND 4.0."), (9, "d/x.txt", "Licensed under CC0 1.0 Universal."),
            (10, "d/y.txt", "Licensed under the BSD 2-Clause License."), (11, "b/LICENSE.txt", "Released under the MIT License."),
            (12, "e/LICENSE", "Licensed under the Acme Terms of 1999."), (13, "e/f/q.txt", None)]
    out = {r.file_id: r.licence for r in licences.scan(spark.createDataFrame(rows, "file_id bigint, path string, text string")).collect()}
    assert out == {1: "MIT", 2: "CC-BY-NC-4.0", 3: "unknown", 4: "MIT", 5: "unknown", 6: "MIT", 7: "CC-BY-NC-SA-4.0",
                   8: "CC-BY-ND-4.0", 9: "CC0-1.0", 10: "BSD-2-Clause", 11: "MIT", 12: "unknown", 13: "unknown"}


def test_wrapped_headers_licence_files_and_long_texts(spark):
    apache = ('# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance\n# with the License.\n'
              "# You may obtain a copy of the License at\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n")
    mit = ("Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files"
           " (the \"Software\"), to deal in the\nSoftware without restriction, including without limitation the\nrights to use, copy, modify,"
           " merge, publish, distribute,\nsublicense, and/or sell copies of the Software, and to permit\npersons to whom the Software is"
           " furnished to do so, subject to\nthe following conditions:\n")
    long = "plain words of a text. " * 60_000
    rows = [(1, "a/x.py", apache + "\nimport os\n" * 50), (2, "b/y.c", "/*\n" + mit + "*/\n\nint main;\n"), (3, "c/LICENSE-MIT", mit), (4, "c/d/z.c", "no notice"),
            (5, "e/long.txt", long + "\nReleased under the MIT License.\n" + long), (6, "f/long.txt", long + "licence plates"),
            (7, "g/NOTICE.txt", "The MIT text:\n\n" + mit), (8, "h/licenser.py", mit.replace("\n", " "))]
    files = spark.createDataFrame([(*r, "own", "x") for r in rows], "file_id bigint, path string, text string, licence string, segment string")
    out = {r.file_id: (r.licence, r.own_licence) for r in licences.scan(files).collect()}
    assert out == {1: ("Apache-2.0",) * 2, 2: ("MIT",) * 2, 3: ("MIT",) * 2, 4: ("MIT", None), 5: ("MIT",) * 2, 6: (None, None),
                   7: ("MIT",) * 2, 8: ("MIT",) * 2}


def test_every_template_finds_itself(spark):
    files = spark.createDataFrame([(i, f"d{i}/x.txt", text) for i, (_, text) in enumerate(licences.TEMPLATES)], "file_id int, path string, text string")
    assert {r.file_id: r.licence for r in licences.scan(files).collect()} == {i: n for i, (n, _) in enumerate(licences.TEMPLATES)}
    assert all(re.search(licences.CUE, text.lower()) for _, text in licences.TEMPLATES)
