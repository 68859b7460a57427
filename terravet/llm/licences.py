"""License scans: TF-IDF cosine to templates, then inheritance along directories.

Segments are the header blocks of a file (lines up to an empty one, comment marks apart) and
its single lines, where they hold a word of licence texts, and the whole text of licence
files, which are known by their path.  Equal segments are scored once.  A segment and a
template are sparse vectors of term weights (count times inverse document frequency over
all segments and templates); the cosine comes from a join on terms with the templates,
which are fixed and few.  A file takes the best template of its segments at
``LEAST_SCORE`` or more.  A file without one inherits from the nearest directory above it
(its own first) that holds a licence file: each directory meets its ancestors by path, and
files meet their directory.  A file that grants a licence without a template (``GRANT``)
is ``unknown`` and does not inherit.

Defined results: null and empty texts have no segment; very long texts are split and scored
whole; equal scores go to the template of the smaller name; of several licence files in one
directory the best score counts, then the smaller name; a null path counts as the root;
repeated rows give repeated results; an empty table gives an empty result; only the key, path
and text are read, so clashing names of other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, stored

_CC_LONG = "This work is licensed under a Creative Commons {} 4.0 International License."
_REDISTRIBUTION = ("Redistribution and use in source and binary forms, with or without modification, are permitted"
                   " provided that the following conditions are met: Redistributions of source code must retain the above"
                   " copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form"
                   " must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
                   " documentation and/or other materials provided with the distribution.")
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published"
        " by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")
# Public licence notices and the opening and key paragraphs of licence texts.
TEMPLATES = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format("Affero General Public License")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in'
                   " compliance with the License. You may obtain a copy of the License at"
                   " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
                   ' software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR'
                   " CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing"
                   " permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"
                   " TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", _REDISTRIBUTION),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", _REDISTRIBUTION + " Neither the name of the copyright holder nor the names of its contributors may"
                     " be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", _CC_LONG.format("Attribution")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", _CC_LONG.format("Attribution-NonCommercial")),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", _CC_LONG.format("Attribution-NonCommercial-NoDerivatives")),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", _CC_LONG.format("Attribution-NonCommercial-ShareAlike")),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", _CC_LONG.format("Attribution-NoDerivatives")),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", _CC_LONG.format("Attribution-ShareAlike")),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights"
                " to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format("General Public License")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
            " granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format("Lesser General Public License")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
            ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation'
            " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
            " to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions"
            " of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
                " not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,"
                  " publish, use, compile, sell, or distribute this software."),
)
UNKNOWN = "unknown"
GRANT = "(licen[cs]ed|released|distributed) under|spdx-license-identifier|all rights reserved"
#: Words that every template holds one of; a block or line without any is not scored.
CUE = "licen[cs]|copyright|spdx|public domain|permission is hereby|permission to use|redistribution and use"
#: Lines without letters and digits end a block.
BETWEEN = r"\n(?:[ \t\r/*#;%!<>|=+-]*\n)+"
FILE_NAME = "^(LICEN[CS]E|COPYING|NOTICE|UNLICENSE)([-._].*)?$"
LEAST_SCORE = 0.5


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def is_licence_file(path: Column) -> Column:
    return F.regexp_extract(F.upper(path), r"([^/]*)$", 1).rlike(FILE_NAME)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def segments(files: DataFrame, key: str) -> DataFrame:
    """(key, segment, digest) of the blocks and lines with a word of licences, and of whole licence files."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = F.concat(F.split(text, "\n"), F.split(text, BETWEEN),
                     F.when(is_licence_file(F.col("path")), F.array(text)).otherwise(F.array().cast("array<string>")))
    cued = F.filter(parts, lambda x: F.lower(x).rlike(CUE))
    # Most texts hold no such word at all: they are not split.
    return (files.filter(F.lower(text).rlike(CUE)).select(key, F.explode(F.array_distinct(cued)).alias("segment"))
            .withColumn("digest", F.substring(F.unhex(F.sha2("segment", 256)), 1, 16)))


def scored(found: DataFrame, least: float = LEAST_SCORE, templates: tuple = TEMPLATES) -> DataFrame:
    """(digest, licence, score) of the segments of ``found`` that reach a template.

    A segment is its digest in all tables of terms, so a long one is not repeated with each of its words.
    """
    spark = found.sparkSession
    known = spark.createDataFrame([(f"{name}#{i}", text) for i, (name, text) in enumerate(templates)],
                                  "template string, segment string").coalesce(1)
    seen = stored(found.groupBy("digest").agg(F.count("*").alias("n"), F.first("segment").alias("segment")), "licence-texts")
    bags = stored(seen.select("digest", "n", F.explode(terms(F.col("segment"))).alias("term"))
                  .groupBy("digest", "n", "term").agg(F.count("*").alias("tf")), "licence-terms")
    own = (known.select("template", F.explode(terms(F.col("segment"))).alias("term"))
           .groupBy("template", "term").agg(F.count("*").alias("tf")))
    df = (bags.select("term", "n").unionByName(own.select("term", F.lit(1).cast("long").alias("n")))
          .groupBy("term").agg(F.sum("n").alias("df")))
    total = (seen.agg(F.sum("n")).first()[0] or 0) + len(templates)
    idf = df.select("term", (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1).alias("idf"))
    weight = F.col("tf") * F.col("idf")
    ours = own.join(idf, "term").select("template", "term", weight.alias("weight"))
    length = ours.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    # The templates are the fixed list above, so their side is always small.
    ours = F.broadcast(ours.join(length, "template").select("template", "term", (F.col("weight") / F.col("length")).alias("unit")))
    theirs = bags.join(idf, "term").select("digest", "term", weight.alias("weight"))
    norms = theirs.groupBy("digest").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = theirs.join(ours, "term").groupBy("digest", "template").agg(F.sum(F.col("weight") * F.col("unit")).alias("dot"))
    best = (dots.join(norms, "digest")
            .select("digest", F.split("template", "#")[0].alias("licence"), F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
            .filter(F.col("score") >= least)
            .groupBy("digest").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("b")))
    return best.select("digest", "b.licence", (-F.col("b.minus")).alias("score"))


def scan(files: DataFrame, key: str = "file_id", least: float = LEAST_SCORE,
         templates: tuple = TEMPLATES) -> DataFrame:
    """(key, path, own_licence, score, licence, inherited_from) of files (key, path, text)."""
    found = stored(segments(files, key), "licence-segments")
    hits = (found.select(key, "digest").join(scored(found, least, templates), "digest")
            .groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("b"))
            .select(key, F.col("b.licence").alias("own_licence"), (-F.col("b.minus")).alias("score")))
    grants = found.filter(F.lower("segment").rlike(GRANT)).select(key).distinct()
    hits = hits.join(grants, key, "full").select(key, F.coalesce("own_licence", F.lit(UNKNOWN)).alias("own_licence"), "score")
    path = F.coalesce(F.col("path"), F.lit(""))
    named = files.select(key, "path", directory(path).alias("dir"), is_licence_file(path).alias("is_file"))
    rows = stored(named.join(hits, key, "left"), "licence-files")
    granted = (rows.filter("is_file and own_licence is not null").groupBy("dir")
               .agg(F.min(F.struct((-F.coalesce("score", F.lit(0.0))).alias("minus"), "own_licence")).alias("b"))
               .select(F.col("dir").alias("above"), F.col("b.own_licence").alias("from_above")))
    parts = F.split("dir", "/")
    above = F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")),
                     F.array(F.lit("")))
    nearest = (rows.select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("above"))
               .join(granted, "above")
               .groupBy("dir").agg(F.max(F.struct(F.length("above").alias("size"), "above", "from_above")).alias("b"))
               .select("dir", F.col("b.above").alias("above"), F.col("b.from_above").alias("from_above")))
    return (rows.join(nearest, "dir", "left")
            .select(key, "path", "own_licence", "score", F.coalesce("own_licence", "from_above").alias("licence"),
                    F.when(F.col("own_licence").isNull(), F.col("above")).alias("inherited_from")))


def document_files(docs: DataFrame) -> DataFrame:
    """Paths for documents: every fifth is the licence file of a directory one to four levels
    deep, every other one is a file on the fourth level."""
    source, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    doc = F.coalesce(F.col("doc_id"), F.lit(0).cast("bigint"))
    dirs = F.array(source, lang, F.concat(F.lit("a"), doc % 7), F.concat(F.lit("b"), F.floor(doc / 7) % 5))
    up = F.concat_ws("/", F.slice(dirs, F.lit(1), (1 + doc % 4).cast("int")), F.lit("LICENSE"))
    path = F.when(doc % 5 == 0, up).otherwise(F.concat_ws("/", dirs, F.concat(doc.cast("string"), F.lit(".txt"))))
    return docs.select("doc_id", path.alias("path"), "text")


def op6_licence_scan(spark, sf_dir: str) -> DataFrame:
    return scan(document_files(read(spark, sf_dir, "documents")), "doc_id")


_QUOTED = ",\n  ".join("('{}#{}', '{}')".format(n, i, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))
OP6_SQL = f"""
WITH known(template, segment) AS (VALUES
  {_QUOTED}),
base AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 5 = 0 AS is_file,
  [coalesce(source, ''), coalesce(lang, ''), 'a' || (doc_id % 7), 'b' || ((doc_id // 7) % 5)] AS dirs FROM documents),
files AS (SELECT doc_id, text, is_file, array_to_string(CASE WHEN is_file THEN dirs[1:1 + doc_id % 4] ELSE dirs END, '/') AS dir FROM base),
found AS (SELECT DISTINCT doc_id, segment FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS segment FROM files
  UNION ALL SELECT doc_id, unnest(regexp_split_to_array(text, '{BETWEEN}')) FROM files
  UNION ALL SELECT doc_id, text FROM files WHERE is_file) WHERE regexp_matches(lower(segment), '{CUE}')),
seen AS (SELECT segment, count(*) AS n FROM found GROUP BY 1),
bags AS (SELECT segment, n, term, count(*) AS tf FROM (
  SELECT segment, n, unnest(regexp_extract_all(lower(segment), '[a-z0-9]+')) AS term FROM seen) GROUP BY ALL),
own AS (SELECT template, term, count(*) AS tf FROM (
  SELECT template, unnest(regexp_extract_all(lower(segment), '[a-z0-9]+')) AS term FROM known) GROUP BY ALL),
df AS (SELECT term, sum(n) AS df FROM (SELECT term, n FROM bags UNION ALL SELECT term, 1 FROM own) GROUP BY 1),
idf AS (SELECT term, ln((1 + (SELECT coalesce(sum(n), 0) FROM seen) + {len(TEMPLATES)}) / (1 + df)) + 1 AS idf FROM df),
ours AS (SELECT template, term, tf * idf AS weight FROM own JOIN idf USING (term)),
units AS (SELECT template, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY template)) AS unit FROM ours),
theirs AS (SELECT segment, term, tf * idf AS weight FROM bags JOIN idf USING (term)),
norms AS (SELECT segment, sqrt(sum(weight * weight)) AS norm FROM theirs GROUP BY 1),
dots AS (SELECT segment, template, sum(weight * unit) AS dot FROM theirs JOIN units USING (term) GROUP BY ALL),
scores AS (SELECT segment, split_part(template, '#', 1) AS licence, round(dot / norm, 6) AS score FROM dots JOIN norms USING (segment)),
hits AS (SELECT doc_id, licence AS own_licence, score FROM found JOIN scores USING (segment) WHERE score >= {LEAST_SCORE}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) = 1),
grants AS (SELECT DISTINCT doc_id FROM found WHERE regexp_matches(lower(segment), '{GRANT}')),
rows AS (SELECT f.doc_id, dir, is_file, coalesce(own_licence, CASE WHEN g.doc_id IS NOT NULL THEN '{UNKNOWN}' END) AS own_licence, score
  FROM files f LEFT JOIN hits h USING (doc_id) LEFT JOIN grants g ON g.doc_id = f.doc_id),
granted AS (SELECT dir AS above, own_licence AS from_above FROM rows WHERE is_file AND own_licence IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY coalesce(score, 0) DESC, own_licence) = 1),
nearest AS (SELECT d.dir, above, from_above FROM (SELECT DISTINCT dir FROM rows) d
  JOIN granted ON d.dir = above OR starts_with(d.dir, above || '/') OR above = ''
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(above) DESC) = 1)
SELECT doc_id, dir || '/' || CASE WHEN is_file THEN 'LICENSE' ELSE doc_id || '.txt' END AS path, own_licence, score,
  coalesce(own_licence, from_above) AS licence, CASE WHEN own_licence IS NULL THEN above END AS inherited_from
FROM rows LEFT JOIN nearest USING (dir)
"""
