"""Divergence of sources within a language: hash-consed segment trees over term ids.

Terms are counted inside the tasks that read the texts; what is shuffled is one row for
each language, source and term of a piece.  The kept terms of a language are numbered by
falling count through range partitions, so rare terms with their few small counts stand
beside each other.  The numbers are cut into blocks; over each block every group (a source
of a language) has a segment tree of its counts.  Trees are built bottom up for all groups
at once and hash-consed: a node is the pair of its children, and equal subtrees are one
node, in whichever group or place they occur.  Two trees are compared from the roots down.
Each level holds the distinct pairs of nodes with the number of times they occur, so a pair
of equal nodes is priced once, however often it is met; at the leaves a pair of counts gives
its two prices (one in each direction).  Prices are whole numbers and add up over blocks.

A block of terms meets two tiles of at most TILE sources at a time, so a task holds a
bounded table however many sources a language has.  All pairs of sources are the result.

Bounds: value is below 2^63 as long as a language has fewer than 10^9 kept terms (the shares
of a group add up to 10^9 and one for each term, and a price is at most the square of a share).
Counts beyond 9 * 10^9 are computed with numbers of any length.

Defined results: null text, lang or source is read as empty; a group without terms has the
share of a count of 0 everywhere; a language without kept terms has pairs of value 0 and no
term rows; very long texts are counted whole; repeated rows count each; ties go by the bytes
of the item; other columns are not read, so clashing names do not matter; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, ranged, read, stored

UNIT = 1_000_000_000
LEAST_DOCS, TOP_TERMS = 3, 200
#: Terms of a block, sources of a tile, pairs of trees compared at a time.
BLOCK, TILE, PAIRS_AT_ONCE = 4096, 64, 256
PIECE = 4_000_000
#: ASCII letters in lower case and all other bytes of UTF-8 as they are; the rest of ASCII ends a term.
TERM_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

COUNTED = "lang string, source string, term string, n bigint, docs bigint"


def counted_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all documents; each group also has a row of the empty term."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, texts in pieces((x.as_py() for x in batch.column(2)), PIECE):
                yield _count(langs[first:first + len(texts)], sources[first:first + len(texts)], texts)

    # A task sees a term in many pieces: Spark adds them up before the shuffle.
    return (rows.mapInArrow(run, COUNTED).groupBy("lang", "source", "term")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _count(langs: list[str], sources: list[str], texts: list[str]) -> pa.RecordBatch:
    words = [text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split() for text in texts]
    names: dict[tuple[str, str], int] = {}
    group_of = np.array([names.setdefault(pair, len(names)) for pair in zip(langs, sources)], np.int64)
    flat = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
    kinds = max(len(flat.dictionary), 1)
    row = np.repeat(np.arange(len(texts)), [len(own) for own in words])
    in_row, times = np.unique(row * kinds + np.asarray(flat.indices), return_counts=True)
    # Sorted by group and term, equal keys add up.
    key = group_of[in_row // kinds] * kinds + in_row % kinds
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    n = np.add.reduceat(times, head) if len(head) else times
    docs = np.diff(np.append(head, len(key)))
    group, term = key[head] // kinds, key[head] % kinds
    pairs = list(names)
    mark = np.arange(len(pairs))
    every = np.append(group, mark)
    terms = pa.concat_arrays([flat.dictionary.take(pa.array(term)).cast(pa.string()), pa.array([""] * len(pairs), pa.string())])
    zeros = np.zeros(len(pairs), np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in pairs], pa.string()).take(pa.array(every)),
         pa.array([p[1] for p in pairs], pa.string()).take(pa.array(every)), terms,
         pa.array(np.append(n, zeros), pa.int64()), pa.array(np.append(docs, zeros), pa.int64())],
        names=["lang", "source", "term", "n", "docs"])


def numbered_terms(counted: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, lang_n, id): the kept terms, numbered from 0 in each language by falling count."""
    kept = (counted.filter("term <> ''").groupBy("lang", "term")
            .agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).drop("docs"))
    order = [F.col("lang"), F.col("lang_n").desc(), F.col("term")]
    rows = ranged(kept, order, "terms")
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("lang", "part").count().select(
        "lang", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))  # a row for each range
    inside = Window.partitionBy("part", "lang").orderBy(*order[1:])
    return (rows.withColumn("k", F.row_number().over(inside)).join(offsets, ["lang", "part"])
            .select("lang", "term", "lang_n", (F.col("offset") + F.col("k") - 1).alias("id")))


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), exact."""
    if len(count) and int(count.max()) >= 9 * UNIT:
        count, total = count.astype(object), total.astype(object)
    return (1 + UNIT * (count + 1) // total).astype(np.int64)


def consed(counts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(counts of the leaf nodes, (left, right) of the nodes of each level, root of each tree).

    Rows are trees over a power of two of leaves; equal subtrees of all trees are one node.
    """
    values, node = np.unique(counts, return_inverse=True)
    node = node.reshape(counts.shape).astype(np.int64)
    levels, kinds = [], len(values)
    while node.shape[1] > 1:
        made, inverse = np.unique(node[:, 0::2] * kinds + node[:, 1::2], return_inverse=True)
        levels.append((made // kinds, made % kinds))
        node, kinds = inverse.reshape(len(node), -1).astype(np.int64), len(made)
    return values, levels, node[:, 0]


def _together(pair: np.ndarray, a: np.ndarray, b: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal node pairs of a pair of trees as one, with the sum of their times."""
    ka, kb = int(a.max()) + 1, int(b.max()) + 1
    key = (pair * ka + a) * kb + b
    order = np.argsort(key)
    key = key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    key = key[head]
    return key // (ka * kb), key // kb % ka, key % kb, np.add.reduceat(times[order], head)


def compare(tree: tuple, one: np.ndarray, two: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed prices of tree one[i] against two[i], and the other way round, for each i.

    The frontier holds each distinct pair of nodes of a level once, with its multiplicity.
    """
    values, levels, roots = tree
    pair, a, b, times = np.arange(len(one)), roots[one], roots[two], np.ones(len(one), np.int64)
    for left, right in reversed(levels):
        pair, a, b, times = _together(np.append(pair, pair), np.append(left[a], right[a]),
                                      np.append(left[b], right[b]), np.append(times, times))
    real = values[a] >= 0
    pair, a, b, times = pair[real], values[a][real], values[b][real], times[real]
    p, q = _share(a, total[one[pair]]), _share(b, total[two[pair]])
    square = (p - q) * (p - q)
    there, back = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
    np.add.at(there, pair, square // q * times)
    np.add.at(back, pair, square // p * times)
    return there, back


PRICED = "lang string, source string, part string, item string, value bigint"


def price_block(table: pa.Table, size: int, tile_size: int) -> pa.Table:
    """Prices of one block of terms between two tiles of sources."""
    groups = table.filter(pc.is_null(table["id"])).sort_by("g")
    cells = table.filter(pc.is_valid(table["id"]))
    first = groups.slice(0, 1).to_pylist()[0]
    lang, block, kinds, lang_total = first["lang"], first["block"], first["kinds"], first["lang_total"]
    width = min(size, kinds - block * size)
    names, numbers = groups["source"].to_pylist(), np.asarray(groups["g"])
    total = np.asarray(groups["total"]) + kinds
    counts = np.full((len(names), 1 << (width - 1).bit_length()), -1, np.int64)
    counts[:, :width] = 0
    row, column = np.searchsorted(numbers, np.asarray(cells["g"])), np.asarray(cells["id"]) - block * size
    counts[row, column] = np.asarray(cells["n"])
    tree = consed(counts)
    tile = numbers // tile_size
    same = first["tile"] == first["other_tile"]
    i, j = np.triu_indices(len(names), 1)
    if not same:
        i, j = i[tile[i] != tile[j]], j[tile[i] != tile[j]]
    out: list[tuple] = []
    for at in range(0, len(i), PAIRS_AT_ONCE):
        one, two = i[at:at + PAIRS_AT_ONCE], j[at:at + PAIRS_AT_ONCE]
        there, back = compare(tree, one, two, total)
        for x, y, v, w in zip(one, two, there.tolist(), back.tolist()):
            out += [(names[x], "pair", names[y], v), (names[y], "pair", names[x], w)]
    if same and len(cells):
        out += _term_rows(cells, row, total, lang_total + kinds, names)
    columns = list(zip(*out)) or [(), (), (), ()]
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(columns[0], pa.string()),
                     "part": pa.array(columns[1], pa.string()), "item": pa.array(columns[2], pa.string()),
                     "value": pa.array(columns[3], pa.int64())})


def _term_rows(cells: pa.Table, row: np.ndarray, total: np.ndarray, lang_total: int, names: list[str]) -> list[tuple]:
    """The dearest terms of each group against its language, at most TOP_TERMS of a block."""
    n, lang_n = np.asarray(cells["n"]), np.asarray(cells["lang_n"])
    leaves, place = np.unique(np.stack([row, n, lang_n]), axis=1, return_inverse=True)  # equal leaf pairs once
    p, q = _share(leaves[1], total[leaves[0]]), _share(leaves[2], np.full(leaves.shape[1], lang_total))
    value = np.where(p > q, (p - q) * (p - q) // q, -1)[place.ravel()]
    out = []
    terms = np.array([t.encode() for t in cells["term"].to_pylist()], object)
    for g in np.unique(row):
        mine = np.flatnonzero((row == g) & (value >= 0))
        best = sorted(mine.tolist(), key=lambda k: (-value[k], terms[k]))[:TOP_TERMS]
        out += [(names[g], "term", terms[k].decode(), int(value[k])) for k in best]
    return out


def audit(docs: DataFrame, least: int = LEAST_DOCS, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group."""
    counted = stored(counted_terms(docs), "counted")
    terms = numbered_terms(counted, least)
    cells = stored(counted.filter("term <> ''").drop("docs").join(terms, ["lang", "term"]), "cells")
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = cells.select("lang", "id", "n").groupBy("lang").agg(F.sum("n").alias("lang_total"), (F.max("id") + 1).alias("kinds"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = stored(counted.filter("term = ''").select("lang", "source", number.cast("bigint").alias("g"))
                    .join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
                    .withColumn("total", F.coalesce("total", F.lit(0))), "groups")

    tiles = groups.groupBy("lang").agg((F.floor(F.max("g") / tile) + 1).alias("tiles"))
    partners = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))

    def dealt(rows: DataFrame) -> DataFrame:
        own = F.floor(F.col("g") / tile)
        return (rows.join(tiles, "lang").withColumn("__with", partners)
                .withColumn("tile", F.least(own, "__with")).withColumn("other_tile", F.greatest(own, "__with")))

    empty = lambda name, kind: F.lit(None).cast(kind).alias(name)
    heads = dealt(groups.filter("kinds > 0").withColumn("block", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("kinds") - 1) / block)))))
    filled = dealt(cells.join(groups.select("lang", "source", "g"), ["lang", "source"])
                   .withColumn("block", F.floor(F.col("id") / block)))
    keys = ["lang", "block", "tile", "other_tile"]
    rows = heads.select(*keys, "g", "source", "total", "lang_total", "kinds", empty("id", "bigint"), empty("n", "bigint"),
                        empty("lang_n", "bigint"), empty("term", "string")).unionByName(
        filled.select(*keys, "g", empty("source", "string"), empty("total", "bigint"), empty("lang_total", "bigint"),
                      empty("kinds", "bigint"), "id", "n", "lang_n",
                      F.when(F.col("tile") == F.col("other_tile"), F.col("term")).alias("term")))

    def price(table: pa.Table) -> pa.Table:
        return price_block(table, block, tile)

    priced = stored(rows.groupBy(*keys).applyInArrow(price, PRICED), "priced")

    other = groups.select("lang", F.col("source").alias("item"))
    zero = groups.select("lang", "source").join(other, "lang").filter("source <> item").withColumn("value", F.lit(0).cast("bigint"))
    pairs = (priced.filter("part = 'pair'").select("lang", "source", "item", "value").unionByName(
        zero.select("lang", "source", "item", "value")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    best = ranked(priced.filter("part = 'term'"), "term").filter(F.col("rank") <= TOP_TERMS)
    return ranked(pairs, "pair").unionByName(best)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(body, '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
cells AS (
  SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term
  GROUP BY w.lang, w.source, w.term),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total
  FROM groups g LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
langs AS (SELECT lang, count(*)::HUGEINT AS kinds, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000 * (coalesce(c.n, 0) + 1) // (s.total + l.kinds) AS p,
    1 + 1000000000 * (k.n + 1) // (l.total + l.kinds) AS q
  FROM sizes s JOIN langs l ON l.lang = s.lang JOIN kept k ON k.lang = s.lang
  LEFT JOIN cells c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::HUGEINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, value::BIGINT AS value,
    row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
