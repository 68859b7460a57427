"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Every text gives its shingle set, a digest of the set and a MinHash signature.  Equal
   sets are one class, carried by its smallest doc_id; only carriers go on.
2. Carriers are posted under each coordinate-value pair.  Two signatures with at least
   ``t`` equal coordinates of ``k`` share one of their ``k - t + 1`` rarest postings
   (prefix), so the rest is not merged, and carriers with fewer than ``t`` shared
   postings leave (skip).  ``t`` is the largest threshold whose chance to miss a pair at
   the wanted similarity is at most ``MISS``.
3. A posting list is not expanded to pairs.  Its leader is its most central carrier, and
   all lists of a leader form one star.  Leader and member pairs are tested first; only
   members that are then in another component than their leader are tested against the
   other members.  Every test counts equal coordinates, keeps pairs with ``t`` or more
   and confirms them on the full sets.  Tests run in blocks of bounded size that emit a
   spanning forest of the links they find, so a large group gives few rows and loses no
   link between components.
4. Components are minimum labels over the confirmed links.

Defined results: a text without words has an empty set and is linked with nothing; a null
text is empty; a null doc_id is linked with nothing, has no component and is kept; a
doc_id with several texts gives each row the component of its text, and texts carried by
one doc_id count as linked; very long texts have the set of their whole; repeated rows get equal
results; other columns are not read (``without_near_duplicates`` carries them under names of
its own), so clashing names do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Members, per_text, read, same_order, stored
from .shingles import digest, shingle_sets, signatures

COORDINATES = 32
MISS = 1e-6
BLOCK_SHINGLES = 65_536
BLOCK_ROWS = 512


@lru_cache(maxsize=8)
def match_threshold(size: int, percent: int, miss: float = MISS) -> int:
    """Largest t with P(fewer than t of ``size`` coordinates agree) <= miss at the similarity."""
    p, below = percent / 100, 0.0
    for t in range(size + 1):
        below += comb(size, t) * p ** t * (1 - p) ** (size - t)
        if below > miss:
            return max(t, 1)
    return size


def sketch(docs: DataFrame, width: int, text: str = "text", size: int = COORDINATES) -> DataFrame:
    """doc_id, text_key, n_shingles, set digest and signature of each row."""
    def make():
        def work(texts: list[str]) -> dict[str, pa.Array]:
            sets = shingle_sets(texts, width)
            return {"n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "digest": pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                    "signature": pa.array(list(signatures(sets, size)), pa.list_(pa.int64()))}
        return work
    named = docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    return per_text(named, ["doc_id", "text_key"], "text",
                    "n_shingles bigint, digest binary, signature array<bigint>", make)


def full_sets(docs: DataFrame, wanted: DataFrame, width: int, text: str = "text",
              size: int = COORDINATES) -> DataFrame:
    """doc_id, signature and whole shingle set (as 64-bit values) of the wanted ids.

    A few other documents that pass the member filter are there too; joins leave them out.
    """
    def make():
        def work(texts: list[str]) -> dict[str, pa.Array]:
            sets = shingle_sets(texts, width)
            return {"signature": pa.array(list(signatures(sets, size)), pa.list_(pa.int64())),
                    "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))}
        return work
    return per_text(docs, ["doc_id"], text, "signature array<bigint>, shingles array<bigint>", make,
                    Members(wanted, "doc_id"))


def stars(carriers: DataFrame, size: int, t: int) -> DataFrame:
    """(leader, doc_id, n_shingles): members of the posting lists that each leader leads."""
    posted = carriers.select("doc_id", "n_shingles", F.explode("signature").alias("posting"))
    lists = posted.groupBy("posting").agg(F.count("*").alias("df")).filter("df > 1")
    shared = posted.join(lists, "posting")
    # At most `size` entries a carrier: rarest first.
    per_doc = (shared.groupBy("doc_id", "n_shingles")
               .agg(F.sort_array(F.collect_list(F.struct("df", "posting"))).alias("found"))
               .filter(F.size("found") >= t)
               .withColumn("central", F.aggregate("found", F.lit(0).cast("long"), lambda s, x: s + x["df"])))
    # Postings that only one carrier has come before all others, so they use up the prefix.
    prefix = F.expr(f"slice(found, 1, greatest({size} - {t} + 1 - ({size} - size(found)), 0))")
    entries = stored(per_doc.select("doc_id", "n_shingles", "central", F.explode(prefix).alias("p"))
                     .select("doc_id", "n_shingles", "central", F.col("p.posting").alias("posting")), "postings")
    leaders = (entries.groupBy("posting")
               .agg(F.max(F.struct("central", (-F.col("doc_id")).alias("minus"))).alias("best"), F.count("*").alias("n"))
               .filter("n > 1").select("posting", (-F.col("best.minus")).alias("leader")))
    return entries.join(leaders, "posting").select("leader", "doc_id", "n_shingles").distinct()


def blocks(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Per key, the number of blocks that keeps each within ``BLOCK_SHINGLES`` and ``BLOCK_ROWS``."""
    return rows.groupBy(*keys).agg(
        F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_ROWS), F.lit(1))
        .cast("int").alias(out))


def in_block(n: str):
    return F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")


def each_block(n: str):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, smallest doc of its component) of the two-sided graph ``links``, roots left out."""
    a, b = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_b = np.minimum(b, np.where(links, a[:, None], top).min(0, initial=top))
        new_a = np.minimum(a, np.where(links, new_b[None], top).min(1, initial=top))
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    docs, roots = np.concatenate([left, right]), np.concatenate([a, b])
    return docs[docs != roots], roots[docs != roots]


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes of all pairs of sets, by products over shared shingles."""
    every = np.concatenate([*left, *right])
    side = np.repeat([0, 1], [sum(map(len, left)), sum(map(len, right))])
    names, code = np.unique(every, return_inverse=True)
    both = (np.bincount(code[side == 0], minlength=len(names)) > 0) & (np.bincount(code[side == 1], minlength=len(names)) > 0)
    place = np.where(both, np.cumsum(both) - 1, -1)[code]
    rows = np.concatenate([np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)])
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(both.sum()), 4096):
        part = (place >= low) & (place < low + 4096)
        sides = []
        for k, s in enumerate((left, right)):
            m = np.zeros((len(s), 4096), np.float32)
            at = part & (side == k)
            m[rows[at], place[at] - low] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def confirmed(table: pa.Table, percent: int, t: int) -> pa.Table:
    """Links between the two sides of one block, as a spanning forest."""
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    right = np.array(table.column("right"))
    if right.all() or not right.any():
        return empty
    docs = np.array(table.column("doc_id"))
    sets = [np.asarray(x, np.int64) for x in table.column("shingles").to_numpy()]
    marks = np.stack([np.asarray(x, np.int64) for x in table.column("signature").to_numpy()])
    rows = [np.flatnonzero(right == k) for k in (0, 1)]
    equal = np.zeros((len(rows[0]), len(rows[1])), np.int16)
    for j in range(marks.shape[1]):
        equal += marks[rows[0], j][:, None] == marks[rows[1], j][None]
    close = equal >= t
    if not close.any():
        return empty
    keep = [np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))]
    close = close[np.ix_(*keep)]
    left, other = rows[0][keep[0]], rows[1][keep[1]]
    common = overlaps([sets[i] for i in left], [sets[i] for i in other])
    sizes = [np.array([len(sets[i]) for i in part], np.int64) for part in (left, other)]
    union = sizes[0][:, None] + sizes[1][None] - common
    a, b = forest(close & (100 * common >= percent * union), docs[left], docs[other])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def tested(pairs: DataFrame, sets: DataFrame, percent: int, t: int) -> DataFrame:
    """Links of the blocks in ``pairs`` (leader, size_class, left_block, right_block, right, doc_id)."""
    keys = ["leader", "size_class", "left_block", "right_block"]
    # Neither side has a bound that would allow a broadcast.
    return (pairs.hint("merge").join(sets, "doc_id").groupBy(*keys)
            .applyInArrow(lambda table: confirmed(table, percent, t), "a bigint, b bigint"))


def leader_tests(star: DataFrame) -> DataFrame:
    members = star.filter("doc_id <> leader")
    sized = blocks(members, ["leader"], "nr").withColumn("size_class", F.lit(0)).withColumn("left_block", F.lit(0))
    columns = ["leader", "size_class", "left_block", "right_block", "right", "doc_id"]
    right = (members.join(sized, "leader").withColumn("right_block", in_block("nr"))
             .withColumn("right", F.lit(True)).select(*columns))
    left = (sized.withColumn("right_block", each_block("nr")).withColumn("right", F.lit(False))
            .withColumn("doc_id", F.col("leader")).select(*columns))
    return left.unionByName(right)


def member_tests(star: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Members apart from their leader, against all members of a size that can match."""
    own = labels.select(F.col("node").alias("doc_id"), F.col("label").alias("own"))
    led = labels.select(F.col("node").alias("leader"), F.col("label").alias("led"))
    named = (star.filter("doc_id <> leader").join(own, "doc_id", "left").join(led, "leader", "left")
             .withColumn("apart", F.coalesce("own", "doc_id") != F.coalesce("led", "leader"))
             .withColumn("size_class", F.floor(F.log(F.col("n_shingles").cast("double")) / log(100 / percent)).cast("int"))
             .select("leader", "doc_id", "n_shingles", "apart", "size_class"))
    apart = named.filter("apart")
    # Sizes of a matching pair differ by less than one class width, so classes are next to each other.
    near = (named.withColumn("size_class", F.explode(F.array(*[F.col("size_class") + i for i in (-1, 0, 1)]))))
    keys = ["leader", "size_class"]
    sized = blocks(apart, keys, "nl").join(blocks(near, keys, "nr"), keys)
    columns = [*keys, "left_block", "right_block", "right", "doc_id"]
    left = (apart.join(sized, keys).withColumn("left_block", in_block("nl")).withColumn("right_block", each_block("nr"))
            .withColumn("right", F.lit(False)).select(*columns))
    right = (near.join(sized, keys).withColumn("right_block", in_block("nr")).withColumn("left_block", each_block("nl"))
             .withColumn("right", F.lit(True)).select(*columns))
    return left.unionByName(right)


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, label) of every node with a link; the label is the smallest node it reaches.

    Minimum labels with pointer jumping; each round is written, so nothing is computed twice.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .distinct(), f"{label}-links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), label)
    while True:
        seen = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen")))
        lower = labels.join(seen, "node").select("node", F.col("label").alias("old"),
                                                 F.least("label", "seen").alias("label"))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = stored(lower.join(jump, "label", "left")
                       .select("node", "old", F.coalesce(F.least("label", "next"), "label").alias("label")), label)
        labels = moved.select("node", "label")
        if not moved.filter("label <> old").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text",
                    size: int = COORDINATES) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, component_id and kept of every row."""
    t = match_threshold(size, percent)
    base = stored(sketch(docs, width, text, size), "sketch")
    carriers = stored(base.filter("digest is not null and doc_id is not null").groupBy("digest")
                      .agg(F.min(F.struct("doc_id", "n_shingles", "signature")).alias("c")).select("digest", "c.*"), "carriers")
    star = stored(stars(carriers, size, t), "stars")
    wanted = star.select("doc_id").union(star.select("leader")).distinct()
    sets = stored(full_sets(docs, wanted, width, text, size), "sets")
    first = stored(tested(leader_tests(star), sets, percent, t), "links")
    # Two classes under one doc_id are one node already; equal sets are linked by their carrier.
    labels = components(first)
    second = stored(tested(member_tests(star, labels, percent), sets, percent, t), "links")
    links = first.unionByName(second)
    if second.limit(1).count():
        labels = components(links)
    rows = base.select("doc_id", "text_key", "n_shingles", "digest")
    of_class = (carriers.select("digest", F.col("doc_id").alias("node")).join(labels, "node", "left")
                .select("digest", F.coalesce("label", "node").alias("component_id")))
    joined = rows.join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (joined.select("doc_id", "text_key", "n_shingles", component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all its columns; rows without doc_id stay."""
    kept = (near_duplicates(docs, width, percent, text).filter("kept and doc_id is not null")
            .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct())
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(text), *same_order(*sorted(docs.columns)))
    one = (docs.join(kept, (docs["doc_id"] == kept["__id"]) & (F.xxhash64(docs[text]) == kept["__key"]), "left_semi")
           .withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(*docs.columns))
    return one.unionByName(docs.filter("doc_id is null"))


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85).drop("text_key")
