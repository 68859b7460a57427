"""Document fingerprints: one-permutation MinHash with optimal densification.

Every shingle of five words is hashed once.  The upper bits of a hash name its bin and each
bin keeps its smallest hash.  An empty bin copies a filled one, found by a probe sequence
of its own that visits every bin.  Only the lowest ``BITS`` bits of each value, hashed
with the number of its bin so that chance agreements of copies are independent, are
stored.  Two fingerprints agree in a bin by chance with probability 2^-BITS; the likeness
removes that bias.

Built-in expressions only: hashes are an array, sorting it brings the minimum of each bin
to the front of its run.  Defined results: a text of fewer than five words is one shingle;
a text without words (or null) has the fingerprint '' and likeness 1 to another such text
and 0 to all others; equal texts have equal fingerprints; words are compared in lower case;
very long texts are hashed whole; an own column with the name of the result is replaced by
it; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, stored, with_next

WIDTH = 5
BINS = 128
BITS = 8
BIN_SHIFT = 64 - (BINS - 1).bit_length()


def _literal(values) -> str:
    return "array(" + ",".join(map(str, values)) + ")"


def probes() -> tuple[list[int], list[int]]:
    """Start and odd stride of the probe sequence of each bin: it passes every other bin once."""
    state, out = 0x9E3779B9, []
    for _ in range(2 * BINS):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(state >> 33)
    return [x % BINS for x in out[:BINS]], [x % BINS | 1 for x in out[BINS:]]


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: ``BINS`` bytes, empty for a text without words."""
    start, stride = map(_literal, probes())
    w, h, s, f, b, a = (f"__{out}_{c}" for c in "whsfba")
    shingle = ", ".join([f"{h}[i]", *[f"{h}[i + {k}]" for k in range(1, WIDTH)]])
    probe = ", ".join(f"get({a}, (get({start}, j) + {k} * get({stride}, j)) & {BINS - 1})" for k in range(BINS))
    return (df
            .withColumn(w, F.expr(f"filter(split(lower({text}), '[ \\\\t-\\\\r]+'), x -> x <> '')"))
            .withColumn(h, F.expr(f"transform({w}, x -> xxhash64(x))"))
            .withColumn(s, F.expr(f"""case when size({h}) = 0 then cast(array() as array<bigint>)
                when size({h}) < {WIDTH} then array(xxhash64({h}, size({h})))
                else sort_array(transform(sequence(0, size({h}) - {WIDTH}), i -> xxhash64({shingle}))) end"""))
            .withColumn(f, F.expr(f"""filter({s}, (x, i) -> i = 0 or
                shiftrightunsigned(x, {BIN_SHIFT}) <> shiftrightunsigned({s}[i - 1], {BIN_SHIFT}))"""))
            .withColumn(b, F.expr(f"transform({f}, x -> cast(shiftrightunsigned(x, {BIN_SHIFT}) as int))"))
            .withColumn(a, F.expr(f"""transform(sequence(0, {BINS - 1}),
                j -> get({f}, cast(array_position({b}, j) as int) - 1))"""))
            .withColumn(out, F.expr(f"""unhex(case when size({f}) = 0 then '' else array_join(transform({a},
                (v, j) -> substring(hex(256 + (xxhash64(coalesce(v, {probe}), j) & {(1 << BITS) - 1})), 2, 2)), '') end)"""))
            .drop(w, h, s, f, b, a))


def likeness(left: str, right: str) -> Column:
    """Estimated Jaccard similarity of two fingerprints, freed of chance agreement, in 0 to 1."""
    chance = 2.0 ** -BITS
    same = F.expr(f"""size(filter(sequence(1, {BINS}),
        i -> substring({left}, i, 1) = substring({right}, i, 1)))""")
    return (F.when(F.col(left) == F.col(right), 1.0)
            .when((F.length(left) == 0) | (F.length(right) == 0), 0.0)
            .otherwise(F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance))))


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns and the fingerprint of ``text`` as lowercase hex."""
    body = docs.withColumn("__body", F.coalesce(F.col(text), F.lit("")))
    return with_fingerprint(body, "__body", out).drop("__body").withColumn(out, F.lower(F.hex(out)))


def compared_to_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The next document follows in descending doc_id (ties by a hash of the text, null ids
    last; after the last comes the first).  Rows are named by doc_id and text hash, so
    repeated rows share one place in the order.  Texts are shuffled once, by that name;
    of the next text only the part that is needed moves again.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ids = texts.select("doc_id", "h", F.char_length("text").alias("n")).distinct()
    order = [F.col("doc_id").desc_nulls_last(), F.col("h").desc()]
    places = stored(with_next(ids, order, ["doc_id", "h"], "order"), "places")

    def at(left: DataFrame, right: DataFrame, id_: str, h: str) -> Column:
        return right["doc_id"].eqNullSafe(left[id_]) & (right["h"] == left[h])

    third = F.floor(F.col("n") / 3).cast("int")
    wanted = places.select(F.col("doc_id").alias("for_id"), F.col("h").alias("for_h"), "next_doc_id", "next_h",
                           third.alias("third")).filter("third > 0").hint("merge")
    heads = (wanted.join(texts, at(wanted, texts, "next_doc_id", "next_h"))
             .select("for_id", "for_h", F.expr("left(text, third)").alias("head"))
             .groupBy("for_id", "for_h").agg(F.max("head").alias("head")))
    both = (texts.hint("merge").join(heads, at(heads, texts, "for_id", "for_h"), "left")
            .select("doc_id", "h", "text", F.char_length("text").cast("long").alias("n_chars"), "head"))
    # A next text that is shorter than the third gives all it has.
    edited = F.expr("concat(left(text, cast(n_chars - floor(n_chars / 3) as int)), coalesce(head, ''))")
    made = with_fingerprint(with_fingerprint(both.withColumn("edited", edited), "text", "fingerprint"),
                            "edited", "edited_fingerprint")
    rows = stored(made.select("doc_id", "h", "n_chars", F.unhex(F.sha2("edited", 256)).alias("edited_sha"),
                              "fingerprint", "edited_fingerprint"), "fingerprints")
    named = rows.select("doc_id", "h", F.col("fingerprint").alias("next_fingerprint")).distinct()
    follow = places.select(F.col("doc_id").alias("for_id"), F.col("h").alias("for_h"), "next_doc_id", "next_h").hint("merge")
    nexts = (follow.join(named, at(follow, named, "next_doc_id", "next_h"))
             .select("for_id", "for_h", "next_fingerprint"))
    return (rows.hint("merge").join(nexts, at(nexts, rows, "for_id", "for_h"))
            .select("doc_id", "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"),
                    F.lower(F.hex("fingerprint")).alias("fingerprint"),
                    F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
                    likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
                    likeness("fingerprint", "next_fingerprint").alias("near_next")))


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compared_to_next(read(spark, sf_dir, "documents"))
