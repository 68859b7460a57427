"""Preference formatting of conversations.

A pair is two lists of turns, chosen and rejected.  Their longest common prefix of turns
(same role, same text) is rendered once as the prompt; what follows on each side is
rendered as its completion.  The mask of a completion is a list of segments of its code
points: only texts of assistant turns, with their end marks, are trained on.

Everything is built-in array functions over one row for each pair; the turns of a pair
meet once.  Defined results: a null text or role is empty; turns are ordered by turn,
then role and text; two equal sides give empty completions (``usable`` is false), as do
sides without a trained segment on both; a side without turns renders as empty; very
long texts are rendered whole; repeated turns stay repeated; only the named columns are read,
so further columns, whatever their names, do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, with_next

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def mask(turns: Column) -> Column:
    """Segments (chars, train) of the rendered turns."""
    def segments(t: Column) -> Column:
        head = F.char_length(t["role"]) + len(OPEN + MIDDLE)
        body = F.char_length(t["text"]) + len(CLOSE)
        return F.array(F.struct(head.alias("chars"), F.lit(False).alias("train")),
                       F.struct(body.alias("chars"), (t["role"] == TRAINED).alias("train")))
    return F.flatten(F.transform(turns, segments))


def format_sides(sides: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each pair (``keys``) from its turns (side, turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def of(side: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("side") == side, turn)))

    pairs = sides.groupBy(*keys).agg(of("chosen").alias("a"), of("rejected").alias("b"))
    shortest = F.least(F.size("a"), F.size("b"))
    # The first place where the sides differ, or the length of the shorter one.
    common = F.expr("""coalesce(array_min(filter(sequence(1, shortest),
        i -> a[i - 1].role <> b[i - 1].role or a[i - 1].text <> b[i - 1].text)) - 1, shortest)""")
    pairs = (pairs.withColumn("shortest", shortest)
             .withColumn("n_common", F.when(F.col("shortest") == 0, 0).otherwise(common)))

    def rest(c: str) -> Column:
        return F.slice(c, F.col("n_common") + 1, F.size(c))

    out = pairs.select(*keys, "n_common", F.slice("a", 1, F.col("n_common")).alias("p"),
                       rest("a").alias("a"), rest("b").alias("b"))
    out = out.select(*keys, "n_common", rendered(F.col("p")).alias("prompt"),
                     rendered(F.col("a")).alias("chosen"), mask(F.col("a")).alias("chosen_mask"),
                     rendered(F.col("b")).alias("rejected"), mask(F.col("b")).alias("rejected_mask"))
    trained = [F.exists(c, lambda s: s["train"]) for c in ("chosen_mask", "rejected_mask")]
    return out.withColumn("usable", trained[0] & trained[1])


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (pair_id, chosen_id, rejected_id) over turns (conv_id, turn, role, text)."""
    ids = pairs.select("pair_id", F.explode(F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("chosen_id").alias("conv_id")),
        F.struct(F.lit("rejected").alias("side"), F.col("rejected_id").alias("conv_id")))).alias("s"))
    sides = (ids.select("pair_id", "s.*").hint("merge")
             .join(turns.select("conv_id", "turn", "role", "text"), "conv_id"))
    return format_sides(sides, ["pair_id"])


def branches(turns: DataFrame) -> DataFrame:
    """Sides of a pair for each conversation: it is chosen; what leaves it for the next
    conversation (by conv_id, after the last the first) from a turn of 1 to 3 on is rejected."""
    ids = turns.filter("conv_id is not null").select("conv_id").distinct()
    follow = with_next(ids, [F.col("conv_id").asc()], ["conv_id"], "conversations")
    branch = "1 + pmod(conv_id, 3)"
    out = follow.select("conv_id", F.struct(F.lit("chosen").alias("side"), F.col("conv_id").alias("pair_id"),
                                            F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high")).alias("s"))
    kept = follow.select("conv_id", F.struct(F.lit("rejected").alias("side"), F.col("conv_id").alias("pair_id"),
                                             F.lit(None).cast("long").alias("low"), F.expr(branch).alias("high")).alias("s"))
    left = follow.select(F.col("next_conv_id").alias("conv_id"),
                         F.struct(F.lit("rejected").alias("side"), F.col("conv_id").alias("pair_id"),
                                  F.expr(branch).alias("low"), F.lit(None).cast("long").alias("high")).alias("s"))
    roles = out.unionByName(kept).unionByName(left).select("conv_id", "s.*")
    return (turns.select("conv_id", "turn", "role", "text").join(roles.hint("merge"), "conv_id")
            .filter("(low is null or turn >= low) and (high is null or turn < high)")
            .select("pair_id", "side", "turn", "role", "text"))


def op2_preference_pairs(spark, sf_dir: str) -> DataFrame:
    made = format_sides(branches(read(spark, sf_dir, "conversations")), ["pair_id"])

    def text_of(c: str) -> Column:
        return F.array_join(F.transform(c, lambda s: F.concat_ws("x", s["chars"], s["train"].cast("int"))), ",").alias(c)

    return made.select("pair_id", F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen", "rejected",
                       text_of("chosen_mask"), text_of("rejected_mask"), "usable")


OP2_SQL = """
WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
follow AS (SELECT conv_id, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS next_id,
                  1 + conv_id % 3 AS branch FROM ids),
sides AS (
  SELECT f.conv_id AS pair_id, 'a' AS side, turn, role, text FROM follow f JOIN conversations c ON c.conv_id = f.conv_id
  UNION ALL
  SELECT f.conv_id, 'b', turn, role, text FROM follow f JOIN conversations c ON c.conv_id = f.conv_id AND turn < branch
  UNION ALL
  SELECT f.conv_id, 'b', turn, role, text FROM follow f JOIN conversations c ON c.conv_id = f.next_id AND turn >= branch),
numbered AS (SELECT pair_id, side, coalesce(role, '') AS role, coalesce(text, '') AS text,
                    row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS n FROM sides),
counts AS (SELECT pair_id, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM numbered GROUP BY 1),
differ AS (SELECT a.pair_id, min(a.n) AS n FROM numbered a JOIN numbered b
           ON a.pair_id = b.pair_id AND a.n = b.n AND a.side = 'a' AND b.side = 'b'
           WHERE a.role <> b.role OR a.text <> b.text GROUP BY 1),
common AS (SELECT c.pair_id, coalesce(d.n - 1, least(na, nb)) AS n_common FROM counts c LEFT JOIN differ d USING (pair_id)),
turns AS (SELECT pair_id, side, n, n_common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown,
                 (length(role) + 5) || 'x0,' || (length(text) + 8) || 'x' || CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS mask,
                 role = 'assistant' AS train FROM numbered JOIN common USING (pair_id))
SELECT pair_id, n_common,
       coalesce(string_agg(shown, '' ORDER BY n) FILTER (side = 'a' AND n <= n_common), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY n) FILTER (side = 'a' AND n > n_common), '') AS chosen,
       coalesce(string_agg(shown, '' ORDER BY n) FILTER (side = 'b' AND n > n_common), '') AS rejected,
       coalesce(string_agg(mask, ',' ORDER BY n) FILTER (side = 'a' AND n > n_common), '') AS chosen_mask,
       coalesce(string_agg(mask, ',' ORDER BY n) FILTER (side = 'b' AND n > n_common), '') AS rejected_mask,
       coalesce(bool_or(train) FILTER (side = 'a' AND n > n_common), false)
         AND coalesce(bool_or(train) FILTER (side = 'b' AND n > n_common), false) AS usable
FROM turns GROUP BY pair_id, n_common
"""
