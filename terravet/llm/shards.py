"""Contiguous shards of near-equal byte size by global prefix sums.

Rows are dealt to ranges of doc_id.  Each range adds up its rows and bytes; the short
list of range totals is scanned, so every row knows how many bytes and rows come before
it.  The total is cut at equal targets: a row goes to the shard in which its middle
falls, so a cut is at most half a text away from its target.  Texts are read once and never shuffled.

Defined results: a null text has no bytes (size 1) and the checksum of an empty text; a
null doc_id comes first; rows with one doc_id are ordered by checksum and size, so
repeated rows are interchangeable; very long texts are only measured; other columns are not
read, so clashing names do not matter; an empty table gives an empty result.  A shard may
be empty where a single text is larger than a target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ranged, read, same_order

SHARDS = 16


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and one) and CRC-32 of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    order = same_order("doc_id", "text_crc32", "size")
    rows = ranged(measured(docs, text), order, "sizes")
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
                            F.sum("bytes").over(every).alias("all_bytes"))
    inside = Window.partitionBy("part").orderBy(*order)
    start = F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = (rows.join(F.broadcast(offsets), "part")
              .withColumn("row", F.col("rows_before") + F.row_number().over(inside) - 1)
              .withColumn("start", start)
              .withColumn("shard", F.floor(F.expr(f"(2 * start + size) * {shards} div (2 * all_bytes)")).cast("int")))
    # The first row of each shard, one for each of the few shards.
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return (placed.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot")))


def op10_balanced_shards(spark, sf_dir: str) -> DataFrame:
    return (shard(read(spark, sf_dir, "documents"))
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))
