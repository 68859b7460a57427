"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terravet.session import ensure_checkpoint_dir

PIECE_CHARS = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again.

    Used where a result is read several times: a lost executor costs nothing that
    was written, and later reads take only the columns they need.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(texts: Iterable[str | None], limit: int = PIECE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive pieces of about ``limit`` characters; null is empty."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield start, held


class Members:
    """Bloom filter of the ids of a frame: at most ``MOST_BITS`` bits, whatever the frame holds.

    It only spares work: what passes still meets the ids in a join.
    """

    MOST_BITS, HASHES = 1 << 25, 2

    def __init__(self, ids: DataFrame, column: str):
        self.column = column
        wanted = max(16 * ids.count(), 1 << 16)
        self.bits = min(1 << (wanted - 1).bit_length(), self.MOST_BITS)
        place = F.explode(F.array(*self.places()))
        words = (ids.select(place.alias("p")).groupBy((F.col("p") / 64).cast("long").alias("word"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).toArrow())
        self.table = np.zeros(self.bits // 64, np.int64)
        self.table[np.asarray(words.column("word"))] = np.asarray(words.column("bits"))

    def places(self) -> list[Column]:
        return [F.pmod(F.xxhash64(self.column, F.lit(i)), F.lit(self.bits)).alias(f"__place{i}")
                for i in range(self.HASHES)]

    def mask(self, batch: pa.RecordBatch) -> pa.Array:
        keep = np.ones(batch.num_rows, bool)
        for i in range(self.HASHES):
            at = np.asarray(batch.column(f"__place{i}"))
            keep &= (self.table[at >> 6] >> (at & 63)) & 1 == 1
        return pa.array(keep)


def per_text(df: DataFrame, keep: list[str], text: str, schema: str,
             make: Callable[[], Callable[[list[str]], dict[str, pa.Array]]],
             members: Members | None = None) -> DataFrame:
    """Columns ``keep`` and what ``make()(texts)`` gives for each text.

    ``make`` runs once in each task and returns the function for one piece of
    texts, so memory follows the piece (or the longest single text), not the batch.
    ``members`` drops rows that are surely not among its ids before any work.
    A result column takes the place of a kept column of the same name.
    """
    made_names = {f.name.lower() for f in StructType.fromDDL(schema)}
    keep = [c for c in keep if c.lower() not in made_names]
    apart = [] if text in keep else [F.col(text).alias("__text")]
    wanted = df.select(*keep, *(members.places() if members else []), *apart)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.select(*keep).schema]

    apart = bool(apart)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if members:
                batch = batch.filter(members.mask(batch))
            body = batch.column("__text" if apart else keep.index(text))
            held = [batch.column(i) for i in range(len(keep))]
            for first, texts in pieces(x.as_py() for x in body):
                made = work(texts)
                columns = [c.slice(first, len(texts)) for c in held]
                yield pa.RecordBatch.from_arrays([*columns, *made.values()], names=[*keep, *made])

    return wanted.mapInArrow(run, ", ".join([*fields, schema]))


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under names that no result column can clash with, and the new name of each column."""
    new = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*new.values()), new


def own_names(df: DataFrame, new: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(made).alias(name) for name, made in new.items()])


def same_order(*columns: str) -> list[Column]:
    """Ascending order with nulls first, so that it is total on every input."""
    return [F.col(c).asc_nulls_first() for c in columns]


def ranged(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``df`` dealt to consecutive ranges of ``order`` and stored, with the range number ``part``.

    The number is written with the row, so later steps can rely on it whatever runs again.
    """
    return stored(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), label)


def with_next(df: DataFrame, order: list[Column], columns: list[str], label: str, prefix: str = "next_") -> DataFrame:
    """Adds the values of the following row in ``order``; after the last row comes the first.

    Windows run inside ranges; only the head of each range is seen by the others.
    """
    rows = ranged(df, order, label)
    inside = Window.partitionBy("part").orderBy(*order)
    numbered = rows.withColumn("__n", F.row_number().over(inside))
    heads = numbered.filter("__n = 1").select("part", F.struct(*columns).alias("head"))
    over = Window.orderBy("part")  # one row for each range
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("part", F.coalesce(F.lead("head").over(over), F.first("head").over(every)).alias("__after"))
    return (numbered.withColumn("__lead", F.lead(F.struct(*columns)).over(inside))
            .join(F.broadcast(after), "part")
            .withColumn("__next", F.coalesce("__lead", "__after"))
            .select(*df.columns, *[F.col(f"__next.{c}").alias(prefix + c) for c in columns]))
