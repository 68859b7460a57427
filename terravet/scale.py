"""Building blocks that keep one hot key from landing in one task.

* ``blocked_*``  running values over an ordered key.  The order is cut into
  blocks, each (key, block) is summarised, the summaries (one row per block)
  are scanned, and every row is then finished inside its own block.  A key that
  holds a third of the table is spread over its blocks.
* ``dealt``  a join side that must not be broadcast, however small its plan looks.
* ``first_in_group`` / ``top_k``  ``row_number() <= k``: Spark pushes a group
  limit below the shuffle, so a hot key sends at most k rows per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def dealt(df: DataFrame) -> DataFrame:
    """Side of a join that is dealt to the tasks, never broadcast through the driver.

    For tables of features: Spark counts an array as one element and an unfolded row as
    one row, so rings and the cells or edges made of them look far smaller than they are.
    """
    return df.hint("merge")


def literal_table(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Parameter table written in the program, as a one-partition relation."""
    return spark.createDataFrame(list(rows), schema).coalesce(1)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          out: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def first_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "__rank").drop("__rank")


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "min":
        return F.least(carried, local)
    if kind == "max":
        return F.greatest(carried, local)
    raise ValueError(kind)


_AGG = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def blocked_running(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
                    values: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Running sum / count / min / max per key along ``order``.

    ``values`` maps an output name to (kind, expression).  ``block`` must not
    decrease along ``order``.  ``inclusive=False`` leaves the current row out.
    """
    base = df.withColumn("__block", block)
    for name, (_, expr) in values.items():
        base = base.withColumn(f"__v_{name}", expr)
    group = [*keys, "__block"]
    totals = base.groupBy(*group).agg(
        *[_AGG[kind](f"__v_{name}").alias(f"__t_{name}") for name, (kind, _) in values.items()])
    over_blocks = (Window.partitionBy(*keys).orderBy("__block")
                   .rowsBetween(Window.unboundedPreceding, -1))
    carry = totals.select(*group, *[
        (F.sum if kind in ("sum", "count") else _AGG[kind])(f"__t_{name}").over(over_blocks).alias(f"__c_{name}")
        for name, (kind, _) in values.items()])
    inside = (Window.partitionBy(*group).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    out = base.join(carry, group)
    for name, (kind, _) in values.items():
        out = out.withColumn(name, _combine(kind, F.col(f"__c_{name}"),
                                            _AGG[kind](f"__v_{name}").over(inside)))
    drop = ["__block"] + [f"__{p}_{n}" for n in values for p in ("v", "c")]
    return out.drop(*drop)


def blocked_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
                       out: str = "rn") -> DataFrame:
    return blocked_running(df, keys, order, block, {out: ("count", F.lit(1))})


def blocked_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
                values: dict[str, Column]) -> DataFrame:
    """Value of the previous row of the key, across block borders."""
    packed = F.struct(*[expr.alias(name) for name, expr in values.items()])
    base = df.withColumn("__block", block).withColumn("__p", packed)
    group = [*keys, "__block"]
    last = base.groupBy(*group).agg(F.max_by("__p", F.struct(*order)).alias("__l"))
    carry = last.select(*group, F.lag("__l").over(
        Window.partitionBy(*keys).orderBy("__block")).alias("__c"))
    inside = Window.partitionBy(*group).orderBy(*order)
    out = base.join(carry, group).withColumn(
        "__prev", F.coalesce(F.lag("__p").over(inside), F.col("__c")))
    for name in values:
        out = out.withColumn(name, F.col(f"__prev.{name}"))
    return out.drop("__block", "__p", "__c", "__prev")


def later_duplicates(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Rows whose key was already seen at a smaller position.

    The first position is a map-side combined minimum, so only one row per key
    meets the table again.
    """
    first = df.groupBy(*keys).agg(F.min(position).alias("__first"))
    return df.join(first, list(keys)).filter(F.col(position) > F.col("__first")).drop("__first")

