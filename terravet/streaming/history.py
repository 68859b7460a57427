"""Resumable batches, incremental validation and run history, in batch and as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.joins import touched


def resume(rows: DataFrame, done: DataFrame, key: str = "source_row") -> tuple[DataFrame, DataFrame]:
    """(rows carried over with their stored result, rows still to do)."""
    stored = done.filter(F.col(key).isNotNull())
    extra = [c for c in stored.columns if c == key or c not in rows.columns]
    return rows.join(stored.select(*extra), key), rows.join(stored.select(key).distinct(), key, "left_anti")


def resumed(rows: DataFrame, done: DataFrame, process: Callable[[DataFrame], DataFrame], key: str = "source_row") -> DataFrame:
    carried, todo = resume(rows, done, key)
    return carried.withColumn("resumed", F.lit(True)).unionByName(
        process(todo).withColumn("resumed", F.lit(False)), allowMissingColumns=True)


def resume_stream(spark, schema: str, folder: str, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Files that arrive in a folder, each processed once; the checkpoint is the memory."""
    incoming = spark.readStream.schema(schema).parquet(folder)
    return process(incoming).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def touched_packages(packages: DataFrame, changes: DataFrame) -> DataFrame:
    """Packages with a changed file: the only ones to validate again."""
    return packages.join(touched(changes), "proposal", "left_semi")


def validate_stream(changes: DataFrame, packages: DataFrame, validate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Validates the packages that each micro-batch of changes touches."""
    def batch(df: DataFrame, epoch: int) -> None:
        validate(touched_packages(packages, df)).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


HISTORY_OUT = "run_key string, seq long, failures long, best long, action string, stalled boolean"
HISTORY_STATE = "best long, fingerprint string"


def history_stream(runs: DataFrame) -> DataFrame:
    """Ratchet and stall per run key on a stream (run_key, seq, fingerprint, failures).

    The state of a key is its best count and last failure fingerprint, whatever
    the length of its history.
    """
    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for r in rows.itertuples(index=False):
            action = "promote" if best is None or r.failures < best else "rollback" if r.failures > best else "keep"
            best = r.failures if best is None else min(best, r.failures)
            out.append((str(key[0]), r.seq, r.failures, best, action, bool(r.failures > 0 and r.fingerprint == last)))
            last = r.fingerprint
        state.update((int(best), last))
        yield pd.DataFrame(out, columns=["run_key", "seq", "failures", "best", "action", "stalled"])
    return runs.groupBy("run_key").applyInPandasWithState(step, HISTORY_OUT, HISTORY_STATE, "append", GroupStateTimeout.NoTimeout)
