"""Ordered operators: history windows, token bands, header and attachment choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions.text import blank, has_any
from ..scale import blocked_lag, blocked_row_number, blocked_running, first_in_group


def dedupe_codes(rows: DataFrame, group: Sequence[str], code: str = "code", order: str = "seq") -> DataFrame:
    """First row per plot code; rows without a code are all kept."""
    coded = first_in_group(rows.filter(blank(F.col(code)) != ""), [*group, code], [F.col(order)])
    return coded.unionByName(rows.filter(blank(F.col(code)) == ""))


# ---- run history ---------------------------------------------------------------------------

def stall(results: DataFrame, key: str = "run_key", run: str = "run_no", block: int = 10_000) -> DataFrame:
    """Runs whose non-empty failure-fingerprint set equals the previous run's.

    A run has one fingerprint per failed rule, so its set is short.
    """
    sets = results.groupBy(key, run).agg(F.array_sort(F.collect_set(
        F.when(F.col("outcome") == "FAIL", F.col("fingerprint")))).alias("__s"))
    named = sets.withColumn("__h", F.sha2(F.array_join("__s", "\n"), 256)).withColumn("failures", F.size("__s"))
    both = blocked_lag(named, [key], [run], F.floor(F.col(run) / block), {"__ph": F.col("__h")})
    return both.select(key, run, "failures", F.coalesce(
        (F.col("failures") > 0) & (F.col("__ph") == F.col("__h")), F.lit(False)).alias("stalled"))


def stall_n(history: DataFrame, n: int, key: str = "run_key", order: Sequence[str] = ("ts", "seq"),
            block: Column | None = None) -> DataFrame:
    """True when the last n rounds share phase and fingerprint."""
    blk = F.date_trunc("hour", order[0]) if block is None else block
    before = blocked_lag(history, [key], order, blk, {"__pf": F.col("fingerprint"), "__pp": F.col("phase")})
    same = F.col("__pf").eqNullSafe(F.col("fingerprint")) & F.col("__pp").eqNullSafe(F.col("phase"))
    numbered = blocked_row_number(before, [key], order, blk, "__i").withColumn(
        "__c", F.when((F.col("__i") == 1) | ~same, F.col("__i")))
    started = blocked_running(numbered, [key], order, blk, {"__start": ("max", F.col("__c"))})
    return started.withColumn("stalled", F.col("__i") - F.col("__start") + 1 >= n).drop("__pf", "__pp", "__i", "__c", "__start")


def ratchet(runs: DataFrame, key: str = "run_key", order: Sequence[str] = ("ts", "seq"), block: Column | None = None) -> DataFrame:
    """Compare each run with the best so far: promote, rollback or keep."""
    blk = F.date_trunc("hour", order[0]) if block is None else block
    best = blocked_running(runs, [key], order, blk, {"best_before": ("min", F.col("failures"))}, inclusive=False)
    action = (F.when(F.col("best_before").isNull() | (F.col("failures") < F.col("best_before")), "promote")
              .when(F.col("failures") > F.col("best_before"), "rollback").otherwise("keep"))
    return best.withColumn("action", action).withColumn("best", F.least("best_before", "failures"))


def quota_latch(rows: DataFrame, key: str, order: Sequence[str], block: Column, status: str = "status",
                done: str = "done") -> DataFrame:
    """Once the quota is exceeded, every later row that is not done is exceeded too."""
    hit = F.when(~F.col(done) & (F.col(status) == "quota_exceeded"), 1).otherwise(0)
    latched = blocked_running(rows, [key], order, block, {"__q": ("max", hit)}, inclusive=False)
    return latched.withColumn("final_status", F.when(F.col(done), "skipped_resume").when(
        F.coalesce("__q", F.lit(0)) == 1, "quota_exceeded").otherwise(F.col(status))).drop("__q")


# ---- token tables -----------------------------------------------------------------------------

def greedy_starts(ys: Column, tolerance: int) -> Column:
    """First value of each band of a sorted array: a band ends where y - its first y > tolerance."""
    return F.aggregate(ys, F.array().cast("array<bigint>"), lambda acc, y: F.when(
        (F.size(acc) == 0) | (y - F.element_at(acc, -1) > tolerance), F.array_append(acc, y)).otherwise(acc))


def bands(tokens: DataFrame, page: Sequence[str], tolerance: int = 25) -> DataFrame:
    """Row band of each token.

    Only the distinct pixel rows of a page are ordered; a gap wider than the
    tolerance always starts a band, so the greedy walk runs inside the stretches
    between such gaps.
    """
    rows = tokens.select(*page, F.col("y").cast("bigint").alias("y")).distinct()
    w = Window.partitionBy(*page).orderBy("y")
    gap = F.when(F.col("y") - F.lag("y").over(w) <= tolerance, 0).otherwise(1)
    runs = rows.withColumn("__g", gap).withColumn("__s", F.sum("__g").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    walked = runs.groupBy(*page, "__s").agg(F.array_sort(F.collect_list("y")).alias("__ys")).withColumn(
        "__b", greedy_starts(F.col("__ys"), tolerance))
    starts = walked.select(*page, F.explode("__ys").alias("y"), F.col("__b")).select(
        *page, "y", F.array_max(F.filter("__b", lambda b: b <= F.col("y"))).alias("band"))
    return tokens.withColumn("y", F.col("y").cast("bigint")).join(starts, [*page, "y"])


def assign_column(tokens: DataFrame, headers: DataFrame, doc: str, tolerance: float = 14.0) -> DataFrame:
    """Nearest header column of each token, if it is close enough.

    A document has at most a handful of header columns: they travel as one array.
    """
    packed = headers.groupBy(doc).agg(F.collect_list(F.struct("pos", "col", F.col("x").alias("hx"))).alias("__h"))
    ranked = F.transform(F.col("__h"), lambda h: F.struct(F.abs(F.col("x") - h["hx"]).alias("d"), h["pos"].alias("p"), h["col"].alias("c")))
    best = F.array_min(F.filter(ranked, lambda r: r["d"] < tolerance + 1))
    return tokens.join(packed, doc).withColumn("col", best["c"]).drop("__h").filter("col IS NOT NULL")


def merge_rows(cells: DataFrame, page: Sequence[str], reach: int = 2) -> DataFrame:
    """Row keys at most ``reach`` apart become one row; ``12.`` and ``5`` are joined.

    ``cells`` holds (page..., yk, col, value), one value per cell.
    """
    keys = cells.select(*page, "yk").distinct()
    w = Window.partitionBy(*page).orderBy("yk")
    gap = F.when(F.col("yk") - F.lag("yk").over(w) <= reach, 0).otherwise(1)
    marked = keys.withColumn("__g", gap).withColumn("bucket", F.sum("__g").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__g")
    parts = cells.join(marked, [*page, "yk"]).groupBy(*page, "bucket", "col").agg(
        F.array_sort(F.collect_list(F.struct("yk", "value"))).alias("__v"))
    joined = F.aggregate(F.col("__v"), F.lit(None).cast("string"), lambda acc, v: F.when(
        acc.endswith(".") & v["value"].rlike(r"^\d+$"), F.concat(acc, v["value"])).otherwise(v["value"]))
    return parts.select(*page, "bucket", "col", joined.alias("value"))


def pick_header(words: DataFrame, doc: str, patterns=None) -> DataFrame:
    """Header columns of the page with the widest header (at least four columns), of all pages."""
    patterns = patterns or P.HEADER_WORDS
    inside = words.filter((F.col("y") > 40) & (F.col("x") >= 140))
    named = F.array_compact(F.array(*[F.when(has_any(F.col("text"), pats), F.struct(F.lit(i).alias("pos"), F.lit(c).alias("col")))
                                      for i, (c, pats) in enumerate(patterns)]))
    hits = inside.select(doc, "page", "x", F.inline(named)).groupBy(doc, "page", "pos", "col").agg(
        F.when(F.col("col") == patterns[0][0], F.max("x")).otherwise(F.min("x")).alias("x"))
    pages = hits.groupBy(doc, "page").agg(F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("spread")).filter("n >= 4")
    best = pages.groupBy(doc).agg(F.min_by("page", F.struct((-F.col("spread")).alias("s"), "page")).alias("page"), F.max("spread").alias("spread"))
    return hits.join(best, [doc, "page"]).select(doc, "page", "pos", "col", "x", "spread")


def pick_attachments(files: DataFrame, notice: str = "notice", patterns=None) -> DataFrame:
    """First attachment of each kind by position, kinds in priority order."""
    kinds = F.array_compact(F.array(*[F.when(has_any(F.col("name"), pats), F.struct(F.lit(i).alias("priority"), F.lit(k).alias("kind")))
                                      for i, (k, pats) in enumerate(patterns or P.ATTACHMENT_PATTERNS)]))
    return files.select(notice, "name", "pos", F.inline(kinds)).groupBy(notice, "priority", "kind").agg(F.min_by("name", "pos").alias("name"))


NUMBER = r"\d+(?:\.\d+)?"


def joined_decimals(text: Column) -> Column:
    """``12. 5`` becomes ``12.5`` (two passes, as neighbours share digits)."""
    once = F.regexp_replace(text, r"(\d+)\.\s*(\d+)", "$1.$2")
    return F.regexp_replace(once, r"(\d+)\.\s*(\d+)", "$1.$2")


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda n: n.cast("double"))


def totals(tokens: DataFrame, page: Sequence[str], reach: int = 40, marks=("总", "合"), tail: str = "计") -> DataFrame:
    """First two numbers of at least 100, by x, within reach of the first "total" token."""
    is_total = has_any(F.col("text"), list(marks)) & F.contains(blank(F.col("text")), F.lit(tail))
    anchor = tokens.filter(is_total).groupBy(*page).agg(F.min_by("y", F.struct("seq", "y", "x")).alias("__y"))
    near = tokens.join(anchor, list(page)).filter(F.abs(F.col("y") - F.col("__y")) <= reach)
    line = near.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("x", "seq", "text"))).alias("__t")).withColumn(
        "__n", F.filter(numbers(joined_decimals(F.array_join(F.transform("__t", lambda t: t["text"]), " "))), lambda v: v >= 100))
    return line.filter(F.size("__n") >= 2).select(*page, F.col("__n")[0].alias("total_land"), F.col("__n")[1].alias("total_floor"))
