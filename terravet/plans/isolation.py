"""Rules whose checker throws: an ERROR row for what failed, outcomes for all the rest.

A checker is built and run on its own, as one job over all its rules and submissions, and
its rows are written.  Only when that fails is it divided, first into its rules.  A rule
whose plan cannot be built is an ERROR for every submission.  Rules that fail while they
run are tried on halves of the submissions (by hash; together if all of them fail), so one
bad submission does not take the outcome of the others.  Halving ends at a part with one
submission, when all eighths fail, or after ``attempts`` further jobs of the checker; what
still fails then is an ERROR row for each submission of the part.  A run without faults has
one job for each checker and no more.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

ATTEMPTS, TOGETHER = 64, 4
#: A rule that fails in all parts of this many halvings fails everywhere; no part is halved more often than MOST_HALVINGS.
HOPELESS, MOST_HALVINGS = 3, 40

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Part:
    """Rules of a checker over the submissions whose hash is ``place`` modulo 2^halvings."""

    rules: tuple[str, ...] | None
    halvings: int = 0
    place: int = 0

    def halves(self) -> list["Part"]:
        return [Part(self.rules, self.halvings + 1, self.place + bit * (1 << self.halvings)) for bit in (0, 1)]


def reason(error: BaseException) -> str:
    """Kind of an error and its condition or first line, the same in every run."""
    condition = error.getCondition() if isinstance(error, PySparkException) else None
    text = condition or (str(error).strip().splitlines() or [""])[0]
    return f"Checker error: {type(error).__name__}" + (f": {text}" if text else "")


def _restricted(tables: Tables, part: Part) -> Tables:
    if not part.halvings:
        return tables
    mine = F.pmod(F.xxhash64("submission"), F.lit(1 << part.halvings)) == part.place
    return {name: df.filter(mine) if "submission" in df.columns else df for name, df in tables.items()}


def run_checker(make: Callable[[Tables, DataFrame], DataFrame], tables: Tables, rules: DataFrame, columns: Sequence[str],
                failed: Callable[[DataFrame, Tables, str], DataFrame], attempts: int = ATTEMPTS) -> list[DataFrame]:
    """Written outcome rows of one checker; ``failed(rules, tables, reason)`` gives the ERROR rows of a part."""
    context = rules.sparkSession.sparkContext

    def tried(part: Part) -> tuple[DataFrame | None, str, bool]:
        """(rows, reason, fails while it runs)."""
        mine = rules if part.rules is None else rules.filter(F.col("constraint_id").isin(list(part.rules)))
        running = False
        try:
            plan = make(_restricted(tables, part), mine).select(*columns)
            running = True
            return cut_lineage(plan), "", False
        except Exception as error:  # noqa: BLE001 - a checker is foreign code and may raise anything
            if context._jsc.sc().isStopped():
                raise
            return None, reason(error), running

    def errors(part: Part, why: str) -> DataFrame:
        return failed(rules.filter(F.col("constraint_id").isin(list(part.rules))), _restricted(tables, part), why)

    made, why, running = tried(Part(None))
    if made is not None:
        return [made]
    ids = sorted(r[0] for r in rules.select("constraint_id").distinct().collect())  # the rules of one checker
    out, late, left = [], [], attempts
    for part in [Part((i,)) for i in ids]:
        if len(ids) > 1:
            made, why, running = tried(part)
        if made is not None:
            out.append(made)
        elif running:
            late.append((part.rules[0], why))
        else:
            out.append(errors(part, why))
    groups = [tuple(i for i, _ in late)] if len(late) == len(ids) else [(i,) for i, _ in late]
    for group in groups:
        passed, waiting = False, deque((half, late[0][1]) for half in Part(group).halves())
        while waiting:
            part, why = waiting.popleft()
            if left <= 0 or part.halvings > HOPELESS and not passed:
                out.append(errors(part, why))
                continue
            left -= 1
            made, why, _ = tried(part)
            if made is not None:
                passed = True
                out.append(made)
            elif part.halvings < MOST_HALVINGS and _restricted(tables, part)["submissions"].select("submission").distinct().limit(2).count() > 1:
                waiting.extend((half, why) for half in part.halves())
            elif len(group) > 1:
                for i in group:
                    one = Part((i,), part.halvings, part.place)
                    made, why, _ = tried(one)
                    out.append(made if made is not None else errors(one, why))
            else:
                out.append(errors(part, why))
    return out


def run_all(jobs: Sequence[Callable[[], list[DataFrame]]]) -> list[DataFrame]:
    """Results of all jobs in their order, a few at a time: a small checker need not wait for a large one."""
    with ThreadPoolExecutor(TOGETHER) as pool:
        return [df for made in pool.map(lambda job: job(), jobs) for df in made]
