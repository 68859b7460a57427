"""The row-rule pattern: conditions on one row become zero or more issue rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple  # (condition, check id, detail[, severity])


def issue(check_id: str | Column, detail: str | Column, severity: str | Column = "major") -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(check_id).alias("check_id"), lit(severity).alias("severity"), lit(detail).alias("detail"))


def issue_array(rules: Sequence[Rule]) -> Column:
    return F.array_compact(F.array(*[
        F.when(F.coalesce(rule[0], F.lit(False)), issue(*rule[1:])) for rule in rules]))


def rule_rows(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule], *more: Column) -> DataFrame:
    """One row per broken rule.  ``more`` are further arrays of issue structs."""
    found = issue_array(rules)
    for extra in more:
        found = F.concat(found, extra)
    return df.select(*keys, F.explode(found).alias("__i")).select(*keys, "__i.*")


def list_issues(values: Column, check_id: str, detail, severity: str = "major") -> Column:
    """Issue structs for the items of an array; ``detail`` maps item to text."""
    return F.transform(values, lambda v: issue(check_id, detail(v), severity))


def for_all(seen: DataFrame, submissions: DataFrame | None, key: str = "submission") -> DataFrame:
    """Flags of every submission; one without rows of its own has none of them.

    Without ``submissions`` only those with rows are judged.
    """
    if submissions is None:
        return seen
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in seen.columns if c != key]
    return submissions.select(key).distinct().join(seen, key, "left").select(key, *flags)
