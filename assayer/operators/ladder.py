"""Bounded retry loops replayed from a table of responses, and summaries of arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replay(responses: DataFrame, unit: list[str], attempt: str, accepted: Column, reason: Column, budget: int = 5) -> DataFrame:
    """Each unit stops at its first accepted attempt or at the budget.

    ``validated``, ``iterations`` and the ``reason`` of the last attempt made.  The loop is one
    aggregate: the first accepted attempt is a minimum, so units run side by side and in any order.
    """
    tried = responses.where(F.col(attempt) <= budget)
    first = F.min(F.when(accepted, F.struct(F.col(attempt).alias("at"), reason.alias("reason"))))
    last = F.max(F.struct(F.col(attempt).alias("at"), reason.alias("reason")))
    out = tried.groupBy(*unit).agg(first.alias("first"), last.alias("last"))
    end = F.coalesce("first", "last")
    return out.select(*unit, F.col("first").isNotNull().alias("validated"), end["at"].alias("iterations"), end["reason"].alias("reason"))


def summary(runs: DataFrame, arm: list[str], budget: int = 5) -> DataFrame:
    """Validated rate and mean iterations over accepted runs (the budget where there are none)."""
    return runs.groupBy(*arm).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("validated").alias("k"), F.avg(F.col("validated").cast("int")).alias("vpr"),
        F.coalesce(F.avg(F.when(F.col("validated"), F.col("iterations"))), F.lit(float(budget))).alias("iterations"))
