"""Ranking, stepping and grouping operators over windows.

Each partitions by the caller's key; a total order inside one key needs its rows together, so keys
are families, units or texts, never a whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holm(df: DataFrame, family: list[str], p: str, order: list[str], out: str = "p_holm") -> DataFrame:
    """Holm's step-down correction within each family; ties in p keep the given order."""
    part = Window.partitionBy(*family)
    by = part.orderBy(p, *order)
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(part) - F.row_number().over(by) + 1) * F.col(p))
    stepped = df.withColumn("__step", step)
    running = F.max("__step").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn(out, running).drop("__step")


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key.  An aggregate of a struct, so that a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    names = [f"__o{k}" for k in range(len(order))]
    ranked = F.struct(*(F.col(o).alias(n) if isinstance(o, str) else o.alias(n) for o, n in zip(order, names)), *(F.col(c) for c in rest))
    best = df.groupBy(*key).agg(F.min(ranked).alias("__best"))
    return best.select(*key, *(F.col(f"__best.{c}").alias(c) for c in rest)).select(df.columns)


def mid_rank(value: str, *part: str) -> Column:
    by = Window.partitionBy(*part)
    return F.rank().over(by.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*part, value)) - 1) / F.lit(2.0)


def mid_ranks_by_count(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """``group``, ``value``, ``n`` equal values and their average ``rank``.

    Equal values are counted before the window, so a group holds one row for each different value.
    """
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    up_to = F.sum("n").over(Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("rank", up_to - (F.col("n") - 1) / F.lit(2.0))


def islands(df: DataFrame, unit: list[str], position: str, gap: int, out: str = "island") -> DataFrame:
    """Numbers runs of positions whose steps are at most ``gap``."""
    by = Window.partitionBy(*unit).orderBy(position)
    new = F.when(F.col(position) - F.lag(position).over(by) <= gap, 0).otherwise(1)
    return df.withColumn("__new", new).withColumn(out, F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def top_k(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark stops each task's group at ``k`` rows before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def as_of_last(df: DataFrame, part: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """The last non-null ``value`` at or before each row."""
    by = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(by))
