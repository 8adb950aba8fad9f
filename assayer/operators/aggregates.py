"""Aggregates: confusion counts and what follows from them, calibration, strata and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import stats


def confusion(df: DataFrame, group: list[str], truth: Column, predicted: Column) -> DataFrame:
    """``tp``, ``fp``, ``tn``, ``fn`` by group."""
    return df.groupBy(*group).agg(
        F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"),
        F.count_if(~truth & ~predicted).alias("tn"), F.count_if(truth & ~predicted).alias("fn"),
    )


def scores(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, macro-F1, macro-recall, MCC and kappa of confusion counts.

    With one true class only, the macro scores are the accuracy.
    """
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    precision, recall, f1 = stats.prf(tp, fp, fn)
    _, recall0, f10 = stats.prf(tn, fn, fp)
    accuracy = (tp + tn).cast("double") / n
    one_class = (tp + fn == 0) | (tn + fp == 0)
    expected = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)).cast("double") / (n * n)
    return counts.select(
        "*", n.alias("n"), accuracy.alias("accuracy"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        F.when(one_class, accuracy).otherwise((f1 + f10) / 2).alias("macro_f1"),
        F.when(one_class, accuracy).otherwise((recall + recall0) / 2).alias("macro_recall"),
        stats.mcc(tp, fp, tn, fn).alias("mcc"), stats.kappa(accuracy, expected).alias("kappa"),
    )


def kappa_many(df: DataFrame, a: str, b: str, degenerate: float = 1.0) -> DataFrame:
    """Cohen's kappa of two raters with any number of classes; only the contingency table is gathered."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(F.col(a).alias("label")).agg(F.sum("n").alias("ra"))
    columns = cells.groupBy(F.col(b).alias("label")).agg(F.sum("n").alias("rb"))
    met = rows.join(columns, "label", "full").select((F.coalesce("ra", F.lit(0)) * F.coalesce("rb", F.lit(0))).cast("double").alias("x"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    both = total.crossJoin(met.agg(F.sum("x").alias("x")))
    agree, expected = F.col("same") / F.col("n").cast("double"), F.col("x") / (F.col("n").cast("double") * F.col("n"))
    return both.select("n", agree.alias("agreement"), stats.kappa(agree, expected, degenerate).alias("kappa"))


def calibration(df: DataFrame, group: list[str], p: Column, correct: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error over right-closed bins, and the Brier score."""
    at = F.greatest(F.ceil(p * bins), F.lit(1))
    binned = df.groupBy(*group, at.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("p"), F.sum(correct.cast("double")).alias("hit"), F.sum((p - correct.cast("double")) ** 2).alias("sq"))
    return binned.groupBy(*group).agg(
        F.sum("n").alias("n"), (F.sum(F.abs(F.col("hit") - F.col("p"))) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier")
    )


def fold_rare(df: DataFrame, column: str, least: int, other: str = "Other") -> DataFrame:
    """Categories of fewer than ``least`` rows become one; the counts are joined back, not windowed."""
    common = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(column, F.lit(True).alias("__common"))
    return df.join(common, column, "left").withColumn(column, F.when(F.col("__common"), F.col(column)).otherwise(other)).drop("__common")


def mode(df: DataFrame, group: list[str], value: str, first: str) -> DataFrame:
    """The most frequent value of each group, the first seen among equals, with its count."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("__first"))
    best = F.max(F.struct("n", (-F.col("__first")).alias("f"), value))
    return counts.groupBy(*group).agg(best.alias("b")).select(*group, F.col(f"b.{value}").alias(value), F.col("b.n").alias("n"))


def upper_median(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Element n div 2 (from 0) of the sorted values, from counts of equal values."""
    from pyspark.sql import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    part = Window.partitionBy(*group)
    ranked = counts.withColumn("up", F.sum("n").over(part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(part))
    return ranked.where(F.col("up") > F.floor(F.col("all") / 2)).groupBy(*group).agg(F.min(value).alias("upper_median"))
