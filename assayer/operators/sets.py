"""Multiset operators as counts by element, so that copies are combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiset_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``__a`` and ``__b``: how often each element is on either side."""
    both = left.select(*keys, F.lit(1).alias("__x"), F.lit(0).alias("__y")).unionByName(right.select(*keys, F.lit(0).alias("__x"), F.lit(1).alias("__y")))
    return both.groupBy(*keys).agg(F.sum("__x").alias("__a"), F.sum("__y").alias("__b"))


def multiset_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Elements that ``left`` has more often, with the surplus ``n``."""
    return multiset_counts(left, right, keys).where("__a > __b").select(*keys, (F.col("__a") - F.col("__b")).alias("n"))
