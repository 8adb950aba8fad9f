"""Helpers that several training-data operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.sources.shared import Scratch, shared_dir

__all__ = ["Scratch", "ascii_lower", "numbered", "shared_dir"]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII rows take the cheaper built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def numbered(scratch: Scratch, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``place``, from 0 on in the order of the keys; rows with equal keys must be alike.

    The driver gets a count for each partition.
    """
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = scratch.write(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    counts = sorted(dealt.groupBy("part").agg(F.count(F.lit(1)), F.min("at")).collect())
    offsets, before = [], 0
    for part, n, first in counts:
        offsets.append((part, before - first))
        before += n
    known = rows.sparkSession.createDataFrame(offsets, "part int, shift long")
    return dealt.join(F.broadcast(known), "part").withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift")
