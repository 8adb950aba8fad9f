"""Connected components by alternating star contraction, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import Scratch

MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(edges: DataFrame) -> DataFrame:
    """Large star, then small star, of edges with u > v."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # Every node keeps its own link to the least: large stars of local minima add nothing else.
    large = large.distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    met = large.join(least, "u")
    small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node that is reachable, for all nodes of the edges but roots.

    Each round links all larger neighbours of a node to its smallest one, then the smaller ones; a
    component ends as a star around its root after a number of rounds that is logarithmic in practice.
    Rounds are written to the shared folder, and only a count and a checksum reach the driver.
    """
    scratch = Scratch(edges.sparkSession)
    pair = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    now = scratch.write(pair)
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        new = scratch.write(_star(now))
        scratch.drop(now)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
