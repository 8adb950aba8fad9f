"""Join operators: k-th match, lookup, band, containment and best-match joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.windows import first_wins

#: A side of at most so many rows is broadcast; a larger one is shuffled.
SMALL_ROWS = 100_000


def small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Marks a side for broadcast after its rows have been counted, else leaves the choice to Spark."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def large(df: DataFrame) -> DataFrame:
    """Marks a side that is never broadcast: Spark's estimate knows neither how long its texts are nor how many rows were made of one."""
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals narrow rows that each ask for much work to all cores at least; a small table would be one task, whatever is made of it."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def kth_match(left: DataFrame, right: DataFrame, key: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Joins the k-th left row of a key to its k-th right row: greedy one-to-one matching without a loop."""
    a = left.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(*left_order)))
    b = right.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(*right_order)))
    return a.join(b, [*key, "k"])


def lookup(facts: DataFrame, dim: DataFrame, key: list[str], order: list[str], values: dict[str, object]) -> DataFrame:
    """Left join to the first row of each key, with defaults."""
    first = first_wins(dim, key, order).select(*key, *values)
    return facts.join(first, key, "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in values.items()})


def band_join(left: DataFrame, right: DataFrame, key: list[str], a: str, b: str, width: int) -> DataFrame:
    """Rows with equal keys and ``abs(a - b) <= width``.

    The band becomes an equality of buckets as wide as the band: a right row goes to its own bucket and
    the two beside it, so the join is hashed on key and bucket instead of comparing all of a key.
    """
    step = max(1, width)
    left = left.withColumn("__bucket", F.floor(F.col(a) / step))
    near = F.explode(F.array(*(F.floor(F.col(b) / step) + d for d in (-1, 0, 1))))
    right = right.withColumn("__bucket", near)
    return left.join(right, [*key, "__bucket"]).where(F.abs(F.col(a) - F.col(b)) <= width).drop("__bucket")


def contains_first(texts: DataFrame, needles: DataFrame, text: str, needle: Column, order: list[str]) -> DataFrame:
    """Left join to the first needle that the text contains; the needles' side must be small and is checked."""
    row = texts.withColumn("__row", F.monotonically_increasing_id())
    met = row.join(small(needles), F.contains(F.col(text), needle), "left")
    return first_wins(met, ["__row"], order).drop("__row")


def best_match(scored: DataFrame, query: list[str], score: str, tie: str, carry: list[str]) -> DataFrame:
    """The highest score of each query, the smallest ``tie`` among equals."""
    best = F.max_by(F.struct(*carry, tie), F.struct(F.col(score), -F.col(tie)))
    return scored.groupBy(*query).agg(F.max(score).alias(score), best.alias("__best")).select(*query, score, *(F.col(f"__best.{c}").alias(c) for c in [*carry, tie]))
