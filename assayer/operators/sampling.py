"""Deterministic samples: rows are ordered by a hash of seed and key, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.windows import top_k


def draw(seed: str, *keys: str) -> Column:
    return F.md5(F.concat_ws("-", F.lit(seed), *(F.col(k).cast("string") for k in keys)))


def counter(text: Column, modulus: Column | int) -> Column:
    """A number below ``modulus`` from the first 32 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % modulus


def simple(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows without replacement: a top-k by hash, merged task by task."""
    return df.orderBy(draw(seed, key), key).limit(n)


def stratified(df: DataFrame, strata: list[str], key: str, n: int, seed: str) -> DataFrame:
    return top_k(df, strata, [draw(seed, key), key], n)


def quota(df: DataFrame, unseen: str, keys: list[str], n: int, seed: str) -> DataFrame:
    """``n`` rows of which min(U, max(n - S, ceil(n / 2))) are unseen, for U unseen and S seen rows."""
    sizes = df.agg(F.count_if(F.col(unseen)).alias("u"), F.count_if(~F.col(unseen)).alias("s"))
    share = F.least("u", F.greatest(F.lit(n) - F.col("s"), F.lit(-(-n // 2))))
    top = top_k(df, [unseen], [draw(seed, *keys), *keys], n).crossJoin(F.broadcast(sizes.select(share.alias("__u"))))
    return top.where(F.col("rank") <= F.when(F.col(unseen), F.col("__u")).otherwise(n - F.col("__u")))


def folds(df: DataFrame, group: str, k: int, seed: str) -> DataFrame:
    return df.withColumn("fold", counter(F.concat(F.lit(f"{seed}-"), F.col(group).cast("string")), k))
