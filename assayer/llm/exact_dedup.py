"""Exact deduplication by content hash, with a comparison of the bytes inside every hash group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import Scratch, ascii_lower


def normalise(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per document: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Rows are grouped by the 128-bit hash of the normalised text.  The grouping key also holds the text
    itself, so that the aggregate compares bytes and a collision forms two groups; each task first
    merges its own copies, so a text that fills a third of all rows leaves a task once.  The rows then
    fetch their group by hash alone, a skewed join of narrow rows that adaptive execution splits; only
    hashes that really collide are matched by text once more.

    ``keep``: "smallest" or "largest" id of a group stays.  A null text counts as empty; a null id
    stays only where its group has no other; repeated rows of one id and text share one verdict; an
    empty table gives no rows.  Other columns are not read.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("id"), normalise(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("hash", F.unhex(F.md5("norm")))
    texts = rows.groupBy("hash", "norm").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    texts = texts.select("hash", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    groups = Scratch(docs.sparkSession).write(
        texts.groupBy("hash").agg(
            F.count(F.lit(1)).alias("n_texts"),
            *(F.first(c).alias(c) for c in ("text_sha256", "keep_id", "group_size")),
        )
    )
    clear = rows.select("id", "hash").join(groups.where("n_texts = 1"), "hash")
    found = clear.select("id", "keep_id", "group_size", "text_sha256")
    collided = groups.where("n_texts > 1").select("hash")
    if not collided.isEmpty():
        again = rows.join(collided, "hash", "left_semi")
        sizes = again.groupBy("hash", "norm").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        both = again.join(sizes, ["hash", "norm"])
        found = found.unionByName(both.select("id", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256")))
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
