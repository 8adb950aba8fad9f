"""Best-fit packing of documents into token sequences, under source and duplicate conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import Scratch, ascii_lower

CAPACITY = 2048
#: Pieces that one task packs at a time; bins do not cross these shards.
SHARD_PIECES = 2048


def best_fit(sizes: Sequence[int], sources: Sequence[int], clusters: Sequence[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and slot of every piece, taken in the given order (largest first for best-fit decreasing).

    Open bins are kept in the order of their residual.  From the first bin that is large enough the
    successors are tried until one holds neither the piece's source bit nor its cluster bit: the
    tightest compatible bin.  Without one a new bin is opened.  ``sources`` and ``clusters`` are bit
    masks, zero where the piece conflicts with nothing.
    """
    order: list[tuple[int, int]] = []  # of residual and bin
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    count: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        at = bisect_left(order, (size, -1))
        while at < len(order) and (source_bits[order[at][1]] & source or cluster_bits[order[at][1]] & cluster):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(count)
            source_bits.append(0)
            cluster_bits.append(0)
            count.append(0)
        source_bits[b] |= source
        cluster_bits[b] |= cluster
        out.append((b, count[b]))
        count[b] += 1
        if residual > size:
            insort(order, (residual - size, b))
    return out


def _bits(keys: np.ndarray, none: np.ndarray, repeated_only: bool) -> list[int]:
    """A bit for each key of the shard, or only for keys that occur twice; zero where there is no key."""
    _, code, times = np.unique(keys, return_inverse=True, return_counts=True)
    shared = times > 1 if repeated_only else np.ones(len(times), bool)
    place = np.cumsum(shared) - 1
    return [0 if n or not shared[c] else 1 << int(place[c]) for c, n in zip(code, none)]


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    cluster: Column | None = None, tokens: Column | None = None, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """Pieces of documents with their place: id, ``piece``, ``start``, ``n_tokens``, ``bin_id``, ``slot``.

    A document longer than ``capacity`` is cut into full pieces and a rest, so nothing is truncated.  No
    bin holds two pieces of one source or of one duplicate cluster (by default: texts that are equal
    but for the case of A-Z).  Pieces are dealt by a hash of id and piece to shards of about
    ``shard_pieces``, whatever their source or cluster, and every shard is packed best-fit decreasing
    with ties in the order of id and piece.  ``tokens`` counts the tokens of a row, by default words.

    Null and empty texts give one row with zero tokens, piece 0 and neither bin nor slot; a null source
    conflicts with nothing; repeated rows are pieces of their own.
    """
    tokens = token_count(F.col(text_col)) if tokens is None else tokens
    cluster = F.xxhash64(ascii_lower(F.col(text_col))) if cluster is None else cluster
    source = F.when(F.col(source_col).isNotNull(), F.xxhash64(source_col))
    size = F.least(F.lit(capacity).cast("long"), F.col("all") - F.col("start"))
    rows = docs.select(F.col(id_col).alias("id"), source.alias("source"), cluster.cast("long").alias("cluster"), tokens.cast("long").alias("all"))
    zero = F.lit(0).cast("long")
    starts = F.sequence(zero, F.greatest(F.col("all") - 1, zero), F.lit(capacity).cast("long"))
    pieces = rows.select("*", F.posexplode(starts).alias("piece", "start"))
    pieces = pieces.select("id", "source", "cluster", F.col("piece").cast("long").alias("piece"), "start", size.alias("n_tokens"))
    held = Scratch(docs.sparkSession).write(pieces)
    some = held.where("n_tokens > 0")
    shards = max(1, -(-some.count() // shard_pieces))
    some = some.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "id", "piece"), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id", "piece"], ascending=[False, True, True], kind="stable")
        no_source = pdf["source"].isna().to_numpy()
        sources = _bits(pdf["source"].fillna(0).to_numpy(np.int64), no_source, False)
        clusters = _bits(pdf["cluster"].fillna(0).to_numpy(np.int64), pdf["cluster"].isna().to_numpy(), True)
        placed = best_fit(pdf["n_tokens"].tolist(), sources, clusters, capacity)
        bins = np.array(placed, np.int64).reshape(-1, 2)
        pdf = pdf.assign(bin_id=(pdf["shard"].to_numpy(np.int64) << 31) + bins[:, 0], slot=bins[:, 1])
        return pdf[["id", "piece", "start", "n_tokens", "bin_id", "slot"]]

    kind = held.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece long, start long, n_tokens long, bin_id long, slot long"
    packed = some.groupBy("shard").applyInPandas(run, schema)
    none = held.where("n_tokens <= 0").select("id", "piece", "start", "n_tokens", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("slot"))
    return packed.unionByName(none).withColumnRenamed("id", id_col)


def sequences(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed texts: ``bin_id``, ``text`` and ``n_tokens``; pieces stand in slot order, joined by a blank line."""
    text = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"))
    at = packed.where(F.col("bin_id").isNotNull()).join(text, packed[id_col] == text["id"])
    part = F.array_join(F.slice("w", (F.col("start") + 1).cast("int"), F.col("n_tokens").cast("int")), " ")
    parts = at.groupBy("bin_id").agg(F.array_sort(F.collect_list(F.struct("slot", part.alias("part")))).alias("parts"), F.sum("n_tokens").alias("n_tokens"))
    return parts.select("bin_id", F.array_join("parts.part", "\n\n").alias("text"), "n_tokens")
