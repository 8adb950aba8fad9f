"""Nearest vectors: exactly by products of blocks, and by an index of cells.

A task holds a group of known vectors and streams queries past it; their similarities are one matrix product for a block of
each, of which every query keeps its best.  The index files every vector under the nearest of some centres and compares a query
with the vectors of a few cells alone, by the same products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.joins import small
from assayer.sources.shared import Scratch

#: Vectors of a group, and queries of one product.
GROUP, TOGETHER = 65_536, 256
#: Vectors that centres are fitted on at most, rounds of fitting, and centres.
SAMPLE, ROUNDS, CENTRES = 20_000, 8, 64
_FOUND = "query long, other long, sim double"


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = np.asarray(lists.flatten()).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) and len(flat) else np.zeros((len(lists), 0))


def unit_rows(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _best(known: dict, part: pa.RecordBatch, k: int, limit: float) -> Iterator[pa.RecordBatch]:
    """The best of a group for the queries of a batch."""
    ids, groups, asked = np.asarray(part["id"]), np.asarray(part["label"]), unit_rows(_matrix(part["v"]))
    for a in range(0, len(ids), TOGETHER):
        own, label = ids[a : a + TOGETHER], groups[a : a + TOGETHER]
        sim = np.round(asked[a : a + TOGETHER] @ known["v"].T, 9)
        barred = (known["id"] == own[:, None]) | (known["label"] == label[:, None]) | (sim > limit)
        sim[barred] = -np.inf
        n = min(k, sim.shape[1])
        # All that reach the n-th best are kept until ties are settled, by the smaller id.
        least = np.partition(sim, sim.shape[1] - n, axis=1)[:, sim.shape[1] - n]
        who, at = np.nonzero((sim >= least[:, None]) & (sim > -np.inf))
        order = np.lexsort((known["id"][at], -sim[who, at], who))
        who, at = who[order], at[order]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < k
        yield pa.RecordBatch.from_arrays([pa.array(own[who[keep]]), pa.array(known["id"][at[keep]]), pa.array(sim[who[keep], at[keep]])], names=["query", "other", "sim"])


def _stream(k: int, limit: float):
    """Of each group (``g``) first its vectors, then the queries (``asks``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, known = None, [], None
        for batch in batches:
            key, asks = np.asarray(batch["g"]), batch["asks"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)]):
                if key[a] != group:
                    group, held, known = key[a], [], None
                if not asks[a]:
                    held.append(batch.slice(a, b - a))
                    continue
                if known is None and held:
                    known = {c: np.concatenate([np.asarray(h[c]) for h in held]) for c in ("id", "label")}
                    known["v"] = unit_rows(np.concatenate([_matrix(h["v"]) for h in held]))
                if known is not None:
                    yield from _best(known, batch.slice(a, b - a), k, limit)

    return run


def _rows(vectors: DataFrame, asks: Column, id: str, vector: str, label: str | None) -> DataFrame:
    """Without a label each row has a number of its own."""
    kind = F.col(label).cast("long") if label else F.monotonically_increasing_id()
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), kind.alias("label"), F.coalesce(asks, F.lit(False)).alias("asks"))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))


def _ranked(dealt: DataFrame, n: int, k: int, limit: float) -> DataFrame:
    found = dealt.repartitionByRange(n, "g").sortWithinPartitions("g", "asks").mapInArrow(_stream(k, limit), _FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "other"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def nearest(vectors: DataFrame, asks: Column, k: int = 1, id: str = "vec_id", vector: str = "embedding", label: str | None = None, limit: float = float("inf")) -> DataFrame:
    """``query``, ``rank``, ``other`` and ``sim``: the k vectors of highest cosine for each row that asks, to nine digits, ties to the smaller id.

    A row isn't its own neighbour.  With a ``label`` (an integer) neighbours have another one; those more similar than ``limit``
    don't count.  All vectors are of one length; null ones, those with null or NaN components and rows without id or label take
    no part, zero vectors are at 0 to all.  Ids are different.  Queries go to each group of vectors once.
    """
    rows = Scratch(vectors.sparkSession).write(_rows(vectors, asks, id, vector, label))
    groups = max(_partitions(vectors), -(-rows.count() // GROUP))
    held = rows.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), F.lit(False).alias("asks"), "id", "label", "v")
    asked = rows.where("asks").select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(True).alias("asks"), "id", "label", "v")
    return _ranked(held.unionByName(asked), groups, k, limit).select("query", "rank", "other", "sim")


def fit_centres(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", centres: int = CENTRES) -> np.ndarray:
    """Directions of cells, fitted on the ``SAMPLE`` vectors at most whose ids hash lowest; the driver gets these alone."""
    rows = _rows(vectors, F.lit(False), id, vector, None)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    m = unit_rows(_matrix(some["v"].combine_chunks()))
    c = m[:: max(1, len(m) // centres)][:centres]
    for _ in range(ROUNDS):
        near = (m @ c.T).argmax(axis=1)
        c = unit_rows(np.stack([m[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))]))
    return c


def _cells(centres: np.ndarray, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim = unit_rows(_matrix(batch["v"])) @ centres.T
            near = np.argsort(-sim, axis=1, kind="stable")[:, :n].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(near), pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return run


def nearest_in_cells(vectors: DataFrame, asks: Column, centres: np.ndarray, probes: int = 8, k: int = 1, id: str = "vec_id", vector: str = "embedding", label: str | None = None, limit: float = float("inf")) -> DataFrame:
    """As ``nearest``, among the vectors of the ``probes`` nearest cells alone, so neighbours in others are missed.

    Every vector is filed under one cell.  Crowded cells are split into groups of ``GROUP`` about, each of which their queries visit.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = _rows(vectors, asks, id, vector, label)
    rows = scratch.write(rows.mapInArrow(_cells(centres, probes), "id long, v array<double>, label long, asks boolean, cells array<int>"))
    # The table of cells has a row for each centre.
    sizes = rows.groupBy(F.get("cells", F.lit(0)).alias("cell")).agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    sizes = small(scratch.write(sizes))
    key = lambda part: F.col("cell").cast("long") * 1_000_000 + part
    held = rows.withColumn("cell", F.get("cells", F.lit(0))).join(sizes, "cell").select(key(F.pmod(F.xxhash64("id"), F.col("parts"))).alias("g"), F.lit(False).alias("asks"), "id", "label", "v")
    asked = rows.where("asks").withColumn("cell", F.explode("cells")).join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    asked = asked.select(key(F.col("part")).alias("g"), F.lit(True).alias("asks"), "id", "label", "v")
    return _ranked(held.unionByName(asked), _partitions(vectors), k, limit).select("query", "rank", "other", "sim")
