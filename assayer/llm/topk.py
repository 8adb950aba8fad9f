"""Exact search for the best partners of vectors, term at a time over postings.

Components are terms.  A task holds a block of rows as postings: for each term the rows in which it isn't zero, with
their weights.  A sparse query row goes through its own terms and adds weight times weights to a dense array of scores,
one for each row of the block; the best of a block are found by partition selection, and the blocks' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.shared import Scratch

#: Rows of a block and queries that are scored together: the array of their scores stays in a core's cache.
BLOCK, TOGETHER = 4096, 32
#: Rows that a group holds about; a task holds one group of them and streams the queries past it.
GROUP = 131_072
_LONG = (1 << 63) - 1


def quantised(vector: Column) -> Column:
    """``floor(256 x)`` of each component, as a double that holds an integer.

    Null for vectors that are null or hold null or non-finite components; beyond 7e305 the product isn't finite either.
    """
    x = F.transform(vector, lambda v: v.cast("double") * 256.0)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.when(F.abs(v) < float(1 << 52), F.floor(v).cast("double")).otherwise(v))
    return F.when(vector.isNotNull() & fine, whole)


class Postings:
    """The rows of one block by term: which of them hold it, and with what weight.  Rows stand in the order of their ids."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, weights: np.ndarray):
        order = np.lexsort((rows, ids))
        self.ids, self.rows, weights = ids[order], rows[order], weights[order]
        self.by_row = np.argsort(self.rows)
        held = [np.flatnonzero(weights[:, t]) for t in range(weights.shape[1])]
        # A term that over half of the rows hold has a weight for every row, zeros too: adding in order beats scattering.
        held = [np.arange(len(ids)) if 2 * len(at) > len(ids) else at for at in held]
        self.wide = weights.dtype == object
        self.most = int(np.abs(weights).sum(axis=1).max(initial=0))
        self.narrow = not self.wide and self.most < 1 << 31
        self.terms = [(at, weights[at, t].astype(np.int32) if self.narrow else weights[at, t]) for t, at in enumerate(held)]

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """A dense row of scores for each query: its terms, one after another, are scattered over their postings."""
        out = np.zeros((len(queries), len(self.ids)), queries.dtype)
        part = np.empty_like(out)
        for t in range(min(queries.shape[1], len(self.terms))):
            at, weights = self.terms[t]
            asked = np.flatnonzero(queries[:, t])
            if len(at) == out.shape[1] and 2 * len(asked) > len(out):
                out += np.multiply.outer(queries[:, t], weights, out=part)
            elif len(at) and len(asked):
                out[np.ix_(asked, at)] += np.multiply.outer(queries[asked, t], weights)
        return out

    def best(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of each query's best rows and their scores, and which of these places are filled; its own row is left out.

        Score and place are one number, so that of equal scores the smaller id is selected.
        """
        n = len(self.ids)
        reach = int(np.abs(queries).max(initial=0)) * self.most
        wide = self.wide or reach * n >= 1 << 61
        none = -(1 << 200) if wide else np.iinfo(np.int64).min
        scores = self.scores(queries.astype(object if wide else np.int32 if self.narrow and reach < 1 << 31 else np.int64))
        scores = np.minimum(np.maximum(scores, -_LONG - 1), _LONG) if wide else scores.astype(np.int64)
        key = scores * n + (n - 1 - np.arange(n))
        place = self.by_row[np.minimum(np.searchsorted(self.rows, own, sorter=self.by_row), n - 1)]
        hit = self.rows[place] == own
        key[np.flatnonzero(hit), place[hit]] = none
        k = min(k, n)
        top = (np.sort(key, axis=1) if key.dtype == object else np.partition(key, n - k, axis=1))[:, n - k :]
        ids = self.ids[(n - 1 - top % n).astype(np.int64)]
        return np.where(top == none, -1, ids), top // n, top != none


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors as rows, padded with zeros: 64-bit integers where they fit, else Python's."""
    sizes = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten())
    values = flat.astype(np.int64) if np.abs(flat).max(initial=0) < 1 << 52 else np.array([int(v) for v in flat], object)
    out = np.zeros((len(lists), int(sizes.max(initial=0))), values.dtype)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _answers(blocks: list[Postings], part: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    """The best of a group's blocks for some queries, merged."""
    rows, ids = np.asarray(part["row"]), np.asarray(part["id"])
    for a in range(0, len(rows), TOGETHER):
        own, q = rows[a : a + TOGETHER], _matrix(part["w"].slice(a, TOGETHER))
        each = [b.best(q, own, k) for b in blocks]
        if not each:
            return
        who = np.concatenate([np.nonzero(filled)[0] for _, _, filled in each])
        vec, score = (np.concatenate([e[j][e[2]].astype(np.int64) for e in each]) for j in (0, 1))
        order = np.lexsort((vec, ~score, who))
        first = np.searchsorted(who[order], np.arange(len(own)))
        keep = order[np.arange(len(order)) - first[who[order]] < k]
        yield pa.RecordBatch.from_arrays([pa.array(own[who[keep]]), pa.array(ids[a + who[keep]]), pa.array(vec[keep]), pa.array(score[keep])], names=["query", "query_id", "vec_id", "score"])


def _search(k: int):
    """Streams one partition: of each group first its rows, then the queries (``asks``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, blocks, held = None, [], []

        def seal(least: int) -> None:
            if held and sum(map(len, held)) >= least:
                ids, rows = (np.concatenate([np.asarray(h[c]) for h in held]) for c in ("id", "row"))
                blocks.append(Postings(ids, rows, _matrix(pa.concat_arrays([h["w"] for h in held]))))
                held.clear()

        for batch in batches:
            key, asks = np.asarray(batch["g"]), batch["asks"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)]):
                if key[a] != group:
                    group, blocks, held = key[a], [], []
                if asks[a]:
                    seal(1)
                    yield from _answers(blocks, batch.slice(a, b - a), k)
                    continue
                for c in range(a, b, BLOCK):
                    held.append(batch.slice(c, min(BLOCK, b - c)))
                    seal(BLOCK)

    return run


def search(vectors: DataFrame, asks: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the k best partners of each row that asks.

    Every row but the query's own is a candidate, and the score is the integer inner product of the quantised vectors,
    the missing end of a shorter one counting as zeros.  Ties go to the smaller id.  Rows whose id is null, and vectors
    that are null or hold null or non-finite components, take no part; an empty vector scores zero.  Rows that repeat an id
    are rows of their own: each can be found, and each that asks gets its own ranks under their common id.  Scores beyond a
    64-bit integer are summed exactly and count as its largest or smallest value.  An empty table has no rows.

    Queries are sent to each group of rows once and stream past it; a task's memory holds its group alone.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).cast("long").alias("id"), quantised(F.col(vector)).alias("w"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = Scratch(spark).write(rows.where("id is not null and w is not null").withColumn("row", F.monotonically_increasing_id()))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // GROUP))
    held = rows.select(F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("g"), F.lit(False).alias("asks"), "id", "row", "w")
    asked = rows.where("asks").select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(True).alias("asks"), "id", "row", "w")
    dealt = held.unionByName(asked).repartitionByRange(groups, "g").sortWithinPartitions("g", "asks")
    found = dealt.mapInArrow(_search(k), "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
