"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import vec

#: Labelled rows that training gathers at most (in expectation, by a hash of the id).
MAX_TRAIN_ROWS = 12_000
#: Hashed terms; the machine has a weight and factors for at most MAX_TERMS of those whose own rates differ most,
#: and as many that tell the labels apart beside another term.
BUCKETS = 1 << 22
MAX_TERMS = 512
MIN_Z, MIN_ROWS = 4.0, 4
FACTORS = 6
#: Pairs of terms count from this deviance on, beyond any chance among millions of pairs.  They are searched for in as
#: many rows of each label, PAIR_BLOCK terms at a time, where SUSPECT deviations are enough, and counted in all rows.
MIN_DEVIANCE, PAIR_ROWS, PAIR_BLOCK, SUSPECT = 36.0, 500, 512, 2.0
#: Pairs that are counted, and rows that are unpacked, at a time; tasks of the search.
PAIR_CHUNK, PAIR_CHUNK_ROWS, PAIR_TASKS = 4_000, 1024, 64
THRESHOLD = 0.7
#: Besides whole words, terms are their first so many bytes, for inflected forms.
STEMS = (5, 6, 7)
_TABLE = vec.byte_class("letters")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _terms(chunk: vec.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed term of every word and stem of a chunk, with repeats."""
    w = vec.words(chunk, _TABLE)
    hasher = vec.Hasher(w.low)
    rows, terms = [w.row], [hasher(w.starts, w.ends)]
    length = w.ends - w.starts
    for n in STEMS:
        long = np.flatnonzero(length > n)
        rows.append(w.row[long])
        terms.append(hasher(w.starts[long], w.starts[long] + n) ^ np.uint64(n))
    return np.concatenate(rows), (np.concatenate(terms) & np.uint64(BUCKETS - 1)).astype(np.int32)


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + sum over term pairs of the product of their factors)."""

    bias: float
    terms: np.ndarray  # of int32, the hashed terms that count
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Of rows of zeros and ones, which are their own squares."""
        s = x @ self.factors
        return self.bias + x @ self.weights + 0.5 * ((s * s).sum(1) - x @ (self.factors * self.factors).sum(1))

    def slots(self) -> np.ndarray:
        table = np.full(BUCKETS, -1, np.int16)
        table[self.terms] = np.arange(len(self.terms))
        return table

    def score(self, chunk: vec.Chunk, slots: np.ndarray) -> np.ndarray:
        row, term = _terms(chunk)
        slot = slots[term]
        known = np.flatnonzero(slot >= 0)
        m = max(1, len(self.terms))
        pair = np.unique(row[known].astype(np.int64) * m + slot[known])
        row, slot = pair // m, pair % m
        n = chunk.rows
        raw = self.bias + np.bincount(row, self.weights[slot], n)
        for k in range(self.factors.shape[1]):
            v = self.factors[slot, k]
            s = np.bincount(row, v, n)
            raw += 0.5 * (s * s - np.bincount(row, v * v, n))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class PairSearch:
    """Candidate terms and, packed eight training rows to a byte, the rows that hold each.

    The first ``drawn`` rows are a sample of both labels, where a pair must look odd before it is counted in all rows.
    """

    terms: np.ndarray
    known: np.ndarray  # of bool: terms that the machine has anyway
    odds: np.ndarray
    bits: np.ndarray
    toxic: np.ndarray
    drawn: int
    drawn_toxic: np.ndarray
    base: float

    def blocks(self) -> list[tuple[int, int]]:
        starts = range(0, len(self.terms), PAIR_BLOCK)
        return [(i, j) for i in starts for j in starts if i <= j]

    def best(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the terms of two blocks that are not known, those in a pair that counts, and the best deviance of each."""

        def part(k: int) -> np.ndarray:
            return np.unpackbits(self.bits[k : k + PAIR_BLOCK, : (self.drawn + 7) // 8], axis=1)[:, : self.drawn].astype(np.float32)

        share = self.drawn_toxic.mean()
        middle = np.float32(_logit(share))
        left, right = part(i), part(j)
        t, m = (left * self.drawn_toxic.astype(np.float32)) @ right.T, left @ right.T
        a, b = np.divmod(np.flatnonzero(m >= MIN_ROWS), m.shape[1])
        m, t = m[a, b], t[a, b]
        a, b = a + i, b + j
        # The pair's rate must lie beyond those of its terms and of their sum.
        odds = self.odds.astype(np.float32)
        x, y = odds[a], odds[b]
        most = _sigmoid(np.maximum(np.maximum(x, y), x + y) + middle)
        least = _sigmoid(np.minimum(np.minimum(x, y), x + y) + middle)
        odd = (t - m * most >= SUSPECT * np.sqrt(m * most * (1 - most))) | (m * least - t >= SUSPECT * np.sqrt(m * least * (1 - least)))
        odd &= (a < b) & ~(self.known[a] & self.known[b])
        a, b = a[odd], b[odd]
        found = np.zeros(len(self.terms))
        for k in range(0, len(a), PAIR_CHUNK):
            x, y = a[k : k + PAIR_CHUNK], b[k : k + PAIR_CHUNK]
            both = self.bits[x] & self.bits[y]
            count = np.bitwise_count(both).sum(1, dtype=np.int64)
            bad = np.bitwise_count(both & self.toxic).sum(1, dtype=np.int64)
            r = bad / count
            u, v = self.odds[x], self.odds[y]
            most, least = (_sigmoid(f(f(u, v), u + v) + _logit(self.base)) for f in (np.maximum, np.minimum))
            e = np.where(r > most, most, least)
            with np.errstate(divide="ignore", invalid="ignore"):
                d = 2 * (np.where(bad > 0, bad * np.log(r / e), 0) + np.where(bad < count, (count - bad) * np.log((1 - r) / (1 - e)), 0))
            good = (d >= MIN_DEVIANCE) & ((r > most) | (r < least))
            for side in (x[good], y[good]):
                np.maximum.at(found, side, d[good])
        some = np.flatnonzero((found > 0) & ~self.known)
        return some, found[some]


def _counts(rows: list[np.ndarray], which: np.ndarray) -> np.ndarray:
    """How many of the rows hold each hashed term."""
    out = np.zeros(BUCKETS, np.int32)
    for k in range(0, len(which), PAIR_CHUNK_ROWS):
        np.add.at(out, np.concatenate([rows[i] for i in which[k : k + PAIR_CHUNK_ROWS]]), 1)
    return out


def _design(rows: list[np.ndarray], which: np.ndarray, terms: np.ndarray, slot: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of rows: where each starts and which terms (across) its rows (down) hold."""
    for k in range(0, len(which), PAIR_CHUNK_ROWS):
        some = [rows[i] for i in which[k : k + PAIR_CHUNK_ROWS]]
        at = slot[np.concatenate(some)]
        of = np.repeat(np.arange(len(some)), [len(r) for r in some])
        dense = np.zeros((len(some), len(terms)), bool)
        dense[of[at >= 0], at[at >= 0]] = True
        yield k, dense


def _slots(terms: np.ndarray) -> np.ndarray:
    slot = np.full(BUCKETS, -1, np.int32)
    slot[terms] = np.arange(len(terms))
    return slot


def _pair_search(rows: list[np.ndarray], labels: np.ndarray, hit: np.ndarray, all_rows: np.ndarray, have: np.ndarray, seed: int) -> PairSearch:
    """What a search for terms needs whose co-occurrence with some term separates the labels more than their own rates do."""
    rng, n, pos = np.random.default_rng(seed), len(labels), int(labels.sum())
    base = pos / n
    # A pair of that deviance stands in so many rows of one label at least; a term of a marginal partner needs fewer.
    few = [int(MIN_DEVIANCE / (2 * np.log(1 / share))) for share in (base, 1 - base)]
    some = np.concatenate([rng.permutation(np.flatnonzero(labels == k))[:PAIR_ROWS] for k in (1, 0)])
    order = np.concatenate([some, np.setdiff1d(np.arange(n), some)])
    known = np.zeros(BUCKETS, bool)
    known[have] = True
    drawn = _counts(rows, some) >= MIN_ROWS
    terms = np.flatnonzero(drawn & ((hit >= few[0]) | (all_rows - hit >= min(few[1], few[0] * 4)) | known))
    bits = np.zeros((len(terms), (n + 7) // 8), np.uint8)
    for k, dense in _design(rows, order, terms, _slots(terms)):
        packed = np.packbits(dense, axis=0).T if len(terms) else np.zeros((0, (len(dense) + 7) // 8), np.uint8)
        bits[:, k // 8 : k // 8 + packed.shape[1]] = packed
    toxic = labels[order] == 1
    odds = _logit((hit[terms] + base) / (all_rows[terms] + 1)) - _logit(base)
    return PairSearch(terms, known[terms], odds, bits, np.packbits(toxic), len(some), toxic[: len(some)], base)


def _here(search: PairSearch) -> list[tuple[np.ndarray, np.ndarray]]:
    return [search.best(i, j) for i, j in search.blocks()]


def _spread(spark: SparkSession) -> Callable[[PairSearch], list[tuple[np.ndarray, np.ndarray]]]:
    """The blocks of a search as tasks of Spark; each returns at most a row for every term of its two blocks."""

    def run_all(search: PairSearch) -> list[tuple[np.ndarray, np.ndarray]]:
        blocks = search.blocks()
        sent = spark.sparkContext.broadcast(search)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    some, deviance = sent.value.best(*blocks[k])
                    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(deviance)], ["at", "deviance"])

        best = spark.range(0, len(blocks), 1, min(len(blocks), PAIR_TASKS) or 1).mapInArrow(run, "at long, deviance double")
        got = best.groupBy("at").agg(F.max("deviance").alias("deviance")).toPandas()
        sent.destroy()
        return [(got["at"].to_numpy(np.int64), got["deviance"].to_numpy(np.float64))]

    return run_all


def _pair_terms(search: PairSearch, run: Callable[[PairSearch], list[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
    best = np.zeros(len(search.terms))
    for some, deviance in run(search):
        np.maximum.at(best, some, deviance)
    order = np.argsort(-best, kind="stable")
    return search.terms[order[best[order] > 0]]


def fit(
    rows: list[np.ndarray], labels: np.ndarray, rounds: int = 250, rate: float = 0.05, decay: float = 2e-4, seed: int = 7,
    run: Callable[[PairSearch], list[tuple[np.ndarray, np.ndarray]]] = _here,
) -> Machine:
    """Fits the machine by full-batch Adam on the logistic loss; without both labels only a bias remains.

    ``run`` does the blocks of the search for pairs of terms, here or elsewhere.
    """
    n, pos = len(labels), int(labels.sum())
    empty = np.zeros(0, np.int32)
    if not 0 < pos < n:
        return Machine(float(np.log((pos + 1) / (n - pos + 1))), empty, np.zeros(0), np.zeros((0, FACTORS)))
    all_rows, hit = _counts(rows, np.arange(n)), _counts(rows, np.flatnonzero(labels == 1))
    some = np.flatnonzero(all_rows >= MIN_ROWS)
    p1, p0, p = hit[some] / pos, (all_rows[some] - hit[some]) / (n - pos), all_rows[some] / n
    z = (p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / pos + 1 / (n - pos)))
    some, z = some[np.abs(z) >= MIN_Z], z[np.abs(z) >= MIN_Z]
    terms = some[np.argsort(-np.abs(z), kind="stable")[:MAX_TERMS]]
    paired = _pair_terms(_pair_search(rows, labels, hit, all_rows, terms, seed), run)[:MAX_TERMS]
    terms = np.sort(np.concatenate([terms, paired])).astype(np.int32)
    del all_rows, hit  # a number for each bucket, no longer needed beside the design
    x = np.zeros((n, len(terms)), np.float32)
    for k, dense in _design(rows, np.arange(n), terms, _slots(terms)):
        x[k : k + len(dense)] = dense
    rng = np.random.default_rng(seed)
    machine = Machine(float(np.log(pos / (n - pos))), terms, np.zeros(len(terms), np.float32), rng.normal(0, 0.02, (len(terms), FACTORS)).astype(np.float32))
    y = labels.astype(np.float32)
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in (np.zeros(1), machine.weights, machine.factors)]
    for t in range(1, rounds + 1):
        g = (1 / (1 + np.exp(-np.clip(machine.raw(x), -30, 30))) - y).astype(np.float32) / n
        s = x @ machine.factors
        grads = (
            np.array([g.sum()]),
            x.T @ g + decay * machine.weights,
            x.T @ (g[:, None] * s) - (x.T @ g)[:, None] * machine.factors + decay * 5 * machine.factors,
        )
        steps = []
        for (m, v), grad in zip(moments, grads):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            steps.append(rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8))
        machine.bias -= float(steps[0][0])
        machine.weights -= steps[1].astype(np.float32)
        machine.factors -= steps[2].astype(np.float32)
    return machine


def _in_order(got: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """Terms and labels in the order of the ids; the terms are views, since a sorted table would be a second copy in the driver."""
    order = pc.sort_indices(got["id"]).to_numpy()
    terms = [np.frombuffer(t.as_buffer(), np.int32) for t in got["terms"]]
    return [terms[k] for k in order], got["label"].to_numpy().astype(np.int64)[order]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_TRAIN_ROWS) -> Machine:
    """Fits on labelled rows that are not held out.

    A hash of the id picks about ``max_rows`` of them, so that what the driver gathers is bounded; these
    ids, as bounded, are broadcast to the documents.  Labels of null are left out; of repeated labels of
    an id the largest counts, of repeated documents of an id one.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit("train"), F.col("id").cast("string")), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select("id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for chunk in vec.chunks(batch.column(1)):
                row, term = _terms(chunk)
                pair = np.unique(row.astype(np.int64) * BUCKETS + term)
                cuts = np.searchsorted(pair, np.arange(1, chunk.rows) * BUCKETS)
                out += [x.tobytes() for x in np.split((pair % BUCKETS).astype(np.int32), cuts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(out, pa.binary()), batch.column(2)], ["id", "terms", "label"])

    # Of a repeated id one row counts, so the bound on ids is one on rows.
    one = few.mapInArrow(run, "id string, terms binary, label int").groupBy("id").agg(F.min("terms").alias("terms"), F.max("label").alias("label"))
    terms, got = _in_order(one.toArrow())
    return fit(terms, got, run=_spread(docs.sparkSession))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, ``score`` and the columns ``keep`` of every row, in one pass without a shuffle.

    Null and empty texts get the score of a text without terms; repeated rows each keep a row.
    """
    names = ["id", "score", *(f"keep_{k}" for k in range(len(keep)))]
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), *(F.col(c).alias(n) for c, n in zip(keep, names[2:])))
    types = [rows.schema["id"].dataType.simpleString(), "double", *(rows.schema[n].dataType.simpleString() for n in names[2:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = machine.slots()
        for batch in batches:
            scores = [machine.score(chunk, slots) for chunk in vec.chunks(batch.column(0))]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(scores), *batch.columns[2:]], names)

    scored = rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, types)))
    return scored.select(F.col("id").alias(id_col), "score", *(F.col(n).alias(c) for c, n in zip(keep, names[2:])))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all columns."""
    rest = tuple(c for c in docs.columns if c != id_col)
    scored = score(docs, train(docs, labels, id_col, text_col), id_col, text_col, rest)
    return scored.where(F.col("score") < threshold).select(docs.columns)
