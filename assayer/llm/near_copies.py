"""Near copies of documents: SimHash links that are checked exactly, an exact join of shingle sets for the rest, and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import line_dedup, simhash, vec
from assayer.llm.components import components
from assayer.llm.shared import Scratch

WIDTH, SIMILARITY = 5, 0.8
#: Fingerprints are of so many words in a row, repeats included, and link at so many differing bits.
PRINT_WIDTH, DISTANCE = 2, 3
#: Rows are hashed together up to so many bytes, whose arrays stay in cache.
PIECE = 1 << 18
#: Longs of the parity bitmap that bounds how many shingles differ.
SIGNATURE = 8
_CODE_BITS, _LOW = line_dedup._CODE_BITS, line_dedup._LOW
_TABLE = vec.byte_class("all but blanks")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _words(chunk: vec.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word."""
    w = vec.words(chunk, _TABLE)
    return w.row, vec.Hasher(w.low)(w.starts, w.ends)


def _runs(rows: int, word_row: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of every run of ``width`` words, by row; a text of fewer words is one run."""
    count = np.bincount(word_row, minlength=rows)
    first = np.cumsum(count) - count
    found, codes = [], []
    for n in range(1, width + 1):
        if n < width:
            at = first[count == n]
        else:
            at = np.arange(max(0, len(h) - width + 1))
            at = at[word_row[at] == word_row[at + width - 1]]
        code = h[at]
        for k in range(1, n):
            code = vec.mix(code * _ODD + h[at + k])
        found.append(word_row[at])
        codes.append(code)
    row, code = np.concatenate(found), np.concatenate(codes)
    by = np.argsort(row, kind="stable")
    return row[by], code[by]


def _shingles(chunk: vec.Chunk, width: int, words: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and 44-bit code of the different shingles of every row, in order."""
    row, code = _runs(chunk.rows, *(words or _words(chunk)), width)
    code = code >> np.uint64(64 - _CODE_BITS)
    by = np.lexsort((code, row))
    row, code = row[by], code[by]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[new], code[new]


def _keys(chunk: vec.Chunk, row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit key of every row's set; sets without a shingle have key zero."""
    n = np.bincount(row, minlength=chunk.rows)
    some = np.flatnonzero(n)
    key = np.zeros(chunk.rows, np.uint64)
    if len(some):
        key[some] = vec.mix(np.add.reduceat(vec.mix(code + np.uint64(1)), (np.cumsum(n) - n)[some]))
    return n, key.view(np.int64)


def _prints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``id``, ``key1``, ``n``, parity bitmap ``sig`` and fingerprint ``fp`` of every row (``line`` 0), and the counts of codes (``line`` -1)."""
    rows, kind = line_dedup._scan(docs, id_col, text_col)
    names = ["id", "line", "key1", "key2", "n", "sig", "fp"]
    size = 1 << line_dedup.COUNT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, of_id = np.zeros(size, np.int64), None
        for batch in batches:
            of_id = batch.column(0).type
            for chunk in vec.chunks(batch.column(1), PIECE):
                words = _words(chunk)
                row, code = _shingles(chunk, width, words)
                n, key = _keys(chunk, row, code)
                of_run, run_hash = _runs(chunk.rows, *words, PRINT_WIDTH)
                fp = simhash.majority(run_hash, of_run, chunk.rows).view("<i8")
                count += np.bincount((code >> _LOW).astype(np.int64), minlength=size)
                bits = SIGNATURE * 64
                flat = (vec.mix(code + np.uint64(77)) & np.uint64(bits - 1)).astype(np.int64)
                odd = np.bincount(row * bits + flat, minlength=chunk.rows * bits) & 1
                longs = np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")
                sig = pa.ListArray.from_arrays(pa.array(np.arange(chunk.rows + 1, dtype=np.int32) * SIGNATURE), pa.array(longs))
                ids = batch.column(0).slice(chunk.first, chunk.rows)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.zeros(chunk.rows, np.int32)), pa.array(key), pa.array(key), pa.array(n.astype(np.int32)), sig, pa.array(fp)], names)
        some = np.flatnonzero(count)
        if of_id is not None:
            k = len(some)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, of_id), pa.array(np.full(k, -1, np.int32)), pa.array(some), pa.array(count[some]), pa.nulls(k, pa.int32()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.int64())], names)

    return rows.mapInArrow(run, f"id {kind}, line int, key1 long, key2 long, n int, sig array<long>, fp long")


def _postings(docs: DataFrame, id_col: str, text_col: str, width: int, rank: np.ndarray, t: float) -> DataFrame:
    """The rarest shingles of every set, as many as a pair must share one of: ``word``, ``key``, ``n``, ``place``."""
    rows, _ = line_dedup._scan(docs, id_col, text_col)
    names = ["word", "key", "n", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for chunk in vec.chunks(batch.column(1), PIECE):
                row, code = _shingles(chunk, width)
                n, key = _keys(chunk, row, code)
                # A set that repeats within the task is posted once.
                fresh = np.zeros(chunk.rows, bool)
                fresh[np.unique(key, return_index=True)[1]] = True
                fresh &= ~np.isin(key, seen)
                seen = np.concatenate([seen, key[fresh]])
                code = (rank[code >> _LOW] << _LOW) | (code & np.uint64((1 << int(_LOW)) - 1))
                code = code[np.lexsort((code, row))]
                place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                use = fresh[row] & (place <= (n - line_dedup._ceil(t * n))[row])
                row = row[use]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code[use].view(np.int64)), pa.array(key[row]), pa.array(n[row].astype(np.int32)), pa.array(place[use].astype(np.int32))], names
                )

    return rows.mapInArrow(run, "word long, key long, n int, place int")


def _sets(docs: DataFrame, keys: DataFrame, prints: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``key`` and all ``codes`` of the sets that are named by ``keys``; only texts of marked ids are cut into shingles."""
    low = (1 << line_dedup.MARK_BITS) - 1
    rows = docs.select(F.xxhash64(id_col).alias("home"), F.col(text_col).cast("string").alias("text"))
    packed = np.packbits(line_dedup._marked(keys.select(F.col("key").alias("key1"))))
    packed_homes = np.packbits(line_dedup._marked(prints.join(keys, "key", "left_semi").select(F.xxhash64("least").alias("key1"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, homes = np.unpackbits(packed).astype(bool), np.unpackbits(packed_homes).astype(bool)
        for batch in batches:
            texts = batch.column(1).filter(pa.array(homes[batch.column(0).to_numpy() & low]))
            for chunk in vec.chunks(texts, PIECE):
                row, code = _shingles(chunk, width)
                n, key = _keys(chunk, row, code)
                one = np.zeros(chunk.rows, bool)
                one[np.unique(key, return_index=True)[1]] = True
                one &= wanted[key & low]
                ends = np.append(0, np.cumsum(n[one])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(code[one[row]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(key[one]), lists], ["key", "codes"])

    found = rows.mapInArrow(run, "key long, codes array<long>").join(keys, "key", "left_semi")
    return Scratch(docs.sparkSession).write(found.dropDuplicates(["key"]))


def _possible(n: Column, place: Column, m: Column, other: Column, t: float) -> Column:
    """Whether sets of sizes n and m, whose first common shingle lies no later than at these places, can be similar."""
    need = F.ceil((n + m) * F.lit(t / (1 + t)) - 1e-9)
    return (F.least(n, m) >= F.greatest(n, m) * F.lit(t) - 1e-9) & (n - place >= need) & (m - other >= need)


def similar_pairs(docs: DataFrame, pairs: DataFrame, prints: DataFrame, id_col: str, text_col: str, width: int, t: float) -> DataFrame:
    """The pairs ``a``, ``b`` of keys whose whole sets have a Jaccard similarity of ``t`` or more."""
    scratch = Scratch(docs.sparkSession)
    x, y = (prints.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("sig").alias(f"s_{k}")) for k in ("a", "b"))
    differ = F.aggregate(F.zip_with("s_a", "s_b", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda acc, v: acc + v)
    total = F.col("n_a") + F.col("n_b")
    close = scratch.write(pairs.join(x, "a").join(y, "b").where(differ * (1 + t) <= total * F.lit(1 - t) + 1e-6).select("a", "b"))
    sets = _sets(docs, close.select(F.explode(F.array("a", "b")).alias("key")).distinct(), prints, id_col, text_col, width)
    x, y = (sets.select(F.col("key").alias(k), F.col("codes").alias(f"c_{k}")) for k in ("a", "b"))
    both = close.join(x.hint("merge"), "a").join(y.hint("merge"), "b")
    common = F.size(F.array_intersect("c_a", "c_b"))
    return scratch.write(both.where(common >= (F.size("c_a") + F.size("c_b") - common) * F.lit(t) - 1e-9).select("a", "b"))


def print_pairs(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``a`` < ``b`` of keys that SimHash links: fingerprints within ``distance`` bits by the ring's keys.

    Sets with one fingerprint are linked to the smallest key among them, which stands for them in the other pairs.
    """
    some = prints.where("n > 0")
    heads = Scratch(prints.sparkSession).write(some.groupBy("fp").agg(F.min("key").alias("head")))
    same = some.join(heads, "fp").where("key <> head").select(F.col("head").alias("x"), F.col("key").alias("y"))
    x, y = (heads.select(F.col("fp").alias(f), F.col("head").alias(k)) for f, k in (("a", "x"), ("b", "y")))
    linked = simhash.links(heads.select("fp"), distance, finer=False).distinct().join(x, "a").join(y, "b").select("x", "y")
    return same.unionByName(linked).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: id and ``component_id``, the smallest id that is reachable over similar pairs.

    Documents are linked when their sets of ``width`` words in a row (between ASCII blanks, A-Z lower-cased)
    have a Jaccard similarity of ``similarity`` or more.  Equal sets are merged first.  SimHash fingerprints within three
    bits, found by the pigeonring's keys, make the first pairs, which are checked by their whole sets.

    Similar sets may differ in more bits, so an exact join adds the links that no bit budget finds, and none is missed:
    sets post their rarest shingles, as many as similar sets must share one of, and meet there under the length and
    position filters.  Sets that are in one group already aren't compared again.  The others first meet their neighbour
    by size at each shingle, which joins nearly all groups; what is left to compare are pairs of different groups, so a crowd of near copies isn't
    squared: at each shingle the members of its largest group meet those of other groups only.

    Texts without words are copies of each other.  Shingles are 44-bit codes and sets have 64-bit keys.
    """
    if not 0.5 <= similarity <= 1:
        raise ValueError("similarity must be from 0.5 to 1")
    t, scratch = similarity, Scratch(docs.sparkSession)
    found = scratch.write(_prints(docs, id_col, text_col, width))
    rank, _ = line_dedup._ranks(found)
    rows = found.where("line = 0").select("id", F.col("key1").alias("key"), "n", "sig", "fp")
    same = (F.first(c).alias(c) for c in ("n", "sig", "fp"))
    prints = scratch.write(rows.groupBy("key").agg(F.min("id").alias("least"), *same))
    how = (prints, id_col, text_col, width, t)
    hashed = similar_pairs(docs, print_pairs(prints), *how)
    early = scratch.write(components(hashed))

    # Copies post the same rows, so a task's are merged before and the rest after the shuffle, which serves the ring too.
    posted = _postings(docs, id_col, text_col, width, rank, t).repartition("word").distinct()
    ring = Window.partitionBy("word").orderBy("n", "key")
    beside = posted.select("*", F.lead(F.struct("key", "n", "place")).over(ring).alias("next"), F.lag("key").over(ring).alias("prior"))
    met = scratch.write(beside.where("next is not null or prior is not null"))
    near = met.where(_possible(F.col("n"), F.col("place"), F.col("next.n"), F.col("next.place"), t))
    pairs = near.select(F.least("key", "next.key").alias("a"), F.greatest("key", "next.key").alias("b")).distinct()
    for c in ("a", "b"):
        pairs = pairs.join(early.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    pairs = pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    edges = hashed.unionByName(similar_pairs(docs, pairs, *how))
    roots = components(edges).select(F.col("node").alias("key"), "root")

    grouped = scratch.write(met.join(roots, "key", "left").select("word", "key", "n", "place", F.coalesce("root", "key").alias("root")))
    sizes = grouped.groupBy("word", "root").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("word").agg(F.max_by("root", F.struct("size", "root")).alias("top"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    open_ = scratch.write(grouped.join(mixed.select("word", "top"), "word"))
    x = open_.where("root <> top").drop("top")
    y = open_.select("word", *(F.col(c).alias(f"{c}_b") for c in ("key", "n", "place", "root")))
    across = x.join(y, "word").where("root <> root_b").where(_possible(F.col("n"), F.col("place"), F.col("n_b"), F.col("place_b"), t))
    rest = across.select(F.least("key", "key_b").alias("a"), F.greatest("key", "key_b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    more = similar_pairs(docs, rest, *how)
    if not more.isEmpty():
        roots = components(edges.unionByName(more)).select(F.col("node").alias("key"), "root")

    labelled = prints.select("key", "least").join(roots, "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(least, "root").select("key", "component_id")
    return rows.join(named, "key").select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents whose id is the smallest of their group, with all columns."""
    groups = near_groups(docs, id_col, text_col, **how)
    kept = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__kept")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__kept"]), "left_semi")
