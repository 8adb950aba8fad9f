"""SimHash near-duplicates: fingerprints, candidates by the pigeonring principle and components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.components import components
from assayer.llm.shared import Scratch

BITS = 64
#: Keys of more fingerprints are split by finer masks before pairs are made.
CROWD = 64
_CHUNK = 1 << 16


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the shingles' hashes; no words give zero."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(*(words[k:] for k in range(width))))) if len(words) >= width else [b" ".join(words)]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), _CHUNK):
        part = shingles[at : at + _CHUNK]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(seed)), "<u8", len(part))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(shingles)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The fingerprint of each of ``rows`` texts whose shingles have these hashes: bits set in over half of them."""
    counts, total = np.zeros((rows, BITS), np.int64), np.bincount(row, minlength=rows)
    for at in range(0, len(hashes), _CHUNK):
        part, of = hashes[at : at + _CHUNK].astype("<u8"), row[at : at + _CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.concatenate([np.ones(1, bool), of[1:] != of[:-1]]))
        np.add.at(counts, of[first], np.add.reduceat(bits, first, axis=0, dtype=np.int32))
    return np.packbits((2 * counts > total[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int) -> DataFrame:
    """``id`` and ``fp`` (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            prints = np.fromiter((fingerprint(t.as_py() or b"", width, seed) for t in texts), "<u8", len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view("<i8"))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _bits(at: int, n: int) -> int:
    return ((1 << n) - 1) << at


def ring_masks(distance: int) -> list[int]:
    """The bits on which fingerprints within ``distance`` agree for at least one mask, by the pigeonring principle.

    Of the ring of four segments there is one from which on every chain of 1, 2, 3 and 4 segments differs in at most
    its share of the budget, rounded down: for two bits that is 0, 1, 1 and 2.  So the first segment agrees, and of
    the four bytes of the two segments that follow it all but one do: 40 bits.  For one bit the shares are 0, 0, 0
    and 1, and three segments agree: 48 bits.  Two agreeing segments, as the pigeonhole principle has it, are 32 bits.

    For three bits it is a ring of eight bytes: shares of 0, 0, 1, 1 and 1 for the first five, so two bytes agree and
    of the three that follow all but one do: 32 bits.
    """
    if distance == 3:
        rings = [[_bits(8 * ((first + k) % 8), 8) for k in range(5)] for first in range(8)]
        return [sum(chain) - free for chain in rings for free in chain[2:]]
    segment = BITS // 4
    masks = []
    for first in range(4):
        chain = [_bits(segment * ((first + k) % 4), segment) for k in range(3)]
        if distance == 1:
            masks.append(chain[0] | chain[1] | chain[2])
        else:
            parts = [_bits(segment * ((first + k) % 4) + 8 * half, 8) for k in (1, 2) for half in (0, 1)]
            masks += [chain[0] | sum(parts) - free for free in parts]
    return masks


def finer_masks(mask: int, distance: int) -> list[int]:
    """Masks that agree on all of ``mask`` and on all but ``distance`` of the four-bit groups of the rest.

    What they leave open is ``4 * distance`` bits, so at most 256 different fingerprints have a key in common (4,096 for three bits).
    """
    groups = [_bits(k, 4) for k in range(0, BITS, 4) if not mask >> k & 1]
    whole = _bits(0, BITS)
    return [whole - sum(free) for free in combinations(groups, distance)]


def _lit(mask: int) -> Column:
    return F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("long")


def _met(posted: DataFrame, distance: int) -> DataFrame:
    """The pairs ``a`` < ``b`` of fingerprints with a key in common that differ in at most ``distance`` bits."""
    x, y = (posted.select("kind", "key", F.col("fp").alias(c)) for c in ("a", "b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return x.join(y, ["kind", "key"]).where((F.col("a") < F.col("b")) & close).select("a", "b")


def links(prints: DataFrame, distance: int = 2, crowd: int = CROWD, finer: bool = True) -> DataFrame:
    """All pairs ``a``, ``b`` of fingerprints (column ``fp``, distinct) within ``distance`` bits; a pair may repeat.

    Fingerprints are filed under the bits of each of the ring's masks (see ``ring_masks``), so pairs are made only where
    the chain condition holds, and then pass the full Hamming check.  Where more than ``crowd`` share a key, as in a
    large group of near copies, they are filed under its finer masks instead, which bound what shares one.  Without
    ``finer`` a crowded key gives the pairs of neighbours in its order only, for callers who find the others by themselves.
    """
    if distance not in (0, 1, 2, 3):
        raise ValueError("distance must be from 0 to 3")
    if distance == 0:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    masks = ring_masks(distance)
    keys = [F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(_lit(m)).alias("key")) for k, m in enumerate(masks)]
    posted = prints.select("fp", F.explode(F.array(*keys)).alias("at")).select("fp", "at.*")
    sizes = posted.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = Scratch(prints.sparkSession).write(posted.join(sizes, ["kind", "key"]))
    few, many = _met(met.where(F.col("size") <= crowd), distance), met.where(F.col("size") > crowd)
    if not finer:
        beside = many.select(F.col("fp").alias("a"), F.lead("fp").over(Window.partitionBy("kind", "key").orderBy("fp")).alias("b"))
        return few.unionByName(beside.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    split = F.array(*(F.array(*map(_lit, finer_masks(m, distance))) for m in masks))
    crowded = many.select("fp", F.explode(F.get(split, F.col("kind"))).alias("kind")).distinct()
    crowded = crowded.withColumn("key", F.col("fp").bitwiseAND(F.col("kind")))
    return few.unionByName(_met(crowded, distance))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Fingerprints are linked at ``distance`` or fewer differing bits; ``component_id`` is the smallest id
    that is reachable, itself included.  Equal fingerprints are merged before the search, so copies cost
    nothing there.  Null, empty and blank texts have fingerprint zero and are linked like any other; a
    null id counts for no minimum; repeated rows each keep a row; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(fingerprints(docs, id_col, text_col, width, seed))
    prints = scratch.write(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(prints.select("fp"), distance)).withColumnRenamed("node", "fp")
    labelled = prints.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents whose id is the smallest of their group, with all columns; of a repeated id all rows stay."""
    groups = near_groups(docs, id_col, text_col, **how)
    kept = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__kept")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__kept"]), "left_semi")
