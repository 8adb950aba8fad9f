"""SimHash within the pipeline's near-dedup stage: three bits by the ring, links that are checked, and links beyond the budget."""

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
import test_llm_operators as base
import test_near_copies as near

from assayer.llm import near_copies, simhash


def test_three_bits_agree_on_a_mask():
    masks = simhash.ring_masks(3)
    assert len(set(masks)) == 24 and {bin(m).count("1") for m in masks} == {32}
    finer = {m: simhash.finer_masks(m, 3) for m in masks}
    rng = random.Random(4)
    for at in [*combinations(range(0, 64, 3), 3), *(tuple(rng.sample(range(64), 3)) for _ in range(3000))]:
        x = sum(1 << k for k in at)
        through = [m for m in masks if not x & m]
        assert through and all(any(not x & f for f in finer[m]) for m in through)


@pytest.mark.parametrize("crowd", [2, 1000])
def test_links_of_three_bits_by_brute_force(spark, crowd):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {rng.getrandbits(64) for _ in range(40)} | {centre ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for _ in range(60)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = {(a, b) for a, b in combinations(signed, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert {(r.a, r.b) for r in simhash.links(df, 3, crowd).collect()} == want
    some = {(r.a, r.b) for r in simhash.links(df, 3, crowd, finer=False).collect()}
    assert some <= want and (some == want or crowd == 2)


def test_majority_of_many_texts():
    rng = np.random.default_rng(6)
    row = np.sort(rng.choice([0, 1, 3, 4], 70_000)) if simhash._CHUNK < 70_000 else np.zeros(0, int)
    hashes = rng.integers(0, 1 << 63, len(row), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, len(row), dtype=np.uint64)
    got = simhash.majority(hashes, row, 5)
    for k in range(5):
        own = hashes[row == k]
        assert int(got[k]) == sum(1 << b for b in range(64) if 2 * int(((own >> np.uint64(b)) & np.uint64(1)).sum()) > len(own))
    assert len(row) and got[2] == 0


def test_stage_goes_through_simhash(spark, monkeypatch):
    """The stage's first links are those of the fingerprints; the groups are whole whatever these find."""
    texts, seen = near.planted(), []

    def watched(prints, *how, **more):
        found = simhash_links(prints, *how, **more)
        seen.append({(r.a, r.b) for r in found.collect()})
        return found

    simhash_links = simhash.links
    monkeypatch.setattr(simhash, "links", watched)
    want = sorted(set(near.groups(texts).values()))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, base.docs(spark, texts), "").collect()) == want
    assert len(seen) == 1 and seen[0] and all(bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for a, b in seen[0])


@pytest.mark.parametrize("budget", [0, 3])
def test_groups_are_whole_beyond_the_budget(spark, monkeypatch, budget):
    """Near copies in more bits than the budget, and fingerprints within it whose texts aren't similar."""
    monkeypatch.setattr(near_copies.print_pairs, "__defaults__", (budget,))
    texts = near.planted() + ["a b c d e f g", "a b c d e f g a b", "a b c d e f g x", *(f"{k} {k} {k} {k} {k} {k}" for k in range(4))]
    got = {r.doc_id: r.component_id for r in near_copies.near_groups(base.docs(spark, texts)).collect()}
    assert got == near.groups(texts)
