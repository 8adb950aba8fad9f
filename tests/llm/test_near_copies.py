"""The pipeline's near-dedup stage against brute force over shingle sets."""

import random

import corpus_pipeline
import test_llm_operators as base

from assayer.llm import near_copies


def shingle_set(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def groups(texts, t=0.8):
    sets = [shingle_set(x) for x in texts]
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9]
    return base.union(pairs, range(len(sets)))


def planted():
    """Edited copies around the threshold, a chain, a crowd of near copies, a shared passage, odd texts."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = [None, "", " \n", "one two", "One  two", "one"]
    passage = " ".join(word() for _ in range(60))
    texts += [f"{' '.join(word() for _ in range(rng.randint(5, 40)))} {passage}" for _ in range(30)]
    for _ in range(40):
        words = [word() for _ in range(rng.randint(12, 150))]
        for _ in range(3):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randint(1, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = word()
    crowd = [word() for _ in range(80)]
    for _ in range(60):
        own = list(crowd)
        own[rng.randrange(80)] = word()
        texts.append(" ".join(own))
    rng.shuffle(texts)
    return texts


def test_near_groups_by_brute_force(spark):
    texts = planted()
    got = {r.doc_id: r.component_id for r in near_copies.near_groups(base.docs(spark, texts)).collect()}
    assert got == groups(texts)


def test_stage_drops_near_copies_beyond_two_bits(spark):
    texts = planted()
    expected = groups(texts)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, base.docs(spark, texts), "").collect())
    assert got == sorted(set(expected.values())) and 0 < len(got) < len(texts)


def test_odd_ids(spark):
    rows = spark.createDataFrame(base.ROWS, base.SCHEMA)
    kept = near_copies.keep_one(rows)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == {1, 2, 5, None}
    assert near_copies.keep_one(rows.limit(0)).count() == 0
