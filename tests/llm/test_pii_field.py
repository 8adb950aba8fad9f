"""The skip-chain field: beliefs against exhaustive sums, what it adds, and what it must leave alone."""

import itertools
import random

import numpy as np
import pytest
import test_llm_operators as base

from assayer.llm import pii


def exhaustive(graph, model):
    """Marginals by summing over all labellings."""
    n = len(graph.doc)
    total = np.zeros((n, pii.K))
    for labels in itertools.product(range(pii.K), repeat=n):
        if any(g >= 0 and g != y for g, y in zip(graph.label, labels)):
            continue
        e = sum(model.unary[f, y] for fs, y in zip(graph.features, labels) for f in fs)
        e += sum(model.chain[g, labels[a], labels[b]] for (a, b), g in zip(graph.chain, graph.gap))
        e += sum(model.skip for a, b in graph.skip if labels[a] == labels[b])
        for k, y in enumerate(labels):
            total[k, y] += np.exp(e)
    return total / total.sum(1, keepdims=True)


@pytest.mark.parametrize("loop", [False, True])
def test_beliefs_by_exhaustive_sums(loop):
    """Exact on trees; close to it on a loop."""
    rng = np.random.default_rng(3)
    for _ in range(10):
        model = pii.Field(rng.normal(0, 1, (pii.N_FEATURES, pii.K)), rng.normal(0, 0.5, (pii.GAPS, pii.K, pii.K)), 1.0)
        g = pii.Graph([0] * 5, list(range(5)), list(range(1, 6)), [-1, 2, -1, -1, -1], [[int(x) for x in rng.integers(0, pii.N_FEATURES, 3)] for _ in range(5)])
        g.gap = [0, 3, 8]
        g.chain, g.skip = [(0, 1), (1, 2), (3, 4)], [(2, 4)] + ([(0, 4)] if loop else [])
        assert np.exp(pii.beliefs(g, model)) == pytest.approx(exhaustive(g, model), abs=0.05 if loop else 1e-3)


def phone(rng):
    return f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"


def card(rng, good=True):
    while True:
        d = str(rng.randrange(10**15, 10**16))
        if pii.luhn(d) == good:
            return d


def corpus():
    rng = random.Random(5)
    words = ["and", "item", "the", "of", "here", "two", "no", "at", "room"]
    texts = []
    for k in range(240):
        parts = [phone(rng), card(rng), f"{rng.randrange(9)}.5", f"a{k}@b.com", f"10.{k}.1.7", card(rng, False), str(rng.randrange(10, 99999))]
        rng.shuffle(parts)
        texts.append(" ".join(f"{rng.choice(words)} {p}" for p in parts))
    return rng, texts


def added(spark, texts, at=0):
    d = base.docs(spark, texts)
    rows = pii.find(d, pii.train(d)).collect()
    return {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans if s not in r.base] for r in rows if r.doc_id >= at}


def test_joined_neighbours_are_added_and_near_misses_are_not(spark):
    rng, texts = corpus()
    at = len(texts)
    good, bad, ip, tel = card(rng), card(rng, False), "170.106.47.218", phone(rng)
    texts += [f"here {bad} {good} ends", f"here {tel} {ip} ends", f"two {bad} {bad} ends", f"no {bad} ends", "a 12 34 56 78 b", "at 2024.11.27 or 1.2.3 it"]
    got = added(spark, texts, at)
    assert got[at] == [("card", good)] and got[at + 1] == [("phone", tel)]
    assert [got[at + k] for k in (2, 3, 4, 5)] == [[]] * 4
    assert all(not v for k, v in got.items() if k < at)


def test_thirty_repeats_of_a_number(spark):
    rng, texts = corpus()
    at = len(texts)
    texts.append("Call +1 (162) 555-6820 now. " + " ".join(("words " * 20 + "or 1 162 555-6820 at night,") for _ in range(30)))
    assert added(spark, texts, at)[at] == [("phone", "1 162 555-6820")] * 30


def test_same_rows_in_other_batches_and_partitions(spark):
    _, texts = corpus()
    texts += ["Call +1 (162) 555-6820 or 1 162 555-6820", "7536784127813050 4845168114407329"] * 3
    d = base.docs(spark, texts)
    model = pii.train(d)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    found = []
    try:
        for size, parts in (("10000", 1), ("3", 4), ("1", 7)):
            spark.conf.set(key, size)
            found.append(sorted(map(str, pii.find(d.repartition(parts), model).collect())))
            again = pii.train(d.repartition(parts))
            assert np.array_equal(again.unary, model.unary) and again.skip == model.skip
    finally:
        spark.conf.set(key, before)
    assert found[0] == found[1] == found[2]


def test_repeated_rows_only_raise_a_count(spark):
    _, texts = corpus()
    d = base.docs(spark, texts[:40])
    assert pii.train(d.union(d)).unary == pytest.approx(pii.train(d).unary, abs=1e-3)


def planted():
    """Texts to learn from, and documents with a repeat of a known number, a number beside a known one, or numbers of neither kind.

    Returns the texts, and of each planted one the spans that a reader would add.
    """
    rng, texts = corpus()
    bare = lambda p: p[1:].replace("(", "").replace(")", "")
    texts += [f"Call {phone(rng)} or {phone(rng)} for room {rng.randrange(90)} of {rng.randrange(10, 99)}." for _ in range(150)]
    want = {}
    for k in range(30):
        own, other = phone(rng), phone(rng)
        texts.append(f"Call {own} at noon. " + "words " * 30 + f"then {bare(own)} here; item {bare(other)} is stock.")
        want[len(texts) - 1] = [("phone", bare(own))]
        texts.append(f"Call {own} or {bare(other)} today; " + "words " * 30 + f"item {rng.randrange(10**6, 10**7)} is stock.")
        want[len(texts) - 1] = [("phone", bare(other))]
        texts.append(f"item {bare(own)} of {rng.randrange(10**9, 10**10)} and {card(rng, False)} is stock.")
        want[len(texts) - 1] = []
    return texts, want


def test_links_and_neighbours_decide(spark):
    """Repeats are found by the links alone, and the chain keeps numbers of neither kind from being taken for one."""
    texts, want = planted()
    d = base.docs(spark, texts)
    m = pii.train(d.where(f"doc_id < {min(want)}"))
    found = {}
    for name, model in (("all", m), ("no skip", pii.Field(m.unary, m.chain, 0.0)), ("no chain", pii.Field(m.unary, 0 * m.chain, m.skip))):
        got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans if s not in r.base] for r in pii.find(d, model).collect() if r.doc_id in want}
        right = {k for k in want if want[k] and set(want[k]) <= set(got[k])}
        wrong = sum(len([s for s in got[k] if s not in want[k]]) for k in want)
        repeats = {k for k in right if "then" in texts[k]}
        found[name] = (len(repeats), len(right - repeats), wrong)
    # (repeats, neighbours, wrong spans)
    assert found["all"] == (30, 30, 0)
    assert found["no skip"][0] == 0 and found["no chain"][2] > 0
