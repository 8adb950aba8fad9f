"""Pairs of terms that say nothing alone are learned with the production parameters."""

import numpy as np
import pyarrow as pa

from assayer.llm import toxicity


def test_machine_learns_a_pair_with_production_values():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (2000, 2))
    y = (x[:, 0] ^ x[:, 1] ^ 1).astype(np.int64)
    rows = [np.array([10 + k for k in range(2) if r[k]] + [50 + k for k in range(2) if not r[k]], np.int32) for r in x]
    machine = toxicity.fit(rows, y)
    design = np.array([[1.0 if t in r else 0.0 for t in machine.terms] for r in rows])
    assert ((machine.raw(design) > 0) == (y == 1)).mean() > 0.95


def test_score_is_the_plain_double_sum():
    import itertools

    import pyarrow as pa

    from assayer.llm import vec

    rng = np.random.default_rng(1)
    texts = ["You are a Fool and a fool", "", None, "kind people", "é fool people " * 20, "12 !!"]
    (chunk,) = vec.chunks(pa.array(texts))
    row, term = toxicity._terms(chunk)
    terms = np.unique(term)[::2].astype(np.int32)
    machine = toxicity.Machine(-0.3, terms, rng.normal(0, 1, len(terms)), rng.normal(0, 0.3, (len(terms), toxicity.FACTORS)))
    got = machine.score(chunk, machine.slots())
    for k in range(len(texts)):
        have = [i for i, t in enumerate(terms) if t in set(term[row == k].tolist())]
        raw = machine.bias + sum(machine.weights[i] for i in have)
        raw += sum(machine.factors[i] @ machine.factors[j] for i, j in itertools.combinations(have, 2))
        assert abs(got[k] - 1 / (1 + np.exp(-raw))) < 1e-9


def test_search_in_tasks_is_the_search_here(spark):
    rng = np.random.default_rng(2)
    rows = [np.unique(np.append(rng.integers(10, 700, 250), [t for t in (3, 5) if rng.random() < 0.5])).astype(np.int32) for _ in range(400)]
    labels = np.array([int((3 in r) == (5 in r)) for r in rows])
    search = toxicity._pair_search(rows, labels, toxicity._counts(rows, np.flatnonzero(labels)), toxicity._counts(rows, np.arange(400)), np.zeros(0, int), 7)
    here = toxicity._pair_terms(search, toxicity._here)
    assert len(search.blocks()) > 1 and {3, 5} <= set(here.tolist())
    assert toxicity._pair_terms(search, toxicity._spread(spark)).tolist() == here.tolist()


def test_gathered_rows_are_ordered_without_a_copy():
    """The driver holds the gathered terms once: their arrays are views of what was gathered."""
    parts = [pa.table({"id": ["7", "10"], "terms": pa.array([b"\1\0\0\0\2\0\0\0", b""], pa.binary()), "label": pa.array([1, 0], pa.int32())}), pa.table({"id": ["2"], "terms": pa.array([b"\3\0\0\0"], pa.binary()), "label": pa.array([1], pa.int32())})]
    before = pa.total_allocated_bytes()
    big = pa.table({"id": [str(k) for k in range(40)], "terms": pa.array([bytes(400_000)] * 40, pa.binary()), "label": pa.array([0] * 40, pa.int32())})
    size = pa.total_allocated_bytes() - before
    held, _ = toxicity._in_order(big)
    assert pa.total_allocated_bytes() - before < 1.1 * size and sum(x.nbytes for x in held) == 16_000_000
    terms, labels = toxicity._in_order(pa.concat_tables(parts))
    assert [x.tolist() for x in terms] == [[], [3], [1, 2]] and labels.tolist() == [0, 1, 1]
