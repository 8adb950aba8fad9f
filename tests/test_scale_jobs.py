"""What jobs must not do on larger tables: send rows that grow with the tables to the driver, or shuffle texts."""

import difflib
import random

import oracle
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer.functions import diff as D
from assayer.jobs import answers, detectors, repair, reports
from assayer.jobs.base import Tables
from assayer.operators import best as B
from assayer.operators import edits as E
from assayer.operators import judge as J
from assayer.operators import retrieve as R
from assayer.sources.shared import Scratch


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plans(monkeypatch, call) -> list[str]:
    """The plans of all tables that a call writes, and of what it returns."""
    seen, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df: (seen.append(plan(df)), write(self, df))[1])
    return [*seen, plan(call())]


@pytest.mark.parametrize("make", [repair._judged_runs, repair._measured, reports.facts, reports.port_facts, lambda t: reports.facts(t, "validated")])
def test_runs_meet_candidates_without_a_broadcast(spark, monkeypatch, make):
    """Candidates are made of few narrow rows, which Spark's estimate takes them for."""
    assert not any("Broadcast" in p for p in plans(monkeypatch, lambda: make(Tables(spark, oracle.SF))))


@pytest.mark.parametrize("make", [repair.judged, repair.dissected, repair._lines_of, reports.candidate_facts, lambda t: J.judge(repair.bad_candidates(t)), lambda t: J.judge(repair.ports(t), "target", "f", "v")])
def test_texts_are_not_shuffled(spark, make):
    """Only the items are dealt out, before they have texts."""
    text = plan(make(Tables(spark, oracle.SF)))
    assert "Join" not in text and text.count("Exchange") == 1, text


def test_sizes_are_those_of_the_delta(spark):
    draw = random.Random(5)
    pool = ["a = b;", "a = c;", "b", "", "return x;", "return  y;", "- a", "+ b", "if (a) b", "if (a) c"]
    for _ in range(2000):
        a = [draw.choice(pool) for _ in range(draw.randint(0, 9))]
        b = [draw.choice(pool) if draw.random() < 0.3 else s for s in a] + [draw.choice(pool) for _ in range(draw.randint(0, 2))]
        want = sum(s.startswith(("+ ", "- ")) for s in difflib.ndiff(a, b))
        assert D.edit_size("\n".join(a), "\n".join(b)) == want or "" in (a[-1:] + b[-1:])
    long = ["x", "y"] * 150
    assert D.edit_size("\n".join(long), "\n".join(long[1:] + ["z"])) == sum(s.startswith(("+ ", "- ")) for s in difflib.ndiff(long, long[1:] + ["z"]))


def test_equal_pairs_in_one_batch(spark):
    rows = [("a\nb", "a\nc", k) for k in range(40)] + [(None, "a", 40), ("a", None, 41)]
    got = E.with_script(spark.createDataFrame(rows, "a string, b string, k int"), "a", "b", "s").select("k", "s.size").collect()
    assert sorted((r.k, r.size) for r in got) == [(k, 2) for k in range(40)] + [(40, 1), (41, 1)]


def _postings(spark):
    draw = random.Random(3)
    rows = [(k, k % 5 == 0, f"t{draw.randrange(12)}") for k in range(60) for _ in range(6)]
    return detectors.sides(R.weights(spark.createDataFrame(rows, "key int, asked boolean, term string"), "asked", "key", 48))


def test_pairs_are_scored_without_rows_for_their_terms(spark):
    assert "Join" not in plan(R.best(*_postings(spark)))


def test_places_are_tried_until_enough_may_be_answers(spark, monkeypatch):
    """Nothing of the first places may be an answer, so later ones are asked."""
    monkeypatch.setattr(R, "TRIED", 2)
    q, k = _postings(spark)
    every = R.best(q, k, 48).collect()
    got = R.best(q, k, 2, lambda pairs: pairs.where("k % 7 = 1")).collect()
    want = {x: [(r.k, r.sim) for r in sorted(every, key=lambda r: r["rank"]) if r.q == x and r.k % 7 == 1][:2] for x in {r.q for r in every}}
    assert {x: [(r.k, r.sim) for r in sorted(got, key=lambda r: r["rank"]) if r.q == x] for x in want} == want


def test_many_features_are_not_broadcast(spark, monkeypatch):
    """A few known sets of many features each, as documents are, are joined where they lie."""
    rows = [(k, list(range(k, k + 900))) for k in range(20)]
    sets = spark.createDataFrame(rows, "q int, fs array<long>")
    monkeypatch.setattr(B, "MOST_SENT", 5_000)
    found = B.pairs_between(sets.where("q < 3"), sets.withColumnRenamed("q", "k"), 0.99)
    assert "ks" not in "".join(p for p in plan(found).splitlines() if "BroadcastExchange" in p) and plan(found).count("SortMergeJoin") == 2
    assert {(r.q, r.k) for r in found.collect()} == {(q, k) for q in range(3) for k in range(20) if abs(q - k) <= 4}


def test_parts_by_pattern_are_those_by_steps(spark):
    draw = random.Random(9)
    texts = ["".join(draw.choice("ab ,,{}1") for _ in range(draw.randint(0, 14))) for _ in range(400)] + ["", "a", ",", "a{b,{c,d},e},f", "a{b{c{d,e}}},f", "x,\n y", "a\x01,b", "a," * 200, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", answers.split_top(F.col("t")).alias("a"), answers._stepwise(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)
    assert {r.t: r.a for r in rows}["a{b,{c,d},e},f"] == ["a{b,{c,d},e}", "f"]


def test_mean_of_best_cosines():
    a, b = [1.0, 0.0, 0.0, 0.0, 0.0, 3.0, 0.0, 4.0], [2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    got = list(detectors.mean_best.func(pd.Series([a, a, [0.0] * 4]), pd.Series([b, a, a])))
    assert got[:2] == pytest.approx([0.9, 1.0]) and got[2] != got[2]
