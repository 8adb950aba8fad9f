"""Formulas against published values and properties."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer.functions import stats
from assayer.operators import tests as T
from assayer.operators import windows as W


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("b,c,p", [(30, 13, 0.0137181850586785), (66, 0, 2.710505431213761e-20), (4, 0, 0.125), (0, 0, 1.0), (5, 5, 1.0)])
def test_binomial(spark, b, c, p):
    found = one(spark, stats.binomial_two_sided(F.lit(b), F.lit(c)))[0]
    assert found == pytest.approx(p, rel=1e-9)


def test_wilson(spark):
    lo, hi = one(spark, *stats.wilson(F.lit(45), F.lit(114)))
    assert (lo, hi) == pytest.approx((0.309848, 0.486489), abs=1e-6)
    assert one(spark, *stats.wilson(F.lit(0), F.lit(0)))[0] is None


@pytest.mark.parametrize("n,w,p", [(12, 44, 0.7333984375), (10, 31.5, 0.76953125), (10, 30, 0.845703125)])
def test_wilcoxon_exact(n, w, p):
    assert stats.wilcoxon_exact(n, w) == p


def test_chi_square_tail():
    assert stats.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_sf(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_sf(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-9)


def test_fisher_tea():
    assert stats.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857, abs=1e-9)


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 30), st.integers(0, 30), st.integers(0, 30), st.integers(0, 30))
def test_fisher_range(a, b, c, d):
    p = stats.fisher_exact(a, b, c, d)
    assert 0 < p <= 1 and p == pytest.approx(stats.fisher_exact(c, d, a, b))


def test_holm(spark):
    rows = [("f", k, p) for k, p in enumerate([0.01, 0.04, 0.03])] + [("g", 0, 0.2)]
    h = W.holm(spark.createDataFrame(rows, "fam string, k int, p double"), ["fam"], "p", ["k"])
    assert {(r.fam, r.k): round(r.p_holm, 6) for r in h.collect()} == {("f", 0): 0.03, ("f", 1): 0.06, ("f", 2): 0.06, ("g", 0): 0.2}


def test_holm_is_monotone_and_no_less_than_p(spark):
    rng = random.Random(4)
    rows = [(k % 7, k, rng.random()) for k in range(300)]
    found = W.holm(spark.createDataFrame(rows, "fam int, k int, p double"), ["fam"], "p", ["k"]).orderBy("fam", "p").collect()
    last = {}
    for r in found:
        assert r.p - 1e-12 <= r.p_holm <= 1 and r.p_holm >= last.get(r.fam, 0)
        last[r.fam] = r.p_holm


def test_mid_ranks(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 2, 3)], "g string, v int")
    assert [(r.v, r.rank) for r in W.mid_ranks_by_count(df, ["g"], "v").orderBy("v").collect()] == [(1, 1.0), (2, 2.5), (3, 4.0)]


def test_kappa_of_identical_raters(spark):
    from assayer.operators.aggregates import kappa_many

    df = spark.createDataFrame([(x, x) for x in "aabbbc"], "a string, b string")
    assert kappa_many(df, "a", "b").first()["kappa"] == 1.0
    same = spark.createDataFrame([("a", "a")] * 3, "a string, b string")
    assert kappa_many(same, "a", "b").first()["kappa"] == 1.0


def test_mann_whitney_by_pairs(spark):
    rng = random.Random(1)
    rows = [("g", rng.randint(0, 9), rng.random() < 0.4) for _ in range(80)]
    found = T.mann_whitney(spark.createDataFrame(rows, "g string, v int, one boolean"), ["g"], "v", F.col("one")).first()
    u = sum((a > b) + (a == b) / 2 for _, a, x in rows if x for _, b, y in rows if not y)
    assert found.u == u


def test_results_correct_within_question(spark):
    a = spark.createDataFrame([("x", 0.01), ("y", 0.04)], "comparison string, p_raw double")
    b = spark.createDataFrame([("z", 0.5), ("w", float("nan"))], "comparison string, p_raw double")
    out = T.Results().add(a, rq="1", metric="m", test="t").add(b.where("comparison = 'z'"), rq="2", metric="m", test="t").finite()
    assert {r.comparison: r.p_corrected for r in out.collect()} == {"x": 0.02, "y": 0.04, "z": 0.5}


def test_student_quantiles():
    """Published values."""
    known = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 7: 2.365, 10: 2.228, 29: 2.045, 120: 1.980}
    assert {n: round(stats.t_quantile(0.95, n), 3) for n in known} == known
    assert round(stats.t_quantile(0.99, 2), 3) == 9.925


def test_rank_sum_exact_by_all_splits():
    """All ways to split the ranks, two-sided and one-sided."""
    import itertools

    for n1, n2 in ((1, 1), (2, 3), (3, 4), (4, 4)):
        us = [sum(c) - n1 * (n1 - 1) // 2 for c in itertools.combinations(range(n1 + n2), n1)]
        assert [us.count(u) for u in range(n1 * n2 + 1)] == stats.mann_whitney_ways(n1, n2)
        for u in range(n1 * n2 + 1):
            assert stats.mann_whitney_p(u, n1, n2, greater=True) == pytest.approx(sum(x >= u for x in us) / len(us))
            assert stats.mann_whitney_p(u, n1, n2) == pytest.approx(min(1, 2 * sum(x >= max(u, n1 * n2 - u) for x in us) / len(us)))


def test_signed_rank_one_sided_by_all_signs():
    import itertools

    for n in (1, 3, 5):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 2 + 1):
            assert stats.wilcoxon_exact(n, w, True) == pytest.approx(sum(x >= w for x in sums) / len(sums))
    assert stats.wilcoxon_normal(60, 60 * 61 / 4, greater=True) == pytest.approx(0.5)


def test_exact_binomial_of_many_discordants(spark):
    """The recurrence gives the plain sums, also where powers of two underflow."""
    from math import comb

    from pyspark.sql import functions as F

    cases = [(0, 0), (4, 0), (0, 4), (5, 5), (3, 11), (600, 700), (2000, 2100)]
    df = spark.createDataFrame(cases, "b long, c long").select("b", "c", stats.binomial_two_sided(F.col("b"), F.col("c")).alias("p"))
    for r in df.collect():
        n, m = r.b + r.c, min(r.b, r.c)
        plain = 1.0 if r.b == r.c else min(1.0, 2 * sum(comb(n, k) for k in range(m + 1)) / 2**n)
        assert r.p == pytest.approx(plain, rel=1e-9)
