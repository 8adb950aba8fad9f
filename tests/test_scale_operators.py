"""Best matches, nearest vectors, weighted draws, ranks and quantiles against plain calculations."""

import hashlib
import random
import statistics

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from assayer.functions import text as X
from assayer.jobs.base import QUERIES
from assayer.jobs.similarity import hashed
from assayer.operators import best as B
from assayer.operators import ranks as R
from assayer.operators import tests as T
from assayer.operators import vectors as V


def sets(draw, n, size, alphabet):
    # Squared draws make some features frequent and most rare.
    return [sorted({int(alphabet * draw.random() ** 2) for _ in range(draw.randint(0, size))}) for _ in range(n)]


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


@pytest.mark.parametrize("seed, alphabet", [(1, 40), (2, 400), (3, 12)])
def test_best_matches(spark, seed, alphabet):
    draw = random.Random(seed)
    qs, ks = sets(draw, 60, 30, alphabet), sets(draw, 50, 30, alphabet)
    ks[7], qs[3] = ks[4], ks[4]
    q = spark.createDataFrame(list(enumerate(qs)), "q int, fs array<long>")
    k = spark.createDataFrame(list(enumerate(ks)), "k int, fs array<long>")
    want = {}
    for i, a in enumerate(qs):
        scored = [(-jaccard(a, b), j) for j, b in enumerate(ks) if set(a) & set(b)]
        if scored:
            want[i] = (min(scored)[1], -min(scored)[0])
    assert {r.q: (r.k, r.sim) for r in B.best_matches(q, k).collect()} == want
    pairs = {(r.q, r.k): r.sim for r in B.pairs_between(q, k, 0.4).collect()}
    assert pairs == {(i, j): jaccard(a, b) for i, a in enumerate(qs) for j, b in enumerate(ks) if a and b and jaccard(a, b) >= 0.4}


def test_best_matches_of_nothing(spark):
    q = spark.createDataFrame([(1, []), (2, None), (3, [5])], "q int, fs array<long>")
    k = spark.createDataFrame([(1, [6]), (2, []), (3, None)], "k int, fs array<long>")
    assert B.best_matches(q, k).count() == 0 and B.pairs_between(q, k, 0.5).count() == 0
    assert B.best_matches(q.limit(0), k).count() == 0 and B.best_matches(q, k.limit(0)).count() == 0


def test_frequent_features_are_not_joined(spark):
    """Of all the pairs of a turn and an item that share a gram, fewer are candidates under the bound."""
    t = lambda n: spark.read.parquet(f"{oracle.SF}/{n}.parquet")
    grams = X.char_grams(F.col("text"))
    q, k = hashed(t("conversations").withColumn("id", F.struct("conv_id", "turn")), "id", "q", grams), hashed(t("benchmark"), "item_id", "k", grams)
    rows = B.ordered(q, k)
    exact = B.best_matches(q, k).select("q", F.col("sim").alias("least"))
    every = B.candidates(rows, k, None).agg(F.count(F.lit(1)), F.sum("seen")).first()
    some = B.candidates(rows, k, exact).agg(F.count(F.lit(1)), F.sum("seen")).first()
    assert some[0] < every[0] and some[1] < 0.8 * every[1]


def unit(v):
    return v / np.linalg.norm(v) if np.linalg.norm(v) else v * 0


def test_nearest(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in draw.integers(-2, 3, 3)], int(draw.integers(0, 3))) for i in range(150)]
    df = spark.createDataFrame([*rows, (200, None, 1), (210, [1.0, None, 2.0], 1), (220, [float("nan"), 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    sims = {(i, j): round(float(unit(np.array(a)) @ unit(np.array(b))), 9) + 0.0 for i, a, _ in rows for j, b, _ in rows if i != j}
    labels = {i: g for i, _, g in rows}
    for label, limit, k in ((None, float("inf"), 3), ("label", 0.9, 4), ("label", -2.0, 2)):
        got = {}
        for r in V.nearest(df, F.col("vec_id") % 10 == 0, k, label=label, limit=limit).orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append((r.other, round(r.sim, 6) + 0.0))
        want = {}
        for i in range(0, 150, 10):
            some = sorted((-sims[i, j], j) for j, *_ in rows if j != i and (label is None or labels[i] != labels[j]) and sims[i, j] <= limit)[:k]
            if some:
                want[i] = [(j, round(-s, 6) + 0.0) for s, j in some]
        assert got == want
    assert V.nearest(df.limit(0), F.lit(True)).count() == 0


def test_recall_of_cells(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asks = F.col("vec_id") % 20 == 0
    exact = {r.query: r.other for r in V.nearest(e, asks).collect()}
    found = {r.query: r.other for r in V.nearest_in_cells(e, asks, V.fit_centres(e), 40).collect()}
    assert sum(found[q] == o for q, o in exact.items()) >= 0.9 * len(exact)
    every = {r.query: r.other for r in V.nearest_in_cells(e, asks, V.fit_centres(e), V.CENTRES).collect()}
    assert every == exact


def test_crowded_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(V, "GROUP", 20)
    e = spark.read.parquet(f"{oracle.SF}/embeddings.parquet")
    asks = F.col("vec_id") % 25 == 0
    exact = {(r.query, r.rank): r.other for r in V.nearest(e, asks, 3).collect()}
    assert {(r.query, r.rank): r.other for r in V.nearest_in_cells(e, asks, V.fit_centres(e, centres=4), 4, 3).collect()} == exact


def test_weights(spark):
    texts = [f"s-{k}" for k in range(4000)]
    got = {r.t: r.w for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.poisson_weight(F.col("t")).alias("w")).collect()}
    assert all(got[t] == sum(int(hashlib.md5(t.encode()).hexdigest()[:8], 16) >= c for c in T.POISSON) for t in texts)
    assert abs(statistics.mean(got.values()) - 1) < 0.05 and abs(statistics.variance(got.values()) - 1) < 0.1


def test_intervals_cover_the_mean_and_the_median(spark):
    """Of 120 samples of 80 from a normal distribution, about 95 in a hundred intervals hold its centre."""
    draw = np.random.default_rng(7)
    rows = [(g, u, float(x)) for g in range(120) for u, x in enumerate(draw.normal(3, 2, 80))]
    df = spark.createDataFrame(rows, "g int, u int, v double").repartition(8, "g")
    for statistic, least in ((None, 0.88), (T.weighted_median, 0.86)):
        ci = T.interval(T.weighted_draws(df, ["g"], ["u"], "v", 200, "c", statistic), ["g"]).collect()
        assert len(ci) == 120 and sum(r.lo <= 3 <= r.hi for r in ci) >= least * 120


@pytest.mark.parametrize("group", [["g"], []])
def test_ranks_and_quantiles(spark, group):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.choice([float(draw.randint(0, 30)), draw.random()])) for _ in range(3000)] + [("c", 1.5), ("c", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    ranks = {(r["g"] if group else 0, r.v): (r.n, r["rank"]) for r in R.mid_ranks(df, group, "v").collect()}
    parts = {}
    for g, v in rows:
        if v is not None:
            parts.setdefault(g if group else 0, []).append(v)
    for g, values in parts.items():
        for v in set(values):
            n = values.count(v)
            assert ranks.pop((g, v)) == (n, sum(x < v for x in values) + (n + 1) / 2)
    assert not ranks
    got = {r["g"] if group else 0: r for r in R.quantiles(df, group, "v", {"lo": 0.025, "mid": 0.5, "hi": 1.0}).collect()}
    want = {r["g"] if group else 0: r.q for r in df.groupBy(*group).agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.5), F.lit(1.0))).alias("q")).where("q is not null").collect()}
    assert {g: [r.lo, r.mid, r.hi] for g, r in got.items()} == {g: pytest.approx(q) for g, q in want.items()}


def test_one_group_is_many_ranges(spark):
    df = spark.range(20_000).select(F.lit("all").alias("g"), F.rand(3).alias("v"))
    assert R.cumulated(df, ["g"], "v").select(F.max("up_to")).first()[0] == 20_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = df.groupBy("g", "v").count().repartitionByRange("g", "v").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dealt == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_cells_query(spark):
    rows = QUERIES["cosine_1nn_cells"](spark, oracle.SF).collect()
    exact = {r.vec_id: r.nearest for r in QUERIES["cosine_1nn"](spark, oracle.SF).collect()}
    assert {r.vec_id for r in rows} == set(exact) and sum(exact[r.vec_id] == r.nearest for r in rows) >= 0.6 * len(rows)
