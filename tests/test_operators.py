"""Operators against plain Python on small inputs."""

import random

from pyspark.sql import functions as F

from assayer.functions import diff as D
from assayer.functions import text as X
from assayer.operators import graphs, joins, ladder, sampling, sets, setsim
from assayer.operators import windows as W


def test_kth_match_equals_the_greedy_loop(spark):
    rng = random.Random(3)
    left = [(rng.randint(0, 5), k) for k in range(60)]
    right = [(rng.randint(0, 5), k) for k in range(50)]
    used, expected = set(), []
    for key, a in left:
        hit = next((b for k, b in right if k == key and b not in used), None)
        if hit is not None:
            used.add(hit)
            expected.append((key, a, hit))
    met = joins.kth_match(spark.createDataFrame(left, "key int, a int"), spark.createDataFrame(right, "key int, b int"), ["key"], ["a"], ["b"])
    assert sorted((r.key, r.a, r.b) for r in met.collect()) == sorted(expected)


def test_band_join(spark):
    rng = random.Random(5)
    a = [(k % 3, rng.randint(-20, 20)) for k in range(40)]
    b = [(k % 3, rng.randint(-20, 20)) for k in range(40)]
    met = joins.band_join(spark.createDataFrame(a, "k int, a int"), spark.createDataFrame(b, "k int, b int"), ["k"], "a", "b", 3)
    assert sorted((r.k, r.a, r.b) for r in met.collect()) == sorted((k, x, y) for k, x in a for j, y in b if k == j and abs(x - y) <= 3)


def test_near_pairs_by_brute_force(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    texts += [t + " z" for t in texts[:20]] + texts[:5] + ["", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    parts = F.array_distinct(F.split("text", " "))
    got = {(r.a, r.b) for r in setsim.near_pairs(setsim.features(df, "id", parts), "id", 0.8).collect()}
    classes = {}
    for k, t in enumerate(texts):
        classes.setdefault(frozenset(t.split(" ")), []).append(k)
    expected = {(c[0], k) for c in classes.values() for k in c[1:]}
    reps = [(s, c[0]) for s, c in classes.items()]
    expected |= {(min(x, y), max(x, y)) for s, x in reps for u, y in reps if x != y and len(s & u) >= 0.8 * len(s | u)}
    assert got == expected


def test_first_wins_and_top_k(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "k string, i int, v string")
    assert {r.k: r.v for r in W.first_wins(df, ["k"], ["i"]).collect()} == {"a": "y", "b": "z"}
    assert W.first_wins(df.limit(0), ["k"], ["i"]).count() == 0


def test_multiset_difference_is_empty_only_for_equal(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,)], "x int")
    assert sorted((r.x, r.n) for r in sets.multiset_difference(a, b, ["x"]).collect()) == [(1, 1), (2, 1)]
    assert sets.multiset_difference(a, a, ["x"]).count() == 0


def test_quota(spark):
    df = spark.createDataFrame([(k, k < 5) for k in range(100)], "k int, unseen boolean")
    got = sampling.quota(df, "unseen", ["k"], 20, "s").groupBy("unseen").count().collect()
    assert {r.unseen: r["count"] for r in got} == {True: 5, False: 15}


def test_closure(spark):
    """Links at one depth are followed to their end; a later way that is less deep counts."""
    chain = [(k, k + 1, 0) for k in range(1, 9)] + [(9, 1, 0), (9, 20, 1), (20, 21, 1), (21, 22, 1), (1, 22, 1), (22, 23, 1), (23, 24, 0)]
    edges = spark.createDataFrame(chain, "src int, dst int, cost int")
    got = {(r.start, r.node): r.depth for r in graphs.closure(spark.createDataFrame([(1,), (23,)], "start int"), edges, 2).collect()}
    want = {(1, k): 0 for k in range(1, 10)} | {(1, 20): 1, (1, 21): 2, (1, 22): 1, (1, 23): 2, (1, 24): 2, (23, 23): 0, (23, 24): 0}
    assert got == want


def test_replay(spark):
    rows = [("u", k, k == 3) for k in range(1, 8)] + [("v", k, k == 7) for k in range(1, 8)]
    df = spark.createDataFrame(rows, "unit string, attempt int, ok boolean")
    got = {r.unit: (r.validated, r.iterations) for r in ladder.replay(df, ["unit"], "attempt", F.col("ok"), F.lit("r")).collect()}
    assert got == {"u": (True, 3), "v": (False, 5)}


def test_shingles_and_grams(spark):
    df = spark.createDataFrame([("a b c d e f",), ("a b",), ("",), (None,)], "t string")
    got = [(r[0], r[1]) for r in df.select(X.shingles(F.col("t")), X.char_grams(F.col("t"))).collect()]
    assert got[0] == (["a b c d e", "b c d e f"], ["abcd", "bcde", "cdef"])
    assert got[1] == (["a b"], []) and got[2] == ([], [])


def test_balance_and_lines(spark):
    df = spark.createDataFrame([("f(a(b))",), (")(",), ("",)], "t string")
    got = [tuple(r[0]) for r in df.select(X.balance(F.col("t"))).collect()]
    assert got == [(0, 0), (0, -1), (0, 0)]
    assert spark.range(1).select(X.lines(F.lit("a\nb\n"))).first()[0] == ["a", "b"]


def test_edit_size():
    assert D.edit_size("a\nb", "a\nc\nd") == 3 and D.edit_size("x\nx\ny", "x\ny") == 1


def test_apply_patch():
    assert D.apply_patch("a\nb\nc", "a\nx\nc", "q\nb\nc") == (True, "q\nx\nc")
    assert D.apply_patch("a\nb\nc", "a\nx\nc", "q\nz") == (False, None)
    # The first match counts, and blanks around lines do not.
    assert D.apply_patch("a\nb\nc", "a\nx\nc", "q\n  b\nz\nb") == (True, "q\nx\nz\nb")
    # An insertion follows the line before it; at the start it has no context.
    assert D.apply_patch("a\nb", "a\nn\nb", "a\nq\nb") == (True, "a\nn\nq\nb")
    assert D.apply_patch("a\nb", "n\na\nb", "a\nb") == (False, None)
    # A second place is looked for after the first.
    assert D.apply_patch("a\nb\nc\nd", "x\nb\nc\ny", "d\na\nk\nd") == (True, "d\nx\nk\ny")
    assert D.apply_patch("a\nb\nc\nd", "x\nb\nc\ny", "d\na\nk") == (False, None)


def test_functions_of():
    code = "int f(int a) { if (a) { return 1; } return 0; }\nvoid g() { }\nint h(int"
    assert [n for n, _ in D.functions_of(code)] == ["f", "g"]
