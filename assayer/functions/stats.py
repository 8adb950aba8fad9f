"""Statistical formulas as column expressions, and exact null distributions as small helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k out of n; null for n = 0."""
    k, n = _d(k), _d(n)
    p = F.try_divide(k, n)
    centre = p + F.try_divide(_d(z * z), 2 * n)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(_d(z * z), 4 * n * n))
    scale = 1 + F.try_divide(_d(z * z), n)
    low, high = F.greatest((centre - half) / scale, _d(0)), F.least((centre + half) / scale, _d(1))
    return F.when(n > 0, low), F.when(n > 0, high)


def log_choose_half(n: Column, k: Column) -> Column:
    """log of C(n, k) / 2^n by a sum of logarithms, so that no factorial overflows."""
    upto = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(upto, _d(0), lambda acc, i: acc + F.log(_d(n - k + i)) - F.log(_d(i))) - _d(n) * math.log(2)


def binomial_two_sided(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c at one half (McNemar's exact test); 1 for none.

    The largest term of the tail comes from logarithms, each smaller one from the term before it.
    """
    n, m = (b + c).cast("long"), F.least(b, c).cast("long")
    start = F.exp(log_choose_half(n, m))
    down = F.when(m > 0, F.sequence(m, F.lit(1).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * k / (n - k + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    tail = F.aggregate(down, F.struct(start.alias("term"), start.alias("total")), step)["total"]
    return F.when((n == 0) | (b == c), _d(1)).otherwise(F.least(_d(1), 2 * tail))


def t_share(t: float, nu: int) -> float:
    """The probability that Student's t with ``nu`` degrees of freedom lies within plus or minus ``t``."""
    angle = math.atan(t / math.sqrt(nu))
    sine, square = math.sin(angle), math.cos(angle) ** 2
    term, total = 1.0, 0.0
    for k in range(1 + nu % 2, nu, 2):  # odd numbers for even degrees, and the other way round
        total += term
        term *= square * k / (k + 1)
    if nu % 2 == 0:
        return sine * total
    return 2 / math.pi * (angle + (sine * math.cos(angle) * total if nu > 1 else 0.0))


def t_quantile(share: float, nu: int) -> float:
    """The bound within which that share of Student's t lies, by bisection."""
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_share(middle, nu) < share else (low, middle)
    return (low + high) / 2


def mcc(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    """Matthews correlation; 0 where a row or column of the table is empty."""
    tp, fp, tn, fn = map(_d, (tp, fp, tn, fn))
    return F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), _d(0))


def kappa(agree: Column, expected: Column, degenerate: float = 1.0) -> Column:
    """Cohen's kappa of observed and expected agreement; ``degenerate`` where the expected is 1."""
    return F.coalesce(F.try_divide(agree - expected, 1 - expected), _d(degenerate))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, each 0 where undefined."""
    tp, fp, fn = map(_d, (tp, fp, fn))
    zero = _d(0)
    return (
        F.coalesce(F.try_divide(tp, tp + fp), zero),
        F.coalesce(F.try_divide(tp, tp + fn), zero),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero),
    )


def cohens_h(p: Column, q: Column) -> Column:
    return 2 * F.asin(F.sqrt(p)) - 2 * F.asin(F.sqrt(q))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Odds ratio of a 2x2 table with a half added to each cell."""
    a, b, c, d = (_d(x) + 0.5 for x in (a, b, c, d))
    return (a * d) / (b * c)


# Exact and asymptotic null distributions, for one test at a time (a row or a group of a pandas function).


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution, by the finite series of its even and odd degrees."""
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        term = total = math.exp(-x / 2)
        for k in range(1, df // 2):
            term *= x / 2 / k
            total += term
        return min(1.0, total)
    total, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, (df - 1) // 2 + 1):
        total += term
        term *= x / (2 * k + 1)
    return min(1.0, total)


def wilcoxon_exact(n: int, w: float, greater: bool = False) -> float:
    """p of the signed-rank sum under the tie-free null; half ranks round to the centre.

    Two-sided by the smaller sum, or that of a sum of positive ranks as large as ``w`` or larger.
    """
    if n == 0:
        return 1.0
    ways = [1] + [0] * (n * (n + 1) // 2)
    for r in range(1, n + 1):
        for s in range(len(ways) - 1, r - 1, -1):
            ways[s] += ways[s - r]
    if greater:
        return min(1.0, sum(ways[math.floor(w) :]) / 2**n)
    low = min(w, n * (n + 1) / 2 - w)
    return min(1.0, 2 * sum(ways[: math.ceil(low) + 1]) / 2**n)


def normal_upper(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def wilcoxon_normal(n: int, w: float, ties: float = 0.0, correction: bool = False, greater: bool = False) -> float:
    """p by the normal approximation; ``ties`` is the sum of t^3 - t over tied groups."""
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    if var <= 0:
        return 1.0
    shift = 0.5 if correction else 0.0
    if greater:
        return normal_upper((w - mean - shift) / math.sqrt(var))
    return normal_two_sided(max(abs(w - mean) - shift, 0.0) / math.sqrt(var))


def mann_whitney_ways(n1: int, n2: int) -> list[int]:
    """In how many ways two samples without ties can have each U, from 0 to n1 * n2."""
    ways = [1] + [0] * (n1 * n2)
    for k in range(1, n1 + 1):
        for u in range(len(ways) - 1, n2 + k - 1, -1):
            ways[u] -= ways[u - n2 - k]
        for u in range(k, len(ways)):
            ways[u] += ways[u - k]
    return ways


def mann_whitney_p(u: float, n1: int, n2: int, ties: float = 0.0, greater: bool = False) -> float:
    """p of the rank-sum test; two-sided, or that the first sample is greater.

    Exact without ties where a sample has eight values or fewer (and the other so few that n1 * n2 is 10,000 at most,
    beyond which the difference is lost), else normal with continuity and tie correction.
    """
    n = n1 + n2
    if not n1 or not n2 or n < 2:
        return 1.0
    if not ties and min(n1, n2) <= 8 and n1 * n2 <= 10_000:
        ways = mann_whitney_ways(n1, n2)
        top = u if greater else max(u, n1 * n2 - u)
        return min(1.0, (1 if greater else 2) * sum(ways[math.ceil(top) :]) / sum(ways))
    var = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    if greater:
        return normal_upper((u - n1 * n2 / 2 - 0.5) / math.sqrt(var))
    return min(1.0, normal_two_sided(max(abs(u - n1 * n2 / 2) - 0.5, 0.0) / math.sqrt(var)))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2x2 table: all tables with its margins that are no likelier."""
    n, row, col = a + b + c + d, a + b, a + c
    if not n:
        return 1.0

    def logp(x: int) -> float:
        return _lchoose(col, x) + _lchoose(n - col, row - x) - _lchoose(n, row)

    seen = logp(a)
    low, high = max(0, row + col - n), min(row, col)
    return min(1.0, sum(math.exp(logp(x)) for x in range(low, high + 1) if logp(x) <= seen + 1e-7))


def _lchoose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
