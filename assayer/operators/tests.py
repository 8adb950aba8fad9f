"""Statistical tests over DataFrames: the data are reduced to counts by Spark, the exact null is a small helper."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import stats
from assayer.functions.text import let
from assayer.operators.ranks import mid_ranks
from assayer.operators.sampling import counter
from assayer.operators.windows import holm, mid_ranks_by_count


def signed_ranks(diffs: DataFrame, group: list[str], diff: str, zeros: str = "drop") -> DataFrame:
    """``n`` differences, W+ and W-, the sum of t^3 - t over ties, how many are ``better`` and ``worse``, and ``r``.

    ``r`` is the rank-biserial of the sums, ``sign_r`` that of the signs.  Zeros are dropped before the ranking, or
    with "keep" take part in it and in ``n``, and count for neither side.
    """
    rows = diffs.where(F.col(diff).isNotNull() if zeros == "keep" else F.col(diff) != 0)
    signs = rows.select(*group, F.abs(diff).alias("size"), (F.col(diff) > 0).cast("int").alias("up"), (F.col(diff) < 0).cast("int").alias("down"))
    sides = signs.groupBy(*group, "size").agg(F.sum("up").alias("ups"), F.sum("down").alias("downs"))
    ranked = mid_ranks_by_count(signs, group, "size").join(sides, [*group, "size"])
    out = ranked.groupBy(*group).agg(
        F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("ups")).alias("w_plus"), F.sum(F.col("rank") * F.col("downs")).alias("w_minus"),
        F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).cast("double").alias("ties"), F.sum("ups").alias("better"), F.sum("downs").alias("worse"))
    total = F.col("w_plus") + F.col("w_minus")
    return out.withColumn("r", (F.col("w_plus") - F.col("w_minus")) / total).withColumn("sign_r", (F.col("better") - F.col("worse")) / F.col("n").cast("double"))


def wilcoxon(diffs: DataFrame, group: list[str], diff: str, exact_up_to: int = 50, correction: bool = False, alternative: str = "two-sided") -> DataFrame:
    """Signed-rank test by group: exact up to so many non-zero differences, else normal; two-sided, or that differences are "greater"."""
    limit, upper = exact_up_to, alternative == "greater"

    @F.pandas_udf("double")
    def p(n: pd.Series, w: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([stats.wilcoxon_exact(int(a), b, upper) if a <= limit else stats.wilcoxon_normal(int(a), b, t, correction, upper) for a, b, t in zip(n, w, ties)])

    return signed_ranks(diffs, group, diff).withColumn("p", p("n", "w_plus", "ties"))


def mann_whitney(df: DataFrame, group: list[str], value: str, first: Column) -> DataFrame:
    """U of the rows where ``first`` holds against the others, AUC, effect 2U/(n1 n2) - 1, and ties."""
    rows = df.where(F.col(value).isNotNull()).select(*group, value, first.cast("int").alias("one"))
    ones = rows.groupBy(*group, value).agg(F.sum("one").alias("ones"))
    ranked = mid_ranks(rows, group, value).join(ones, [*group, value])
    out = ranked.groupBy(*group).agg(
        F.sum("ones").alias("n1"), F.sum(F.col("n") - F.col("ones")).alias("n2"), F.sum(F.col("rank") * F.col("ones")).alias("r1"),
        F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).cast("double").alias("ties"))
    out = out.withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0)
    auc = F.try_divide(F.col("u"), (F.col("n1") * F.col("n2")).cast("double"))
    return out.withColumn("auc", auc).withColumn("effect", 2 * F.col("auc") - 1)


def mann_whitney_test(df: DataFrame, group: list[str], value: str, first: Column, alternative: str = "two-sided") -> DataFrame:
    """Normal approximation with ties and continuity; two-sided, or that the first sample is "greater"."""
    upper = alternative == "greater"

    @F.pandas_udf("double")
    def p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([stats.mann_whitney_p(a, int(b), int(c), d, upper) for a, b, c, d in zip(u, n1, n2, ties)])

    return mann_whitney(df, group, value, first).withColumn("p", p("u", "n1", "n2", "ties"))


def mcnemar(df: DataFrame, group: list[str], a: Column, b: Column) -> DataFrame:
    """Discordant pairs ``b`` (only a) and ``c`` (only b), the exact two-sided ``p``, and chi-square with continuity."""
    counts = df.groupBy(*group).agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"))
    n = F.col("b") + F.col("c")
    chi = F.try_divide((F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0)) ** 2).cast("double"), n.cast("double"))
    return counts.withColumn("p", stats.binomial_two_sided(F.col("b"), F.col("c"))).withColumn("chi2", F.coalesce(chi, F.lit(0.0)))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square statistic and degrees of freedom of a contingency table."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy(a).agg(F.sum("o").alias("ra"))
    columns = cells.groupBy(b).agg(F.sum("o").alias("rb"))
    total = cells.agg(F.sum("o").alias("n"))
    grid = rows.crossJoin(columns).crossJoin(total).join(cells, [a, b], "left")
    e = F.col("ra") * F.col("rb") / F.col("n").cast("double")
    return grid.agg(F.sum((F.coalesce("o", F.lit(0)) - e) ** 2 / e).alias("chi2"), ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("df"), F.max("n").alias("n"))


def bootstrap(units: DataFrame, group: list[str], value: str, draws: int, seed: str, statistic: Column) -> DataFrame:
    """``group``, ``draw`` and the ``statistic`` of the resampled values, as ``mean``.

    The i-th member of draw b is the unit that a counter hash of (seed, b, i) picks, so any engine can
    repeat it.  Units of a group are few (they are aggregates); draws times units is what is joined.
    """
    part = Window.partitionBy(*group)
    numbered = units.select(*group, value, (F.row_number().over(part.orderBy(value)) - 1).cast("bigint").alias("i"), F.count(F.lit(1)).over(part).alias("m"))
    picks = numbered.select(*group, "m", F.col("i").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    text = F.concat_ws("-", F.lit(seed), F.col("draw").cast("string"), F.col("at").cast("string"))
    picks = picks.select(*group, "draw", counter(text, F.col("m")).alias("i"))
    return picks.join(numbered.select(*group, "i", value), [*group, "i"]).groupBy(*group, "draw").agg(statistic.alias("mean"))


def bootstrap_means(units: DataFrame, group: list[str], value: str, draws: int, seed: str) -> DataFrame:
    return bootstrap(units, group, value, draws, seed, F.avg(value))


# Chances, out of 2^32, that a Poisson variable of mean one is at most 0, 1, 2 and so on.
POISSON = tuple(int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(13))


def poisson_weight(text: Column) -> Column:
    """How often a unit is in a draw: a Poisson variable of mean one, from the first 32 bits of the text's MD5."""
    u = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return let(u, lambda x: sum((F.when(x >= t, 1).otherwise(0) for t in POISSON[1:]), F.when(x >= POISSON[0], 1).otherwise(0))).cast("bigint")


def weighted_draws(units: DataFrame, group: list[str], unit: list[str], value: str, draws: int, seed: str, statistic=None) -> DataFrame:
    """``group``, ``draw`` and the ``statistic`` of the weighted values, as ``mean`` (the mean, if none is given).

    A unit's weight in a draw comes from a counter hash of seed, draw, group and unit alone, so units are never numbered nor
    joined to draws: weights are summed where the units are, and the sums of tasks are merged.  Weights are Poisson variables,
    which differ from drawing n of n units by the number that is drawn only; for a few units use ``bootstrap``.  ``statistic``
    takes value and weight.  A draw without any unit is null.
    """
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*group, *unit)]
    each = units.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("v"), F.concat_ws("-", *key).alias("key"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    each = each.withColumn("w", poisson_weight(F.concat_ws("-", F.lit(seed), F.col("draw").cast("string"), F.col("key"))))
    v, w = F.col("v"), F.col("w")
    what = statistic(v, w) if statistic else F.try_divide(F.sum(v * w), F.sum(w))
    return each.groupBy(*group, "draw").agg(what.alias("mean"))


def weighted_median(v: Column, w: Column) -> Column:
    """By the weighted counts of different values."""
    return F.percentile(v, 0.5, w)


def interval(means: DataFrame, group: list[str], alpha: float = 0.05) -> DataFrame:
    q = F.percentile("mean", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return means.groupBy(*group).agg(q.alias("q")).select(*group, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def order_interval(means: DataFrame, group: list[str], low: int, high: int) -> DataFrame:
    """The sorted draws at positions ``low`` and ``high`` (from 0); draws are a fixed number for each group."""
    s = F.array_sort(F.collect_list("mean"))
    return means.groupBy(*group).agg(s.alias("s")).select(*group, F.col("s")[low].alias("lo"), F.col("s")[high].alias("hi"))


class Results:
    """Gathers test rows by name and writes one corrected table; a thin face of DataFrame unions."""

    COLUMNS = ("rq", "comparison", "metric", "test", "n", "estimate", "ci95_low", "ci95_high", "effect_size_name", "effect_size_value", "statistic", "p_raw")

    def __init__(self) -> None:
        self._rows: DataFrame | None = None

    def add(self, rows: DataFrame, **constants: str) -> Results:
        given = rows.withColumns({k: F.lit(v) for k, v in constants.items()})
        kinds = {c: "string" for c in ("rq", "comparison", "metric", "test", "effect_size_name")} | {"n": "bigint"}
        one = given.select(*((F.col(c) if c in given.columns else F.lit(None)).cast(kinds.get(c, "double")).alias(c) for c in self.COLUMNS))
        self._rows = one if self._rows is None else self._rows.unionByName(one)
        return self

    def frame(self, family: list[str] | None = None) -> DataFrame:
        """All rows with ``p_corrected`` by family (default: rq); rows without a p are not corrected."""
        with_p = holm(self._rows.where("p_raw is not null"), family or ["rq"], "p_raw", ["comparison", "metric", "test"], "p_corrected")
        rest = self._rows.where("p_raw is null").withColumn("p_corrected", F.lit(None).cast("double"))
        return with_p.unionByName(rest)

    def finite(self) -> DataFrame:
        """NaN and infinities become null, as no sink may hold them."""
        numbers = {c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)) for c, t in self.frame().dtypes if t == "double"}
        return self.frame().withColumns(numbers)
