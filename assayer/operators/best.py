"""The best match of each set among known ones, exactly, without joining what can't change it.

Features are read from the rarest on.  What a query's rarest features meet gives candidates, the most promising of which are
compared in full, so there is a similarity to beat.  A known set that shares none of the features read so far shares at most those
that are left; once these are too few to reach the similarity to beat, the rest, which are the most frequent ones and would make
most of the candidates, are never joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.joins import large, small
from assayer.operators.setsim import jaccard_of
from assayer.sources.shared import Scratch

#: How many of the rarest features give the first candidates, and how many of these are compared in full.
FIRST, COMPARED = 8, 3
#: Known sets of so many features together at most, and so many features of queries, are broadcast.
MOST_SENT = 200_000
_EPS = 1e-12


def _compared(pairs: DataFrame, queries: DataFrame, known: DataFrame) -> DataFrame:
    """``q``, ``k`` and ``sim`` of pairs, by their whole sets; few sets may be many features."""
    n = known.agg(F.coalesce(F.sum(F.greatest(F.size("fs"), F.lit(1))), F.lit(0))).first()[0]
    sets = known.select("k", F.col("fs").alias("ks"))
    both = pairs.join(large(queries.select("q", F.col("fs").alias("qs"))), "q").join(F.broadcast(sets) if n <= MOST_SENT else large(sets), "k")
    return both.select("q", "k", jaccard_of(F.size(F.array_intersect("qs", "ks")), F.size("qs"), F.size("ks")).alias("sim"))


def ordered(queries: DataFrame, known: DataFrame) -> DataFrame:
    """``q``, ``m``, ``feature`` and its place ``at`` from the rarest on, of the features that known sets have; ``present`` is their number."""
    df = known.select(F.explode("fs").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("df"))
    rows = queries.select("q", F.size("fs").alias("m"), F.explode("fs").alias("feature")).join(df, "feature")
    of = Window.partitionBy("q")
    return rows.select("q", "m", "feature", F.row_number().over(of.orderBy("df", "feature")).alias("at"), F.count(F.lit(1)).over(of).alias("present"))


def candidates(rows: DataFrame, known: DataFrame, bound: DataFrame | None) -> DataFrame:
    """``q``, ``k``, ``m``, ``n`` and ``seen``, the common features among those read; with all features where there is no bound.

    ``bound`` has the similarity to beat (``least``) of each query that has one.
    """
    sets = known.select("k", F.size("fs").alias("n"), F.explode("fs").alias("feature"))
    if bound is not None:
        rows = rows.join(bound, "q", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
        rows = rows.where((F.col("present") - F.col("at") + 1) / F.col("m") >= F.col("least") - _EPS)
    else:
        rows = rows.withColumn("least", F.lit(0.0))
    met = rows.join(small(sets), "feature").where(F.least("m", "n") >= F.col("least") * F.greatest("m", "n") - _EPS)
    return met.groupBy("q", "k", "m", "n", "least", "present").agg(F.count(F.lit(1)).alias("seen"))


def best_matches(queries: DataFrame, known: DataFrame) -> DataFrame:
    """``q``, the most similar ``k`` (the smallest of equals) and their Jaccard similarity ``sim``; no row for a query that shares nothing.

    ``queries`` has ``q`` and ``fs``, ``known`` has ``k`` and ``fs``: arrays of different 64-bit features.  Exact: of equal similarity
    to the one to beat too, no candidate is left out.  Null and empty sets match nothing; ids are different.
    """
    scratch = Scratch(queries.sparkSession)
    queries, known = scratch.write(queries.select("q", "fs")), scratch.write(known.select("k", "fs"))
    rows = scratch.write(ordered(queries, known))
    first = candidates(rows.where(F.col("at") <= FIRST), known, None)
    promise = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(jaccard_of(F.col("seen"), F.col("m"), F.col("n"))), "k"))
    some = first.withColumn("place", promise).where(F.col("place") <= COMPARED).select("q", "k")
    bound = scratch.write(_compared(some, queries, known).groupBy("q").agg(F.max("sim").alias("least")))
    # The share of a query's features that was read follows from its bound, as in ``candidates``.
    left = F.greatest(F.least(F.ceil(F.col("least") * F.col("m") - 1e-9) - 1, F.col("present")), F.lit(0))
    most = F.least(F.col("seen") + left, F.col("m"), F.col("n"))
    open_ = candidates(rows, known, bound).where(jaccard_of(most, F.col("m"), F.col("n")) >= F.col("least") - _EPS)
    found = _compared(open_.select("q", "k"), queries, known)
    top = found.groupBy("q").agg(F.max("sim").alias("sim"), F.min_by("k", F.struct(-F.col("sim"), F.col("k"))).alias("k"))
    return top.select("q", "k", "sim")


def pairs_between(queries: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """``q``, ``k`` and ``sim`` of all pairs with a Jaccard similarity of ``threshold`` or more, queries against a corpus.

    Both sides join on their prefixes of rare features, which such pairs share one of at least, under the bound of their sizes.
    """
    scratch = Scratch(queries.sparkSession)
    queries, known = scratch.write(queries.select("q", "fs")), scratch.write(known.select("k", "fs"))
    # A known set's features that no query has can't be shared: they only count, in its size.
    asked = small(scratch.write(queries.select(F.explode("fs").alias("feature")).distinct()), MOST_SENT)
    sides = queries.select(F.col("q"), F.lit(None).cast(dict(known.dtypes)["k"]).alias("k"), "fs").unionByName(known.select(F.lit(None).cast(dict(queries.dtypes)["q"]).alias("q"), "k", "fs"))
    each = sides.select("q", "k", F.size("fs").alias("n"), F.explode("fs").alias("feature"))
    each = scratch.write(each.join(asked, "feature", "left_semi"))
    df = each.groupBy("feature").agg(F.count("q").alias("a"), F.count("k").alias("b"))
    # What one side alone has comes first in the order and can't be shared.
    order = df.where("a > 0 and b > 0").select("feature", (F.col("a") + F.col("b")).alias("df"))
    ranked = each.join(order, "feature")
    of = Window.partitionBy("q", "k")
    place = F.row_number().over(of.orderBy("df", "feature")) + F.col("n") - F.count(F.lit(1)).over(of)
    prefix = ranked.withColumn("at", place).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    x = prefix.where("q is not null").select("q", F.col("n").alias("m"), "feature")
    y = prefix.where("k is not null").select("k", "n", "feature")
    met = scratch.write(x.join(large(y), "feature").where(F.least("m", "n") >= threshold * F.greatest("m", "n") - 1e-9).select("q", "k").distinct())
    known = known.join(small(met.select("k").distinct()), "k", "left_semi")
    return _compared(met, queries, known).where(F.col("sim") >= threshold - _EPS)
