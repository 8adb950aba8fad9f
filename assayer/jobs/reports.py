"""Whole reports over runs: the anatomy of failures, cues of descriptions, extra edits, what was known, two periods, and ports.

Each is composed of the judge, the edit scripts and the tests of the other modules.  Units are the items; items of the later period
are every third, and projects are their numbers by seven.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import code as C
from assayer.functions import diff as D
from assayer.functions import stats
from assayer.functions import text as X
from assayer.jobs import detectors, messages
from assayer.jobs.base import Tables, query
from assayer.jobs.repair import BASE_ARM, dissected, ports, runs
from assayer.operators import edits as E
from assayer.operators import judge as J
from assayer.operators import ranks as R
from assayer.operators import tests as T
from assayer.operators.joins import large
from assayer.operators.windows import holm
from assayer.sources.shared import Scratch

PORT_ARMS = {"A": "P1", "N": "P2", "R": "P3"}


def _r(c, n=6):
    return F.round(c, n)


def candidate_facts(t: Tables) -> DataFrame:
    """What is known of each different candidate (``k``, ``kind``): verdict, whether it touches the fix's lines, its anatomy and extra edits."""
    out = J.judge(dissected(t))
    return out.select(
        "k", "kind", "validated", "reason", ((F.col("reason") != J.UNCHANGED) & F.arrays_overlap("mine", "off")).alias("touch"), "n_hunks", "hunks_covered", "relation", "fix_kind", "patch_kind",
        "var_jaccard", "fix_stmts", "patch_stmts", ((F.size(F.array_except("__lost_p", "__lost")) > 0) | (F.size(F.array_except("__new_p", "__new")) > 0)).alias("extra"), F.col("fix.size").alias("fix_size"), F.size(C.code_lines(F.col("v"))).alias("lines"),
    )


def facts(t: Tables, *what: str) -> DataFrame:
    """Every run with what is known of its candidate, or what is asked of it; only that is found, and once, as candidates are written."""
    known = candidate_facts(t)
    known = Scratch(t.part.sparkSession).write(known.select("k", "kind", *what) if what else known)
    return runs(t).join(large(known), ["k", "kind"]).withColumn("late", F.col("k") % 3 == 0)


def units(rows: DataFrame) -> DataFrame:
    """Of each unit and arm how many runs there are, were validated, and touch the fix's lines."""
    return rows.groupBy("arm", "k", "late").agg(F.count(F.lit(1)).alias("reps"), F.count_if("validated").alias("validated"), F.count_if("touch").alias("touch"))


def measures(u: DataFrame, *others: str) -> DataFrame:
    """A row for each unit, arm and measure, with the count as ``x``, and other columns of the unit."""
    both = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in ("validated", "touch")))
    return u.select("arm", "k", "late", "reps", *others, F.inline(both))


def _chi_p():
    @F.pandas_udf("double")
    def p(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([stats.chi2_sf(a, int(b)) if b else 1.0 for a, b in zip(x, df)])

    return p


def _fisher():
    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([stats.fisher_exact(*map(int, x)) for x in zip(a, b, c, d)])

    return p


def failures(t: Tables, *what: str) -> DataFrame:
    """Runs in the right place that are no fix, with what is asked of their candidates."""
    return facts(t, "touch", "validated", *what).where("touch and not validated")


@query()
def anatomy_report(spark, sf_dir):
    """Of each arm's failures in the right place: hunks met in part, relations to the fix, kinds of edits, shared names and sizes."""
    f = failures(Tables(spark, sf_dir), "hunks_covered", "n_hunks", "relation", "fix_kind", "patch_kind", "var_jaccard", "fix_stmts", "patch_stmts")
    share = lambda c: _r(100 * F.avg(c.cast("int")), 1)
    a = f.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), share((F.col("hunks_covered") > 0) & (F.col("hunks_covered") < F.col("n_hunks"))).alias("partial_hunks"), share(F.col("n_hunks") > 1).alias("multi_hunk_fixes"),
        *(share(F.col("relation") == x).alias(x) for x in ("incomplete", "overlapping", "different")), share(F.col("fix_kind") == F.col("patch_kind")).alias("kind_match"), _r(F.avg("var_jaccard"), 3).alias("var_jaccard"),
        F.percentile("fix_stmts", 0.5).alias("fix_stmts"), F.percentile("patch_stmts", 0.5).alias("patch_stmts"))
    return a


@query()
def anatomy_tests(spark, sf_dir):
    """Whether the relation of failures to the fix differs between the base arm and each other arm."""
    cells = Scratch(spark).write(failures(Tables(spark, sf_dir), "relation").groupBy("arm", "relation").agg(F.count(F.lit(1)).alias("o")))
    base = cells.where(F.col("arm") == BASE_ARM).select("relation", F.col("o").alias("b"))
    others = cells.where(F.col("arm") != BASE_ARM).select("arm").distinct()
    every = others.crossJoin(F.broadcast(cells.select("relation").distinct()))  # arms and relations are few names
    x = every.join(base, "relation", "left").join(cells, ["arm", "relation"], "left").select("arm", F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("b", F.lit(0)).alias("b")).where("o + b > 0")
    sums = x.groupBy("arm").agg(F.sum("o").alias("no"), F.sum("b").alias("nb"), (F.count(F.lit(1)) - 1).alias("df"))
    e = (F.col("o") + F.col("b")) / (F.col("no") + F.col("nb"))
    part = (F.col("o") - e * F.col("no")) ** 2 / (e * F.col("no")) + (F.col("b") - e * F.col("nb")) ** 2 / (e * F.col("nb"))
    chi = x.join(sums, "arm").groupBy("arm", "df").agg(F.sum(part).alias("chi2"))
    return chi.select("arm", _r(F.col("chi2")).alias("chi2"), "df", _chi_p()("chi2", "df").alias("p"))


@query()
def cue_report(spark, sf_dir):
    """For each arm, measure and cue: the rates of units whose description has the cue and of the others, and the test on their counts."""
    t = Tables(spark, sf_dir)
    flags = _flags(spark, sf_dir)
    both = F.array(*(F.struct(F.lit(c).alias("cue"), F.col(c).alias("flag")) for c in ("location", "remedy")))
    u = Scratch(spark).write(units(facts(t, "validated", "touch")).join(large(flags), "k"))
    m = measures(u, "location", "remedy").select("*", F.inline(both)).drop("location", "remedy")
    key = ["arm", "measure", "cue"]
    rate = lambda w: _r(100 * F.sum(F.when(w, F.col("x"))) / F.sum(F.when(w, F.col("reps"))), 1)
    n = m.groupBy(*key).agg(F.count_if("flag").alias("n_with"), rate(F.col("flag")).alias("rate_with"), F.count_if(~F.col("flag")).alias("n_without"), rate(~F.col("flag")).alias("rate_without"))
    p = T.mann_whitney_test(m, key, "x", F.col("flag")).where("n1 > 0 and n2 > 0").select(*key, "p")
    return n.join(p, key, "left")


def _flags(spark, sf_dir) -> DataFrame:
    c = messages.cues(spark, sf_dir)
    return c.select("k", ((F.col("hits") != "") | F.col("names_function")).alias("location"), (F.col("remedy") != "").alias("remedy"), "words")


@query()
def cue_prevalence(spark, sf_dir):
    """How many descriptions have each cue in either period, and Fisher's test between the periods."""
    c = _flags(spark, sf_dir).withColumn("late", F.col("k") % 3 == 0)
    both = F.array(*(F.struct(F.lit(x).alias("cue"), F.col(x).alias("flag")) for x in ("location", "remedy")))
    n = c.select("late", F.inline(both)).groupBy("cue").agg(
        F.count_if(F.col("flag") & ~F.col("late")).alias("a"), F.count_if(~F.col("flag") & ~F.col("late")).alias("b"), F.count_if(F.col("flag") & F.col("late")).alias("c"), F.count_if(~F.col("flag") & F.col("late")).alias("d"))
    share = lambda x, y: _r(100 * F.try_divide(F.col(x), F.col(x) + F.col(y)), 1)
    return n.select("cue", share("a", "b").alias("before"), share("c", "d").alias("after"), _fisher()("a", "b", "c", "d").alias("p"))


@query()
def looseness_report(spark, sf_dir):
    """Of each arm's validated runs those with edits beyond the fix's, and of these what two raters, the labels of the unit, call harmful."""
    t = Tables(spark, sf_dir)
    raters = t.labels.select(F.col("doc_id").alias("k"), (F.col("quality") == 0).alias("one"), (F.col("toxic") == 1).alias("two"))
    v = facts(t, "validated", "extra").where("validated").join(raters, "k", "left")
    one, two = F.col("extra") & F.coalesce("one", F.lit(False)), F.col("extra") & F.coalesce("two", F.lit(False))
    n = v.groupBy("arm").agg(F.count(F.lit(1)).alias("validated"), F.count_if("extra").alias("extra"), F.count_if(one | two).alias("either"), F.count_if(one & two).alias("both"), F.count_if(F.col("extra") & (one == two)).alias("agreed"))
    (lo, hi), (lo2, hi2) = stats.wilson(F.col("either"), F.col("validated")), stats.wilson(F.col("both"), F.col("validated"))
    return n.select("arm", "validated", "extra", "either", "both", _r(lo).alias("either_lo"), _r(hi).alias("either_hi"), _r(lo2).alias("both_lo"), _r(hi2).alias("both_hi"), _r(F.try_divide("agreed", "extra")).alias("agreement"))


@query()
def membership_report(spark, sf_dir):
    """How well the membership score tells the members from others: area, one-sided test, means, and the share at or above the median."""
    t = Tables(spark, sf_dir)
    member = t.labels.select("doc_id", (F.col("quality") == 1).alias("member"))
    s = Scratch(spark).write(detectors.membership_score(spark, sf_dir).join(member, "doc_id", "left").select("score", F.coalesce("member", F.lit(False)).alias("member"), F.lit(0).alias("g")))
    m = T.mann_whitney_test(s, ["g"], "score", F.col("member"), "greater").select("g", "n1", "n2", "u", "auc", "p")
    median = R.quantiles(s, ["g"], "score", {"median": 0.5})
    rest = s.join(median, "g").groupBy("g").agg(F.avg(F.when(F.col("member"), F.col("score"))).alias("mean_seen"), F.avg(F.when(~F.col("member"), F.col("score"))).alias("mean_unseen"), F.avg((F.col("score") >= F.col("median")).cast("int")).alias("seen_rate"))
    return m.join(rest, "g").select(F.col("n1").alias("n_seen"), F.col("n2").alias("n_unseen"), "u", _r(F.col("auc")).alias("auc"), "p", *(_r(F.col(c)).alias(c) for c in ("mean_seen", "mean_unseen", "seen_rate")))


def _rate(prefix: str, where: Column) -> list[Column]:
    k, n = F.sum(F.when(where, F.col("x"))), F.sum(F.when(where, F.col("reps")))
    lo, hi = stats.wilson(k, n)
    return [_r(k / n).alias(prefix), _r(lo).alias(f"{prefix}_lo"), _r(hi).alias(f"{prefix}_hi")]


@query()
def period_report(spark, sf_dir):
    """For each arm and measure: rates in both periods, the test between them by units, and in the later one the test against the base arm; both corrected."""
    m = Scratch(spark).write(measures(units(facts(Tables(spark, sf_dir), "validated", "touch"))))
    key, late = ["arm", "measure"], F.col("late")
    rates = m.groupBy(*key).agg(*_rate("after", late), *_rate("before", ~late))
    apart = T.mann_whitney_test(m, key, "x", late).select(*key, F.col("p").alias("periods_p"))
    apart = holm(apart.withColumn("family", F.lit("periods")), ["family"], "periods_p", key, "periods_holm").drop("family")
    own = m.where("late")
    base = own.where(F.col("arm") == BASE_ARM).select("k", "measure", F.col("x").alias("b"))
    d = own.where(F.col("arm") != BASE_ARM).join(large(base), ["k", "measure"]).select(*key, (F.col("x") - F.col("b")).alias("d"))
    sides = d.groupBy(*key).agg(F.count_if(F.col("d") > 0).alias("better"), F.count_if(F.col("d") < 0).alias("worse"))
    within = sides.join(T.wilcoxon(d, key, "d").select(*key, "p"), key, "left").withColumn("base_p", F.coalesce("p", F.lit(1.0))).drop("p")
    within = holm(within, ["measure"], "base_p", ["arm"], "base_holm")
    return rates.join(apart, key).join(within, key, "left")


@query()
def period_covariates(spark, sf_dir):
    """Medians of what else may differ between the periods: words of descriptions, lines of functions, sizes of fixes."""
    t = Tables(spark, sf_dir)
    one = candidate_facts(t).where("kind = 'exact'").select("k", "lines", "fix_size").join(_flags(spark, sf_dir).select("k", "words"), "k").withColumn("late", F.col("k") % 3 == 0)
    return one.groupBy("late").agg(*(F.percentile(c, 0.5).alias(c) for c in ("words", "lines", "fix_size")), F.count(F.lit(1)).alias("units"))


@query()
def project_report(spark, sf_dir):
    """The later period by project: units, runs, validated and touching runs of each arm, and whether any run of a unit was validated."""
    u = units(facts(Tables(spark, sf_dir), "validated", "touch").where("late")).withColumn("project", F.concat(F.lit("project-"), (F.col("k") % 7).cast("string")))
    return u.groupBy("project", "arm").agg(F.count(F.lit(1)).alias("units"), F.sum("reps").alias("runs"), _r(F.sum("validated") / F.sum("reps")).alias("vpr"), _r(F.sum("touch") / F.sum("reps")).alias("touch"), F.count_if(F.col("validated") > 0).alias("ever"))


def port_facts(t: Tables) -> DataFrame:
    """Runs of four arms on each target (``k``, ``branch``): the naive port, the same in each repeat, and three arms of runs, of three repeats each."""
    p = ports(t).withColumn("p", F.coalesce(F.when(F.col("port.applied"), F.col("port.text")), F.col("target")))
    # What the fix of the target is: the same change, written as the target is.
    fixed = F.when(F.col("branch") == "indented", F.replace("f", F.lit("    "), F.lit("  "))).otherwise(F.col("f"))
    p = p.withColumn("fixed", fixed)
    kind = F.when(C.bare_code(F.col("v")) == C.bare_code(F.col("target")), "identical").when(X.abstract_code(F.col("v")) == X.abstract_code(F.col("target")), "renamed").otherwise("modified")
    judged = J.judge(p, "target", "fixed", "p").select("k", "branch", "target", "fixed", "p", kind.alias("clone_type"), "validated", "reason")
    with_lines = E.with_script(E.with_script(judged, "target", "fixed", "a"), "target", "p", "b")
    naive = with_lines.select("k", "branch", "clone_type", F.lit("P0").alias("arm"), "validated", ((F.col("reason") != J.UNCHANGED) & F.arrays_overlap(E.changed_lines(F.col("a")), E.changed_lines(F.col("b")))).alias("touch"))
    targets = naive.select("k", "branch", "clone_type").distinct()
    naive = naive.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(3))))
    names = F.create_map(*(F.lit(x) for pair in PORT_ARMS.items() for x in pair))
    ran = facts(t, "validated", "touch").where("rep <= 3").select("k", F.element_at(names, F.col("arm")).alias("arm"), "rep", "validated", "touch")
    return naive.unionByName(targets.join(large(ran), "k"))


@query()
def port_report(spark, sf_dir):
    """Of each arm on all targets and on those of each clone type: rates, and targets that were ever validated."""
    u = port_facts(Tables(spark, sf_dir)).groupBy("k", "branch", "clone_type", "arm").agg(F.count(F.lit(1)).alias("reps"), F.count_if("validated").alias("validated"), F.count_if("touch").alias("touch"))
    g = u.rollup("arm", "clone_type").agg(F.count(F.lit(1)).alias("targets"), _r(F.sum("validated") / F.sum("reps")).alias("vpr"), _r(F.sum("touch") / F.sum("reps")).alias("touch"), F.count_if(F.col("validated") > 0).alias("ever")).where("arm is not null")
    return g.select("arm", F.coalesce("clone_type", F.lit("all")).alias("clone_type"), "targets", "vpr", "touch", "ever")


@query()
def port_tests(spark, sf_dir):
    """Signed-rank tests of the grounded port arms against the others, on the targets that both have, corrected together."""
    u = Scratch(spark).write(port_facts(Tables(spark, sf_dir)).groupBy("k", "branch", "arm").agg(F.count_if("validated").alias("x")))
    b = u.where("arm in ('P2', 'P3')").select("k", "branch", F.col("arm").alias("arm"), F.col("x").alias("y"))
    a = u.where("arm <> 'P3'").select("k", "branch", F.col("arm").alias("against"), "x")
    d = b.join(large(a), ["k", "branch"]).where("arm > against").select("arm", "against", (F.col("y") - F.col("x")).alias("d"))
    key = ["arm", "against"]
    p = d.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(T.wilcoxon(d, key, "d").select(*key, "better", "worse", "p"), key, "left")
    p = p.select(*key, "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("better", "worse")), F.coalesce("p", F.lit(1.0)).alias("p"))
    return holm(p.withColumn("family", F.lit("ports")), ["family"], "p", key, "p_holm").drop("family")
