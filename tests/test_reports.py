"""Whole reports against plain calculations over the same runs."""

import statistics
from collections import Counter

import oracle
import pytest

from assayer.functions import stats
from assayer.jobs import reports
from assayer.jobs.base import QUERIES, Tables
from assayer.jobs.repair import candidates
from test_repair import plain_statements, plain_verdict


@pytest.fixture(scope="module")
def runs(spark):
    return reports.facts(Tables(spark, oracle.SF)).collect()


def rows(spark, name, *key):
    return {tuple(r[c] for c in key): r for r in QUERIES[name](spark, oracle.SF).collect()}


def ranks(values):
    return {v: sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in set(values)}


def mann_whitney(a, b, greater=False):
    r, both = ranks(a + b), a + b
    u = sum(r[x] for x in a) - len(a) * (len(a) + 1) / 2
    return stats.mann_whitney_p(u, len(a), len(b), float(sum(n**3 - n for n in Counter(both).values())), greater), u


def wilcoxon(diffs):
    d = [x for x in diffs if x]
    if not d:
        return 1.0
    r = ranks([abs(x) for x in d])
    w = sum(r[abs(x)] for x in d if x > 0)
    return stats.wilcoxon_exact(len(d), w) if len(d) <= 50 else stats.wilcoxon_normal(len(d), w, float(sum(n**3 - n for n in Counter(map(abs, d)).values())))


def holm(p):
    out, top = {}, 0.0
    for k, key in enumerate(sorted(p, key=lambda x: (p[x], x))):
        top = out[key] = max(top, min(1.0, (len(p) - k) * p[key]))
    return out


def per_unit(runs):
    out = {}
    for r in runs:
        u = out.setdefault((r.arm, r.k), {"late": r.k % 3 == 0, "reps": 0, "validated": 0, "touch": 0})
        u["reps"] += 1
        u["validated"] += r.validated
        u["touch"] += r.touch
    return out


def test_candidate_facts(spark):
    t = Tables(spark, oracle.SF)
    known = {(r.k, r.kind): r for r in reports.candidate_facts(t).collect()}
    for r in candidates(t).collect():
        got = known[r.k, r.kind]
        assert got.reason == plain_verdict(r.v, r.f, r.p) and got.validated == (got.reason in ("equivalent_to_official_fix", "covers_official_fix_changes"))
        v, f, p = (Counter(plain_statements(x)) for x in (r.v, r.f, r.p))
        assert got.extra == bool((v - p) - (v - f) or (p - v) - (f - v))


def test_anatomy_report(spark, runs):
    got = rows(spark, "anatomy_report", "arm")
    some = [r for r in runs if r.touch and not r.validated]
    assert some and set(got) == {(r.arm,) for r in some}
    for (arm,), g in got.items():
        own = [r for r in some if r.arm == arm]
        share = lambda f: pytest.approx(100 * sum(map(f, own)) / len(own), abs=0.051)  # noqa: E731,B023
        assert g.n == len(own) and g.partial_hunks == share(lambda r: 0 < r.hunks_covered < r.n_hunks) and g.multi_hunk_fixes == share(lambda r: r.n_hunks > 1)
        assert (g.incomplete, g.overlapping, g.different) == tuple(share(lambda r, x=x: r.relation == x) for x in ("incomplete", "overlapping", "different"))
        assert g.kind_match == share(lambda r: r.fix_kind == r.patch_kind) and g.fix_stmts == statistics.median(r.fix_stmts for r in own)
    tests = rows(spark, "anatomy_tests", "arm")
    table = {a: Counter(r.relation for r in some if r.arm == a) for (a,) in got}
    for (arm,), g in tests.items():
        names = [x for x in set(table["A"]) | set(table[arm]) if table["A"][x] + table[arm][x]]
        n = {a: sum(table[a].values()) for a in ("A", arm)}
        chi = sum((table[a][x] - e) ** 2 / e for a in n for x in names for e in [n[a] * (table["A"][x] + table[arm][x]) / sum(n.values())])
        assert g.chi2 == pytest.approx(chi, abs=1e-5) and g.df == len(names) - 1 and g.p == pytest.approx(stats.chi2_sf(chi, len(names) - 1) if len(names) > 1 else 1.0, abs=1e-6)


def test_cue_reports(spark, runs):
    c = {r.k: r for r in QUERIES["cues"](spark, oracle.SF).collect()}
    flag = {"location": lambda k: c[k].hits != "" or c[k].names_function, "remedy": lambda k: c[k].remedy != ""}
    u = per_unit(runs)
    for (arm, measure, cue), g in rows(spark, "cue_report", "arm", "measure", "cue").items():
        sides = [[x for (a, k), x in u.items() if a == arm and flag[cue](k) == want] for want in (True, False)]
        assert (g.n_with, g.n_without) == tuple(map(len, sides))
        for side, rate in zip(sides, (g.rate_with, g.rate_without)):
            assert rate == (pytest.approx(100 * sum(x[measure] for x in side) / sum(x["reps"] for x in side), abs=0.051) if side else None)
        a, b = ([x[measure] for x in side] for side in sides)
        assert g.p == (pytest.approx(mann_whitney(a, b)[0], abs=1e-9) if a and b else None)
    for (cue,), g in rows(spark, "cue_prevalence", "cue").items():
        n = Counter((k % 3 == 0, flag[cue](k)) for k in c)
        assert g.p == pytest.approx(stats.fisher_exact(n[False, True], n[False, False], n[True, True], n[True, False]), abs=1e-9)
        assert g.before == pytest.approx(100 * n[False, True] / (n[False, True] + n[False, False]), abs=0.051)


def test_looseness_report(spark, runs):
    labels = {r.doc_id: (r.quality == 0, r.toxic == 1) for r in spark.read.parquet(f"{oracle.SF}/labels.parquet").collect()}
    for (arm,), g in rows(spark, "looseness_report", "arm").items():
        own = [r for r in runs if r.arm == arm and r.validated]
        said = [labels.get(r.k, (False, False)) for r in own if r.extra]
        assert (g.validated, g.extra, g.either, g.both) == (len(own), len(said), sum(map(any, said)), sum(map(all, said)))
        assert g.agreement == pytest.approx(sum(a == b for a, b in said) / len(said), abs=1e-6) and 0 <= g.both_lo <= g.either_lo <= g.either_hi


def test_membership_report(spark):
    member = {r.doc_id: r.quality == 1 for r in spark.read.parquet(f"{oracle.SF}/labels.parquet").collect()}
    s = [(r.score, member.get(r.doc_id, False)) for r in QUERIES["membership_score"](spark, oracle.SF).collect()]
    a, b = ([x for x, m in s if m == want] for want in (True, False))
    p, u = mann_whitney(a, b, True)
    g = QUERIES["membership_report"](spark, oracle.SF).first()
    assert (g.n_seen, g.n_unseen, g.u) == (len(a), len(b), u) and g.p == pytest.approx(p, abs=1e-9) and g.auc == pytest.approx(u / len(a) / len(b), abs=1e-6)
    assert g.mean_seen == pytest.approx(statistics.mean(a), abs=1e-6) and g.seen_rate == pytest.approx(sum(x >= statistics.median(x for x, _ in s) for x, _ in s) / len(s), abs=1e-6)


def test_period_reports(spark, runs):
    u, got = per_unit(runs), rows(spark, "period_report", "arm", "measure")
    arms = {a for a, _ in u}
    assert set(got) == {(a, m) for a in arms for m in ("validated", "touch")}
    apart, within = {}, {"validated": {}, "touch": {}}
    for (arm, m), g in got.items():
        late, early = ([x for (a, k), x in u.items() if a == arm and x["late"] == w] for w in (True, False))
        apart[arm, m] = mann_whitney([x[m] for x in late], [x[m] for x in early])[0]
        assert g.after == pytest.approx(sum(x[m] for x in late) / sum(x["reps"] for x in late), abs=1e-6) and g.before_lo < g.before < g.before_hi
        if arm != "A":
            d = [x[m] - u["A", k][m] for (a, k), x in u.items() if a == arm and x["late"] and ("A", k) in u]
            within[m][arm] = wilcoxon(d)
            assert (g.better, g.worse) == (sum(x > 0 for x in d), sum(x < 0 for x in d))
    for (arm, m), g in got.items():
        assert (g.periods_p, g.periods_holm) == (pytest.approx(apart[arm, m], abs=1e-9), pytest.approx(holm(apart)[arm, m], abs=1e-9))
        if arm != "A":
            assert (g.base_p, g.base_holm) == (pytest.approx(within[m][arm], abs=1e-9), pytest.approx(holm(within[m])[arm], abs=1e-9))
        else:
            assert g.base_p is None
    projects = rows(spark, "project_report", "project", "arm")
    for (project, arm), g in projects.items():
        own = [x for (a, k), x in u.items() if a == arm and x["late"] and f"project-{k % 7}" == project]
        assert (g.units, g.runs, g.ever) == (len(own), sum(x["reps"] for x in own), sum(x["validated"] > 0 for x in own))
    assert sum(g.units for g in projects.values()) == sum(x["late"] for x in u.values())
    assert set(rows(spark, "period_covariates", "late")) == {(True,), (False,)}


def test_port_reports(spark):
    u, kinds = {}, {}
    for r in reports.port_facts(Tables(spark, oracle.SF)).collect():
        x = u.setdefault((r.arm, r.k, r.branch), [0, 0, 0])
        x[0] += 1
        x[1] += r.validated
        x[2] += r.touch
        kinds[r.k, r.branch] = r.clone_type
    got = rows(spark, "port_report", "arm", "clone_type")
    assert {c for _, c in got} >= {"all", "identical", "modified"}
    for (arm, kind), g in got.items():
        own = [x for (a, k, b), x in u.items() if a == arm and kind in ("all", kinds[k, b])]
        assert (g.targets, g.ever) == (len(own), sum(x[1] > 0 for x in own)) and g.vpr == pytest.approx(sum(x[1] for x in own) / sum(x[0] for x in own), abs=1e-6)
    assert got["P0", "identical"].vpr == 1.0 and got["P0", "modified"].vpr == 0.0
    tests = rows(spark, "port_tests", "arm", "against")
    p = {}
    for arm, against in tests:
        p[arm, against] = wilcoxon([x[1] - u[against, k, b][1] for (a, k, b), x in u.items() if a == arm and (against, k, b) in u])
    assert set(p) == {("P2", "P0"), ("P2", "P1"), ("P3", "P0"), ("P3", "P1"), ("P3", "P2")}
    for key, g in tests.items():
        assert (g.p, g.p_holm) == (pytest.approx(p[key], abs=1e-9), pytest.approx(holm(p)[key], abs=1e-9))
