"""Readers and sinks on files of their own."""

import gzip
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from assayer.sources import readers, sinks


def test_json_lines_and_patch_records(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    rows = [{"CVE ID": "CVE-1", "before": "a ", "after": "b"}, {"CVE ID": "CVE-1", "before": "zz", "after": "c"}, {"CVE ID": "CVE-2", "before": "a", "after": " a"}]
    (folder / "x_pairs.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n{broken\n")
    df = readers.json_lines(spark, str(tmp_path / "in"), "`CVE ID` string, before string, after string", "*_pairs.jsonl")
    assert df.count() == 3
    got = readers.patch_records(df).collect()
    assert [(r.cve_id, r.cwe, r.vulnerable_code) for r in got] == [("CVE-1", "CWE-unknown", "a ")]


def test_tabular_needs_a_column(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Code,x\n1,2\n")
    assert readers.tabular(spark, str(tmp_path / "t.csv"), ["code"]).count() == 1
    assert readers.tabular(spark, str(tmp_path / "t.csv"), ["other"]) is None
    assert readers.modality(["func_before", "func_after", "text"]) == "patch" and readers.modality(["q"]) is None


def test_archives_report_what_they_leave_out(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("ok/x.c", "int a;")
        z.writestr("../evil.c", "no")
        z.writestr("big.c", "x" * 200)
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(b"{}\n"))
    (tmp_path / "c.gz").write_bytes(b"broken")
    with tarfile.open(tmp_path / "d.tgz", "w:gz") as t:
        t.add(tmp_path / "b.jsonl.gz", "in/b.gz")
    got = {(r.name, r.text, r.problem) for r in readers.archive_members(spark, str(tmp_path), most_bytes=100).where("name is null or name not like 'in/%'").collect()}
    assert got == {("ok/x.c", "int a;", None), ("../evil.c", None, "climbs out of the archive"), ("big.c", None, "too large"), ("b.jsonl", "{}\n", None), (None, None, "cannot be read: BadGzipFile")}
    assert {r.kind for r in readers.discover(spark, str(tmp_path)).collect()} == {"archive"}


def test_discovery_order(spark, tmp_path):
    for name in ("z/a.csv", "z/a.jsonl", "best/b.parquet", "best/a.json", "other/q.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    got = readers.discover(spark, str(tmp_path), ("best", "other")).orderBy("priority", "format", "path").collect()
    assert ["/".join(r.path.rsplit("/", 2)[1:]) for r in got] == ["best/a.json", "best/b.parquet", "other/q.txt", "z/a.jsonl", "z/a.csv"]


def test_samples_gates_and_names(spark):
    rows = [("c1", 2, 10), ("c1", 1, 7), ("c2", 3, 500), ("c3", 4, 20), ("c4", 5, 6)]
    df = spark.createDataFrame(rows, "cve_id string, at int, lines int")
    got = readers.vetted_sample(df, F.col("lines").between(5, 120), 2, most=2).collect()
    assert [(r.cve_id, r.at) for r in got] == [("c1", 1), ("c3", 4)]
    keys = spark.createDataFrame([("Big-Vul",), ("none",), ("",)], "key string")
    entries = spark.createDataFrame([("bigvul extended", 1), ("BIG vul", 2), ("", 3)], "name string, at int")
    assert {r.key: r.entry for r in readers.resolve_names(keys, entries, "key", "name", "at").collect()} == {"Big-Vul": "BIG vul", "none": None, "": None}
    paths = {"src/a.c": True, "src/tests/a.c": False, "test_a.c": False, "a.h": False, "a.C": True}
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", readers.source_file(F.col("p")).alias("ok"))
    assert {r.p: r.ok for r in df.collect()} == paths
    named = spark.range(1).select(readers.names_project(F.lit("a flaw in PHP 8"), F.array(F.lit("zend"), F.lit("php")))).first()[0]
    assert named is True


def test_fixes_gates(spark):
    """One id, one parent, a published record of that date, a source file that is no test."""
    commits = [("c1", "2025-09-01", "CVE-2025-1111", 1), ("c2", "2025-09-01", "CVE-2025-2222 CVE-2025-3333", 1), ("c3", "2025-09-01", "CVE-2025-4444", 2), ("c4", "2025-09-01", "CVE-2025-5555", 1), ("c5", "2025-09-01", "CVE-2025-6666", 1)]
    commits = spark.createDataFrame(commits, "commit string, day string, message string, parents int")
    code = lambda v: spark.createDataFrame([(c, "f", p, v) for c, p in (("c1", "a.c"), ("c2", "a.c"), ("c3", "a.c"), ("c4", "a.c"), ("c5", "test/a.c"))], "commit string, function string, path string, code string")
    records = spark.createDataFrame([("CVE-2025-1111", "PUBLISHED", "2025-09-02T00"), ("CVE-2025-5555", "REJECTED", "2025-09-02"), ("CVE-2025-6666", "PUBLISHED", "2025-09-02")], "cve_id string, state string, published string")
    got = readers.fixes(commits, code("a"), code("b"), "2025-08-01", records).collect()
    assert [r.cve_id for r in got] == ["CVE-2025-1111"]


def test_sections_splits_and_families(spark, tmp_path):
    (tmp_path / "a.md").write_text("intro\n## one\nbody\n## two\nmore\n")
    assert [(r.title, r.body) for r in readers.sections(spark, str(tmp_path / "a.md")).orderBy("at").collect()] == [("one", "body\n"), ("two", "more\n")]
    df = spark.createDataFrame([("train", 1), ("valid", 2)], "split string, x int")
    assert [r.x for r in readers.preferred_split(df).collect()] == [2]
    f = spark.createDataFrame([("c", "f", "b2", "2"), ("c", "f", "b1", "1"), ("d", "f", "b1", "1")], "cve_id string, function string, branch string, code string")
    got = readers.families(f, ["b1", "b2"]).collect()
    assert len(got) == 1 and got[0].source.branch == "b1" and [t.branch for t in got[0].targets] == ["b2"]


def test_fixes_takes_the_most_changed_function(spark):
    commits = spark.createDataFrame([("c1", "2025-09-01", "fix CVE-2025-1234 now"), ("c2", "2024-01-01", "CVE-2024-9999")], "commit string, day string, message string")
    before = spark.createDataFrame([("c1", "f", "a\nb"), ("c1", "g", "a\nb\nc")], "commit string, function string, code string")
    after = spark.createDataFrame([("c1", "f", "a\nx"), ("c1", "g", "p\nq\nr")], "commit string, function string, code string")
    got = readers.fixes(commits, before, after, "2025-08-01").collect()
    assert [(r.cve_id, r.function, r.changed) for r in got] == [("CVE-2025-1234", "g", 6)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan")), ("b", 1.0)], "rq string, v double")
    assert {r.rq: r.v for r in sinks.finite(df).collect()} == {"a": None, "b": 1.0}
    with pytest.raises(Exception, match="not finite"):
        sinks.require_finite(df, ["v"]).collect()
    path = str(tmp_path / "r")
    sinks.merge_results(df, path)
    sinks.merge_results(spark.createDataFrame([("b", 2.0)], "rq string, v double"), path)
    assert spark.read.parquet(path).where("rq = 'b'").first()["v"] == 2.0 and spark.read.parquet(path).count() == 2
    old, new = df.withColumn("v", F.lit(0.0)), spark.createDataFrame([("b", 9.0), ("c", 1.0)], "rq string, v double")
    assert {r.rq: r.v for r in sinks.upsert(old, new, ["rq"]).collect()} == {"a": 0.0, "b": 9.0, "c": 1.0}
    assert [r.rq for r in sinks.insert_new(old, new, ["rq"], ["v"]).collect()] == ["c"]
    sheet, key = sinks.blind_sheet(spark.createDataFrame([(1, "arm", "t")], "case int, arm string, text string"), ["arm"], "case", "s")
    assert sheet.columns == ["case", "text"] and key.columns == ["case", "arm"]
    assert sinks.markdown(new.orderBy("rq")).splitlines()[2] == "| b | 9.0 |" and "\\\\" in sinks.latex(new)


def test_controls(spark):
    df = spark.createDataFrame([(1, True), (2, True)], "x int, ok boolean")
    assert sinks.require(df, F.col("ok"), "self similarity").count() == 2
    with pytest.raises(Exception, match="self similarity"):
        sinks.require(df, F.col("x") < 2, "self similarity").collect()
