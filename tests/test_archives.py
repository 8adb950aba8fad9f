"""Archives as a data source, and the documents of runs."""

import gzip
import io
import json
import random
import tarfile
import zipfile

import oracle
import pytest

from assayer.jobs import replays
from assayer.jobs.base import Tables
from assayer.operators import replay as R
from assayer.sources import archives, provenance
from assayer.sources.shared import Scratch


def whole(rows):
    out = {}
    for r in sorted((r for r in rows if r.content is not None), key=lambda r: (r.path, r.member, r.piece)):
        out.setdefault((r.path.rsplit("/", 1)[-1], r.member), []).append(bytes(r.content))
    return {k: b"".join(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at, draw = tmp_path_factory.mktemp("archives"), random.Random(1)
    texts = {f"d{k}/f{k}.txt": "\n".join(f"line {j} {draw.random()}" for j in range(draw.randint(0, 400))).encode() for k in range(12)}
    texts |= {"empty": b"", "long": b"x" * 5000, "crlf": b"a\r\nb\r\n", "bytes": bytes(range(256))}
    with zipfile.ZipFile(at / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for n, t in {**texts, "../evil": b"no", "/root": b"no"}.items():
            z.writestr(n, t)
        z.mkdir("folder")
    for name, mode in (("b.tar", "w"), ("c.tgz", "w:gz"), ("d.tar.xz", "w:xz")):
        with tarfile.open(at / name, mode) as t:
            for n, text in {**texts, "../evil": b"no"}.items():
                info = tarfile.TarInfo(n)
                info.size = len(text)
                t.addfile(info, io.BytesIO(text))
    (at / "deep").mkdir()
    (at / "deep" / "e.jsonl.gz").write_bytes(gzip.compress(b'{"a": 1}\n{"a": 2}\n'))
    (at / "deep" / "broken.zip").write_bytes(b"PK no")
    (at / "deep" / "cut.gz").write_bytes(gzip.compress(b"word\n" * 9000)[:-20])
    (at / "ignored.txt").write_text("not an archive")
    return at, texts


@pytest.mark.parametrize("piece, most", [(1 << 20, 64 << 20), (700, 4000), (1, 1)])
def test_members_come_whole(spark, folder, piece, most):
    at, texts = folder
    rows = [r for r in archives.pieces(spark, str(at), pieceBytes=piece, partitionBytes=most).collect()] if piece > 1 else archives.pieces(spark, f"{at}/a.zip", pieceBytes=64, partitionBytes=1).collect()
    got = whole(rows)
    names = ("a.zip", "b.tar", "c.tgz", "d.tar.xz") if piece > 1 else ("a.zip",)
    assert {k: v for k, v in got.items() if k[0] in names} == {(n, m): t for n in names for m, t in texts.items()}
    assert all(len(r.content) <= max(piece, 64) for r in rows if r.content is not None)
    bad = {(r.path.rsplit("/", 1)[-1], r.member, r.problem) for r in rows if r.problem}
    assert ("a.zip", "../evil", "climbs out of the archive") in bad and ("a.zip", "/root", "climbs out of the archive") in bad
    if piece > 1:
        assert got["e.jsonl.gz", "e.jsonl"] == b'{"a": 1}\n{"a": 2}\n'
        assert ("broken.zip", None, "cannot be read: BadZipFile") in bad and ("cut.gz", "cut", "cannot be read: EOFError") in bad


def test_members_are_read_side_by_side(spark, folder):
    at, texts = folder
    assert archives.pieces(spark, f"{at}/a.zip", partitionBytes=1).rdd.getNumPartitions() == len(texts) + 2
    assert archives.pieces(spark, f"{at}/b.tar", partitionBytes=10**9).rdd.getNumPartitions() == 1
    assert archives.pieces(spark, f"file://{at}/b.tar", partitionBytes=9000).rdd.getNumPartitions() > 3


def test_lines(spark, folder):
    at, texts = folder
    got = {}
    for r in archives.lines(spark, f"{at}/b.tar", pieceBytes=900).orderBy("member", "piece", "at").collect():
        got.setdefault(r.member, []).append(r.line)
    for m in ("d3/f3.txt", "crlf"):
        assert got[m] == texts[m].decode().splitlines()


def test_table_digests(spark):
    rows = [(1, "a", [1.5]), (2, None, None), (2, None, None)]
    df = spark.createDataFrame(rows, "a int, b string, c array<double>")
    one = provenance.table_digest(df).first()
    assert one.rows == 3 and one == provenance.table_digest(df.repartition(3).select("c", "b", "a")).first()
    others = [df.distinct(), df.withColumnRenamed("b", "d"), df.limit(0), df.fillna("", ["b"]), df.selectExpr("cast(a as long) a", "b", "c")]
    assert len({one.digest, *(provenance.table_digest(d).first().digest for d in others)}) == 6


def test_run_documents_are_idempotent(spark, tmp_path):
    t, scratch = Tables(spark, oracle.SF), Scratch(spark)
    arms = R.LADDER[:3]
    responses = scratch.write(replays.recorded(t, arms))
    for _ in range(2):
        done = R.replay(replays.units(t), responses, arms=arms)
        document = provenance.run_document("replay", {"arms": [a.name for a in arms], "budget": 5}, {"items": replays.units(t), "responses": responses}, {"runs": done.runs}, R.usage(done.rounds))
        table = provenance.record(spark, str(tmp_path), document)
    provenance.record(spark, str(tmp_path), document | {"run": "other"})
    rows = {r.run: r for r in spark.read.parquet(f"{tmp_path}/runs").collect()}
    assert table.count() == 1 and set(rows) == {"replay", "other"}
    observed, facts = json.loads(rows["replay"].observed), json.loads(rows["replay"].tables)
    assert observed["requests"] == observed["hits"] + observed["misses"] and facts["outputs"]["runs"]["rows"] == done.runs.count()
    assert facts["inputs"]["responses"]["rows"] == responses.count() and {"output": "runs", "input": "responses"} in json.loads(rows["replay"].lineage)
