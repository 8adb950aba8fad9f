"""Every mark that starts a copyright line is removed, as in the query's SQL."""

import duckdb
import test_llm_operators as base

from assayer.llm import license_scan, queries


def test_each_mark_as_in_sql(spark):
    texts = [f"{mark} 2024 Acme\nReleased under the MIT License." for mark in ("(c)", "(C)", "  \t(c)", "©", "Copyright", "x (c)")]
    texts += ["(c) 2024 Acme", "a (c) b\nsee (c)"]
    got = {r.doc_id: (r.digest, r.license, r.n_lines) for r in license_scan.scan_licenses(base.docs(spark, texts)).collect()}
    assert [got[k][1] for k in range(6)] == ["MIT"] * 5 + [None]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    rows = duck.execute(f"SELECT doc_id, digest, license, n_lines FROM ({queries.ORACLES['op10_license_scan']})").fetchall()
    assert got == {k: tuple(rest) for k, *rest in rows}
