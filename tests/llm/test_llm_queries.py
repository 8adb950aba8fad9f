"""The registered queries against their SQL on the smallest tables, and the pipeline."""

import oracle
import pytest

import corpus_pipeline
from assayer.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, duck, name):
    oracle.compare(QUERIES[name](spark, oracle.SF), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_a_row_for_each_document(spark, name):
    rows = QUERIES[name](spark, oracle.SF)
    assert rows.select("doc_id").distinct().count() == spark.read.parquet(f"{oracle.SF}/documents.parquet").count()


def test_held_out_toxicity(spark):
    rows = QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = rows.join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    assert sum(r.predicted for r in got if not r.toxic) == 0 and sum(r.predicted for r in got if r.toxic) >= 0.6 * sum(r.toxic for r in got)


def test_quality_separates_held_out(spark):
    rows = QUERIES["op8_quality_classifier"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = rows.join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").select("kept", "quality").collect()
    assert sum(r.kept for r in got if r.quality) >= 0.9 * sum(r.quality for r in got)
    assert sum(r.kept for r in got if not r.quality) <= 0.5 * sum(1 - r.quality for r in got)


def test_pipeline_stages(spark):
    out = corpus_pipeline.run(spark, oracle.SF)
    docs = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    kept = out.select("doc_id").distinct()
    assert 0 < kept.count() < docs.count() and kept.join(docs, "doc_id", "left_anti").count() == 0
