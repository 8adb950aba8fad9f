"""The lines that pairs name are cut from a few documents only, whatever pieces texts are hashed in."""

import random

import numpy as np
import pyarrow as pa
import test_llm_operators as base
from pyspark.sql import functions as F

from assayer.llm import line_dedup, vec


def test_pieces_give_the_same_lines(monkeypatch):
    rng = random.Random(3)
    texts = ["\n".join(" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(12))) for _ in range(rng.randrange(9))) for _ in range(200)] + ["", None, "x " * 400]
    chunk = next(vec.chunks(pa.array(texts)))
    rank = np.random.default_rng(1).permutation(1 << line_dedup.COUNT_BITS).astype(np.uint64)
    whole = line_dedup._lines(chunk, rank, np.argsort(rank).astype(np.uint64))
    monkeypatch.setattr(line_dedup, "PIECE", 300)
    cut = line_dedup._lines(chunk, rank, np.argsort(rank).astype(np.uint64))
    assert all(np.array_equal(getattr(whole, k), getattr(cut, k)) for k in vars(whole)) and len(whole.row) > 300


def test_only_documents_of_candidates_are_cut_again(spark, monkeypatch):
    """The whole sets of two near lines are read from their documents, not from all."""
    rng = random.Random(8)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = [" ".join(some(20)) for _ in range(60)]
    line = some(30)
    texts[7], texts[41] = " ".join(line), " ".join(line[:-1] + some(1))
    marks = []
    plain = line_dedup._word_sets

    def watched(docs, id_col, text_col, wanted, homes):
        marks.append(np.flatnonzero(homes).tolist())
        return plain(docs, id_col, text_col, wanted, homes)

    monkeypatch.setattr(line_dedup, "_word_sets", watched)
    found = line_dedup.later_matches(base.docs(spark, texts)).collect()
    assert [(r.id, list(r.removed)) for r in found] == [(41, [0])] and marks[0] == [7, 41]


def test_marks_are_read_by_one_job_whatever_the_partitions(spark):
    """Many shuffle partitions, which nothing joins again, gave a job each."""
    keys = spark.range(3000).select((F.col("id") * 7919).alias("key1"))
    held = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    group = "marks of many partitions"
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup(group, group)
        marks = line_dedup._marked(keys)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert np.flatnonzero(marks).tolist() == sorted({k * 7919 % (1 << line_dedup.MARK_BITS) for k in range(3000)})
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 3


def test_wanted_words_are_posted_from_their_rows_only(spark, monkeypatch):
    """The postings of a few words are the same, and rows without these aren't cut into lines."""
    rng = random.Random(5)
    docs = base.docs(spark, ["\n".join(" ".join(f"w{rng.randrange(4000)}" for _ in range(12)) for _ in range(3)) for _ in range(300)] + [None, ""]).coalesce(1)
    rank = np.random.default_rng(1).permutation(1 << line_dedup.COUNT_BITS).astype(np.uint64)
    how = ("doc_id", "text", rank, np.argsort(rank).astype(np.uint64), 0.8, False)
    rows = [tuple(r) for r in line_dedup._postings(docs, *how).collect()]
    marks = np.zeros(1 << line_dedup.MARK_BITS, bool)
    marks[[r[0] & (len(marks) - 1) for r in rows[:5]]] = True
    some = [tuple(r) for r in line_dedup._postings(docs, *how, marks).collect()]
    assert sorted(some) == sorted(r for r in rows if marks[r[0] & (len(marks) - 1)]) and some
    texts = pa.array([r.text for r in docs.select("text").collect()])
    assert len(line_dedup._rows_with(texts, marks)) < 60


def test_far_ids_are_ordered_as_near_ones(spark):
    """Ids that leave no room for a line's number beside them, and a null one."""
    words = [f"x{k}" for k in range(12)]
    near, lone = " ".join(words), " ".join([*words[:-1], "y"])
    for ids in ([5, 7, 9], [-(1 << 62), 3, 1 << 62], [None, -4, 1 << 43], [-(1 << 43), 0, (1 << 43) - 1]):
        docs = spark.createDataFrame(list(zip(ids, [near, "z\n" + near + "\nz", lone + "\nq r"])), "doc_id long, text string").repartition(3)
        assert {r.id: list(r.removed) for r in line_dedup.later_matches(docs).collect()} == {ids[1]: [1, 2], ids[2]: [0]}
