"""The five stages on a planted fixture against a plain Python version of them."""

import random

import corpus_pipeline
import test_llm_operators as base
import test_near_copies as near

from assayer.llm import decontaminate  # noqa: F401  the operators of the stages
from assayer.llm import packing


def fixture():
    rng = random.Random(21)
    words = [f"word{k}" for k in range(3000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts, toxic = [], []
    passage, bench = some(60), [some(14) for _ in range(5)]
    for k in range(700):
        lines = [some(rng.randint(6, 30)) for _ in range(rng.randint(1, 4))]
        if k % 7 == 0:
            lines[0] += " utter idiot"
        if k % 50 == 3:
            lines.append(passage)
        if k % 60 == 5:
            lines[-1] += f" {bench[k % 5]} end"
        texts.append("\n".join(lines))
        toxic.append(int(k % 7 == 0))
    for k in range(1, 200, 9):  # near copies: one word of a long single line changed
        if k % 7:
            line = some(90).split()
            for copy in range(3):
                own = list(line)
                own[rng.randrange(90)] = rng.choice(words)
                texts.append(" ".join(own) + "\n" + some(8))
                toxic.append(0)
    texts += ["", "   ", "Tiny"]
    toxic += [0, 0, 0]
    return texts, toxic, bench


def plain(texts, toxic, bench):
    """Ids and texts that each stage keeps; the classifier stands for the planted words."""
    stages = []
    now = {k: t for k, t in enumerate(texts) if not toxic[k]}
    stages.append(dict(now))
    order = sorted(now)
    gone = base.removed_lines([now[k] for k in order], 0.8)
    for at, k in enumerate(order):
        if at in gone:
            left = [s for j, s in enumerate(now[k].split("\n")) if j not in gone[at]]
            now[k] = "\n".join(left) if "".join(left).strip() else None
    now = {k: t for k, t in now.items() if t is not None}
    stages.append(dict(now))
    order = sorted(now)
    root = near.groups([now[k] for k in order])
    now = {k: now[k] for at, k in enumerate(order) if root[at] == at}
    stages.append(dict(now))
    windows = {tuple(b.split()[k : k + 10]) for b in bench for k in range(5)}
    hit = lambda t: any(tuple(t.lower().split()[k : k + 10]) in windows for k in range(len(t.split()) - 9))
    now = {k: t for k, t in now.items() if not hit(t)}
    stages.append(dict(now))
    return stages


def test_stages_by_plain_python(spark, tmp_path):
    texts, toxic, bench = fixture()
    base.docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, t) for k, t in enumerate(toxic) if k % 10], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = base.docs(spark, texts)
    sizes = []
    for (name, stage), want in zip(corpus_pipeline.STAGES[:4], plain(texts, toxic, bench)):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert {r.doc_id: r.text for r in docs.collect()} == want, name
        sizes.append(len(want))
    assert len(texts) > sizes[0] >= sizes[1] > sizes[2] > sizes[3] > 0
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = {k: len(t.split()) for k, t in want.items()}
    assert {r.doc_id for r in packed} == set(want)
    assert all(sum(r.n_tokens for r in packed if r.doc_id == k) == n for k, n in list(tokens.items())[:50])
    bins = {}
    for r in packed:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    assert all(sum(r.n_tokens for r in b) <= packing.CAPACITY and sorted(r.slot for r in b) == list(range(len(b))) for b in bins.values())


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame(base.ROWS, base.SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (rows, rows.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            assert name == "best_fit_packing" or docs.columns == rows.columns
        docs.collect()
