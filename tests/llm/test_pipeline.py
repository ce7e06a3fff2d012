"""The pipeline's stages one after another, each against brute force on what it was given."""

import collections

import corpus_pipeline
from loglake.llm import quality
from loglake.llm.common import Scratch
from tests.llm.test_operators import brute_components, brute_lines


def test_stages(spark, small):
    scratch = Scratch(spark, "test-pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.write(stage(spark, docs, small), name)
        steps[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    before, after = steps["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after}
    known = [r["doc_id"] for r in before if r["doc_id"] in labels]
    assert sum((i in kept) == (labels[i] == 1) for i in known) > 0.95 * len(known)
    df = spark.read.parquet(f"{small}/documents.parquet")
    scores = {r.doc_id: r.score for r in quality.score(df, quality.fit(df, spark.read.parquet(f"{small}/labels.parquet"))).collect()}
    assert kept == {i for i, s in scores.items() if s >= 0.5}
    before, after = steps["lines"]
    want = dict(brute_lines([(r["doc_id"], r["text"]) for r in before], 20))
    assert {r["doc_id"]: r["text"] for r in after if r["text"]} == {i: t for i, t in want.items() if t}
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = steps["near"]
    want = {i for i, _, _, keep in brute_components([(r["doc_id"], r["text"]) for r in before], 5, 80) if keep}
    assert sorted(r["doc_id"] for r in after) == sorted(want)
    before, after = steps["benchmark"]
    items = [r.text.split() for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    bad = {r["doc_id"] for r in before if any(" ".join(w) in " ".join((r["text"] or "").split()) for w in items)}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert bad <= gone and len(gone) <= len(bad) + 2
    before, after = steps["packing"]
    assert {r["doc_id"] for r in before} == {r["doc_id"] for r in after}
    used = collections.Counter()
    for r in after:
        used[r["sequence_id"]] += r["length"]
    assert all(n <= 1024 for n in used.values())
    assert sum(used.values()) == sum({r["doc_id"]: r["doc_tokens"] for r in after}.values())
