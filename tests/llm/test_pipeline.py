"""The pipeline's stages against plain versions, each on its own input."""

import re

import corpus_pipeline
from lodestone.llm import decontaminate, secrets

FOLDER = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, held = docs.columns, {r.doc_id: r for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, spark.createDataFrame(list(held.values()), docs.schema), FOLDER)
        assert out.columns == columns, name
        got = {r.doc_id: r for r in out.collect()}
        if i == 0:
            assert sum(labels.get(d, 1) == 0 for d in got) <= 2 and all(labels.get(d) != 1 for d in held.keys() - got.keys())
        if i == 1:
            sets = {d: shingles(r.text) for d, r in held.items()}
            for d in held.keys() - got.keys():
                assert any(o < d and near(sets[d], sets[o]) for o in held) or any(near(sets[d], sets[o]) for o in held if o != d)
            assert not any(near(sets[a], sets[b]) for a in got for b in got if a < b)
        if i == 2:
            wanted = [decontaminate.normal(t) for t in items]
            assert {d for d, r in held.items() if any(w in decontaminate.normal(r.text) for w in wanted)} <= held.keys() - got.keys()
            assert len(held) - len(got) < 0.1 * len(held) + 5
        if i == 3:
            novelty = secrets.Novelty()
            assert got.keys() == held.keys() and not any(secrets.ACCESS.search(r.text) or secrets.HEX.search(r.text) for r in got.values())
            assert all(got[d].text == r.text for d, r in held.items() if not secrets.spans_of(r.text, novelty)[1])
        held = got
    out = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(list(held.values()), docs.schema), FOLDER).collect()
    assert {r.doc_id for r in out} == held.keys() and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    assert {(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, FOLDER).collect()} == {(r.doc_id, r.n_tokens) for r in out}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return bool(a) and 100 * len(a & b) >= 80 * len(a | b)
