"""The pipeline's stages against plain versions, and the classifiers against held-out labels, on the small tables."""

import os

import pytest
from test_operators import plain_components

import corpus_pipeline
from lodestar.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "clean", "distinct", "pack"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = stages["language"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, t in texts.items() if t and any(c.isalpha() for c in t)}
    clean = stages["clean"](spark, kept, SF).cache()
    assert clean.columns == docs.columns and clean.count() <= kept.count()
    rows = sorted((r.doc_id, r.text) for r in clean.collect())
    distinct = stages["distinct"](spark, clean, SF).cache()
    want = {k for k, n, c in plain_components(rows) if n == 0 or c == k}
    assert {r.doc_id for r in distinct.collect()} == want
    packed = stages["pack"](spark, distinct, SF).collect()
    assert {r.doc_id for r in packed} == want
    assert all(sum(p.length for p in packed if p.doc_id == k) == next(p.doc_tokens for p in packed if p.doc_id == k) for k in list(want)[:20])


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    found = [r for r in queries.queries()["op6_language"](spark, sf).collect() if r.held_out]
    assert sum(docs[r.doc_id] == r.lang_pred for r in found) / len(found) > 0.97


@pytest.mark.parametrize(("scale", "least"), [("sf0.01", 0.8), ("sf0.1", 0.9)])  # sf0.01 has four toxic training texts of some languages
def test_toxicity_on_held_out_rows(spark, scale, least):
    sf = f"/root/testdata/{scale}"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = [r for r in queries.queries()["op7_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    clean = [r for r in found if labels[r.doc_id] == 0]
    toxic = [r for r in found if labels[r.doc_id] == 1]
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert sum(r.predicted for r in toxic) >= least * len(toxic)
