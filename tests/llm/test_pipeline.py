"""The pipeline's stages, one after another, on the smallest tables."""

import re

import corpus_pipeline
from tests.llm.test_llm_operators import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).persist()
        assert docs.columns == columns and 0 < docs.count() <= kept[-1].count()
        kept.append(docs)
    # quality: what stays has fifty words and not mostly repeated ones
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) >= 50 for r in kept[2].collect())
    # near duplicates: exactly the smallest id of each group
    before = sorted(kept[2].collect(), key=lambda r: r.doc_id)
    groups = brute([r.text for r in before], 5, 80)
    assert sorted(r.doc_id for r in kept[3].collect()) == sorted({before[c].doc_id for _, c in groups})
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
