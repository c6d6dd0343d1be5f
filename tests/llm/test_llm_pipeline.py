"""The pipeline's stages, one after another, against what each promises."""

import hashlib
import os
from collections import Counter

import pytest

import corpus_pipeline

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], SF_DIR)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    known, single, apart, mixed, tokens = ([r.asDict() for r in x.collect()] for x in seen[1:])
    assert len(known) >= 0.97 * docs.count()
    texts = Counter((r["text"] or "").lower() for r in single)
    assert max(texts.values()) == 1
    ids = {r["doc_id"] for r in single}
    assert {r["doc_id"] for r in apart} <= ids
    text = {r["doc_id"]: r["text"] for r in apart}
    copies = Counter(r["doc_id"] for r in mixed)
    assert set(copies) <= set(text) and max(copies.values()) <= 3
    assert Counter(r["doc_id"] for r in tokens) == copies
    assert all(r["decoded_sha256"] == hashlib.sha256((text[r["doc_id"]] or "").encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) for r in tokens)


def test_stages_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
