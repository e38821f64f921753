"""The pipeline against its stages done by hand on the smallest tables."""
from collections import Counter

import corpus_pipeline
from kinetide.llm.quality import quality
from kinetide.llm.secret_scan import dictionary, find_secrets, hide
from test_ngram_join import classes

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import public_tokenizers

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        seen.append([r.asDict() for r in docs.collect()])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == documents.columns
            docs = spark.createDataFrame([tuple(r.values()) for r in seen[-1]], documents.schema)
    good = {r.doc_id for r in quality(documents).where("kept").collect()}
    assert {r["doc_id"] for r in seen[0]} == good
    texts = {r["doc_id"]: r["text"] for r in seen[0]}
    first = {c for _, c in classes(list(texts.items()), 5, 80, 100).values()}
    assert sorted(r["doc_id"] for r in seen[1]) == sorted(first)
    words = dictionary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for r in seen[2]:
        assert r["text"] == hide(texts[r["doc_id"]], find_secrets(texts[r["doc_id"]], words)[0]) and r["n_chars"] == len(r["text"])
    copies = Counter(r["doc_id"] for r in seen[3])
    assert set(copies.values()) <= {1, 2} and set(copies) <= first
    assert Counter(r["doc_id"] for r in seen[4] if r["piece"] == 0) == copies


def test_odd_rows_pass(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0
