"""The pipeline against its stages done one by one in plain Python."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from shelfmark.llm import classifier, rules
from tests.llm.test_packing import check
from tests.llm.test_simhash import plain_fingerprint, plain_groups

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_stages(spark, docs):
    """All but the last give back the columns of the documents."""
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "quality_rules", "simhash_near_dedup", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert 0 < out.count() < docs.count()


def test_run(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = {r.doc_id for r in classifier.classify(docs, labels).collect() if r.predicted}
    left = docs.where(docs.doc_id.isin(list(good)))
    good = {r.doc_id for r in rules.judge(left).collect() if r.kept}
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if r.doc_id in good]
    groups = plain_groups([plain_fingerprint(t) for _, t in rows])
    texts = {i: t for k, (i, t) in enumerate(rows) if groups[k] == k}
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    padding = check(pieces, texts, tokenizer)
    assert padding <= 0.02 * sum(p.length for p in pieces)
    assert 0 < len(texts) < docs.count()


def test_clean_documents_stay(spark, docs):
    """Of the documents labelled good that pass the fixed rules, nearly all are still there
    before near-duplicates go."""
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    fine = {r.doc_id for r in rules.judge(docs).where("NOT base_failed").join(
        labels.where("quality = 1"), "doc_id").collect()}
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, kept, FOLDER)
    kept = {r.doc_id for r in kept.collect()}
    assert len(fine & kept) >= 0.97 * len(fine)
