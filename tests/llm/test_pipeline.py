"""The pipeline's stages on the smallest tables, each against a plain version of its decision."""

import os

import pytest

import corpus_pipeline
from genoloom.llm import bpe, decontam, jaccard, quality, registry, secrets
from tests.llm.test_corpus import classes, leaks, scores

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]
    good = stages["quality"](spark, docs, DATA).cache()
    scores = {r.doc_id: r.predicted for r in quality.classify(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    assert good.columns == names and {r.doc_id for r in good.collect()} == {i for i, p in scores.items() if p}
    one = stages["near_duplicates"](spark, good, DATA).cache()
    assert one.columns == names and {r.doc_id for r in one.collect()} == {c for _, c in classes([(r.doc_id, r.text) for r in good.collect()], 5, 80).values()}
    clean = stages["decontamination"](spark, one, DATA).cache()
    leaks = {r.doc_id for r in decontam.find_leaks(one, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert clean.columns == names and {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - leaks
    masked = {r.doc_id: r for r in stages["secrets"](spark, clean, DATA).collect()}
    by = secrets.Scanner(dictionary=secrets.identifier_dictionary(clean))
    assert set(masked) == {r.doc_id for r in clean.collect()}
    assert all(masked[r.doc_id].text == secrets.mask(r.text, by=by) and not secrets.base_spans(masked[r.doc_id].text or "") for r in clean.collect())
    ids = stages["tokens"](spark, clean, DATA).collect()
    assert {r.doc_id for r in ids} == set(masked) and all(len(r.ids) == 4 * r.n_tokens for r in ids)


def test_run_equals_its_stages_in_plain_form(spark):
    """run() over the whole table: rows that the classifier accepts, the first of each class, without leaks, masked, as the tokenizers library encodes them."""
    import struct

    from tokenizers import Tokenizer

    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")
    docs = {r.doc_id: r.text for r in read("documents").collect()}
    score = scores(docs, {r.doc_id: r.quality for r in read("labels").collect() if r.quality is not None}, 256)
    good = [(i, t) for i, t in docs.items() if score[i] >= 0.3]
    first = {c for _, c in classes(good, 5, 80).values()}
    one = [(i, t) for i, t in good if i in first]
    leaked = {i for i, _ in leaks(one, [(r.item_id, r.text) for r in read("benchmark").collect()])}
    clean = [(i, t) for i, t in one if i not in leaked]
    by = secrets.Scanner(dictionary=secrets.identifier_dictionary(spark.createDataFrame(clean, "doc_id long, text string")))
    library = Tokenizer.from_file(bpe.default_path())
    ids = {i: library.encode(secrets.mask(t, by=by) or "", add_special_tokens=False).ids for i, t in clean}
    got = {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == {i: (len(x), struct.pack(f"<{len(x)}I", *x)) for i, x in ids.items()}


def test_empty_input(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_registry():
    names = list(registry.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert jaccard.HOT_SHARE > 0
