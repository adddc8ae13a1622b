"""The pipeline's stages against plain versions, each on its own input."""

import numpy as np

import corpus_pipeline as cp
from tandem.llm import byte_bpe, decontaminate, suffix_dedup, toxicity
from tandem.llm.util import stored
from tests.llm import brute
from tests.llm.test_operators import brute_classes, plain_encoding

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    kept = []
    for name, stage in cp.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF), name)
        kept.append((name, rows(before), rows(docs)))
        assert name == "byte_bpe" or docs.columns == before.columns
    (_, b, a), *_ = kept
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet").limit(150), labels)
    assert set(a) == {i for i, r in b.items() if model.severity(np.array([sum(map(model.weight, toxicity.words_of(r.text)))]))[0] < model.reject}
    _, b, a = kept[1]
    classes = brute_classes([(i, r.text) for i, r in b.items()])
    assert set(a) == {c for _, c in classes}
    _, b, a = kept[2]
    removed = {i: n for i, _, n, _, _ in brute.byte_dedup([(i, r.text) for i, r in b.items()])}
    assert set(a) == set(b)
    for i in b:
        assert len(b[i].text.encode()) - removed[i] - 6 <= len(a[i].text.encode()) <= len(b[i].text.encode()) - removed[i]
        assert removed[i] or a[i] == b[i]
    _, b, a = kept[3]
    items = [tuple(x) for x in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hits = {i: (n, h) for i, n, h, *_ in brute.contamination([(i, r.text) for i, r in b.items()], items)}
    assert set(a) == {i for i, (n, h) in hits.items() if h <= 0.5 * n}
    assert all(len(decontaminate.words_of(r.text.encode())) == hits[i][0] - hits[i][1] and r.n_chars == len(r.text) for i, r in a.items())
    _, b, a = kept[4]
    plain = plain_encoding()
    for i, r in b.items():
        ids = plain.encode_ordinary(r.text)
        assert (a[i].n_tokens, a[i].ids_sha256, a[i].decoded_sha256) == (len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(r.text.encode()))


def test_run_applies_all_stages(spark):
    assert cp.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none = docs.limit(0)
    assert suffix_dedup.without_repeats(none).collect() == [] and byte_bpe.tokenize(none).collect() == []
    for name, stage in cp.STAGES[1:]:
        assert stage(spark, none, SF).collect() == [], name
