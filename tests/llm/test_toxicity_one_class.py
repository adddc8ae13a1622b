"""Toxicity without labelled rows of both classes: a defined result, nothing rejected."""

import pytest

import corpus_pipeline as cp
from tandem.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_all_stages_take_empty_tables(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, none, SF).collect() == [], name


@pytest.mark.parametrize("toxic", [0, 1, None])
def test_one_class_rejects_nothing(spark, toxic):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, toxic), (2, toxic)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert sorted((x.doc_id or 0, x.severity, x.grade, x.rejected) for x in got) == [(i, 0.0, 0, False) for i in range(3)]
