"""The pipeline's stages over the smallest tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm.stored import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    scratch, docs, out = Scratch(spark, "test"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append((docs, scratch.store(stage(spark, docs, SF))))
        docs = out[-1][1]
    return out


def test_columns_stay_until_the_last(stages):
    assert all(after.columns == before.columns for before, after in stages[:-1])


def test_each_stage_keeps_rows_of_its_input(stages):
    for before, after in stages[:3]:
        assert after.join(before, after.columns, "left_anti").where(F.col("text").isNotNull()).count() == 0
    assert stages[3][0].count() == stages[3][1].count()


def test_one_of_each_class_stays(spark, stages):
    classes = corpus_pipeline.near_duplicate_classes(stages[1][0])
    want = {r[0] for r in classes.select("component_id").distinct().collect()}
    assert {r["doc_id"] for r in stages[1][1].select("doc_id").collect()} == want


def test_packed_tokens_are_the_documents(stages):
    docs, packed = stages[4]
    words = docs.agg(F.sum(corpus_pipeline.token_count(F.col("text")))).first()[0]
    assert packed.agg(F.sum("n_tokens")).first()[0] == words


def test_rows_without_ids_pass(spark):
    rows = spark.createDataFrame([(None, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, None)], "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, rows, SF).collect()
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in got) == [(0, "a b c d e f g"), (1, "a b c d e f g"), (3, "")]
