"""Registered queries against their SQL; the pipeline against its stages' definitions."""

import pytest

import corpus_pipeline
from compare import connect, differences
from locusframe.llm.queries import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_against_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, CHECKS[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_one_row_per_document(spark, con, name):
    assert QUERIES[name](spark, FOLDER).count() == con.execute("SELECT count(*) FROM documents").fetchone()[0]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, FOLDER)
        assert after.columns == columns and 0 < after.count() <= kept.count(), name
        kept = spark.createDataFrame(after.collect(), after.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, FOLDER)
    assert last.count() == kept.count()
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted(whole.collect()) == sorted(last.collect())


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
        if "text" in docs.columns:
            docs = spark.createDataFrame([], docs.schema)
