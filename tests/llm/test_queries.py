"""Every registered query of the training-data operators on the smallest tables, next to its SQL where there is one."""

import os

import pytest

import corpus_pipeline
from readlake.llm.queries import ORACLE, QUERIES
from tests.compare import compare, duck

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    compare(spark, duck(FOLDER), FOLDER, name, QUERIES[name], ORACLE.get(name))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns[: len(names)] == names and 0 < got.count() < docs.count()
    compare(spark, None, FOLDER, "pipeline", lambda *_: got, None)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "decontamination", "mixing"]


def test_stages_on_messy_rows(spark, messy, nothing):
    for docs in (messy, nothing):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, FOLDER)
            if name != "mixing":
                assert got.columns == docs.columns
            got.count()
