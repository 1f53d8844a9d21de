import os

import pytest
from oracle import same_rows

from graphloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    same_rows(QUERIES[name](spark, FOLDER), ORACLES[name], FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_pipeline_keeps_columns_and_clean_documents(spark):
    import corpus_pipeline

    from graphloom.llm.common import read, written

    docs = read(spark, FOLDER, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER), f"test-{name}")
        assert name == "byte_bpe" or docs.columns == columns
        after = docs.count()
        assert after <= before and (name not in ("line_dedup", "byte_bpe") or after == before)
        before = after
    assert before >= 100
