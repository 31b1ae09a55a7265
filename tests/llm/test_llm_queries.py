"""Every registered query on training text against its check SQL, or a count of its documents where SQL ends."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from curatorium.llm.queries import CHECKS, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in CHECKS:
        _, problems = compare(df, con, CHECKS[name])
        assert not problems
        return
    # beyond SQL; the operators' own tests hold them against brute force, here every document must come back
    ids, docs = df.select("doc_id"), spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id")
    assert ids.count() == docs.count() and docs.exceptAll(ids).isEmpty()


def test_the_entry_has_them_and_the_pipeline():
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
