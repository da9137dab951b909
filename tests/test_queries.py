"""Every query of the library against the SQL that states its result; those of the training data operators have their own tests."""

import pytest

from __spark_entry__ import entry
from labelmill.plans.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["row_id", "lang", "prompt_tokens", "quality", "toxic"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, FOLDER, QUERIES, ORACLES) > 0


@pytest.mark.parametrize("name", ["batch_list", "merge_hot", "merge_rounds", "batch_status", "batch_progress_logged", "stream_upsert", "stream_status"])
def test_query_on_more_rows(spark, name):
    folder = "/root/testdata/sf0.01"
    assert compare(spark, connect(folder), name, folder, QUERIES, ORACLES) > 0
