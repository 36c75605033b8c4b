"""Every registered query against its SQL, or for rows where SQL cannot express it."""

import os

import pytest

from compare import connect, differences
from locusframe.plans import CHECKS, QUERIES

FOLDER = os.environ.get("LOCUSFRAME_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_against_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, CHECKS[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
