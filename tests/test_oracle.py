"""Every query with oracle SQL, on the smallest driver tables."""

import os

import pytest

from plazalens import catalog
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_names_belong_together():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_oracle(spark, con, name):
    status, note = compare(spark, con, FOLDER, name)
    assert status in ("ok", "EMPTY"), note
