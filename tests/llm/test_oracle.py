"""Queries of this subpackage that SQL can express, against their SQL."""

import pytest

from plazalens.llm import catalog
from tests.oracle_check import canonical, connect

FOLDER = "/root/testdata/sf0.001"


def test_names():
    assert [f"op{n}_" for n in range(1, 14)] == sorted((q.split("_")[0] + "_" for q in catalog.QUERIES), key=lambda q: int(q[2:-1]))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_oracle(spark, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    assert canonical(got) == canonical(connect(FOLDER).execute(catalog.ORACLE[name]).fetchdf())
