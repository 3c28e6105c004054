"""Every registered query with SQL agrees with DuckDB; the others give rows."""

import pytest

import oracle
from encoscope.plans import load_all

REGISTRY = load_all()


@pytest.fixture(scope="module")
def con():
    return oracle.connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    item = REGISTRY[name]
    if item.sql is None:
        assert item.run(spark, "/root/testdata/sf0.001").count() > 0
    else:
        report = oracle.difference(spark, name, item, con, "/root/testdata/sf0.001")
        assert report is None, report
