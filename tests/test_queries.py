"""Every registered query against its SQL; queries without SQL must give rows with stable columns."""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry_module
from widecast.registry import registered

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.01")
QUERIES = registered()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_agrees_with_sql(name, spark, duck):
    assert differences(QUERIES[name].run(spark, SF), duck, QUERIES[name].sql) is None


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.sql))
def test_gives_rows(name, spark):
    df = QUERIES[name].run(spark, SF)
    assert df.count() > 0
    if "p0" in df.columns:
        total = df.selectExpr("max(abs(p0 + p1 + p2 + p3 + p4 - 1)) AS off").first()["off"]
        assert total < 1e-5


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["label", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    assert df.count() == 5


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
