"""Every query that SQL can express equals its DuckDB twin."""

import parity
import pytest

from larkspur import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_equals_sql(spark, name):
    assert parity.compare(spark, catalogue.QUERIES[name], catalogue.ORACLE[name], SF) == ""


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.ORACLE.keys()))
def test_runs_twice_alike(spark, name):
    once, again = (sorted(map(tuple, catalogue.QUERIES[name](spark, SF).collect()), key=repr) for _ in range(2))
    assert once and once == again
