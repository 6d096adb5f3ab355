"""Every query of the inventory against DuckDB."""

import pytest
from conftest import DATA, same_rows

from angula.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    mine, theirs = same_rows(QUERIES[name](spark, DATA), duck, ORACLE[name])
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
