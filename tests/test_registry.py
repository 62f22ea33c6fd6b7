"""Every registered query against its SQL twin on the smoke tables."""

import __spark_entry__ as contract
import pytest
from compare import compare, duck
from conftest import SMOKE

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMOKE)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


# The training-data queries have tests of their own in tests/llm.
@pytest.mark.parametrize("name", [n for n in QUERIES if not (n == "pipeline" or n.startswith("op"))])
def test_query(spark, con, name):
    problem, _ = compare(spark, con, QUERIES[name], ORACLES.get(name), SMOKE)
    assert problem is None, problem


def test_entry(spark):
    row = contract.entry(spark).collect()
    assert len(row) == 1 and row[0]["clips"] > 0
