"""Every registered query against its SQL on the smallest tables; those without SQL must run and have rows."""

import oracle
import pytest

from assayer.jobs.registry import ORACLES, QUERIES

MAY_BE_EMPTY = {"group_overlap", "singleton_groups", "anti_unseen", "star_top_orders", "minhash_est"}


@pytest.fixture(scope="module")
def duck():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, duck, name):
    oracle.compare(QUERIES[name](spark, oracle.SF), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, oracle.SF).count() > 0
