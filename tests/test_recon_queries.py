import pytest

import __spark_entry__
from tallyframe.plans import io_queries, recon_queries

QUERIES, ORACLES = recon_queries.QUERIES | io_queries.QUERIES, recon_queries.ORACLES | io_queries.ORACLES


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])


def test_entry(spark, sf_dir):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_is_registered():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())
