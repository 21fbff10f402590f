"""Every registered query of the layout operators against its SQL on the smallest tables."""

import oracle
import pytest

from lodeplane.plans.queries import QUERIES
from lodeplane.plans.sql import SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) or name == "empty_halo_points"
    if name in SQL:
        assert not oracle.differences(got, con.execute(SQL[name]).df())


def test_sql_belongs_to_queries():
    assert not set(SQL) - set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() and "convergence" in df.columns
