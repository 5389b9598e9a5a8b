import pytest

from txstream.plans import dataflow, streams, workloads

from .compare import same

assert dataflow.NAMES
FOUND, SQL = workloads.QUERIES | streams.QUERIES, workloads.ORACLE_SQL | streams.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(FOUND))
def test_query_gives_what_its_sql_gives(spark, name):
    same(spark, FOUND[name], SQL[name])
