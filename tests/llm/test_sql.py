import pytest

from tasteframe.llm.queries import ORACLE_SQL, QUERIES
from tests import oracle


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    oracle.compare(QUERIES[name](spark, sf), oracle.connect(sf), ORACLE_SQL[name])
