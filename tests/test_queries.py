import pytest

from lakeloom import registry
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF).toPandas(), registry.ORACLE_SQL[name], SF)
