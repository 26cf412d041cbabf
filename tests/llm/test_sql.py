import pytest

from tests.oracle import expected, found
from vgraph.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert found(QUERIES[name](spark, SF)) == expected(ORACLES[name], SF)
