import pytest

from loggrove.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, differences


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], connect(sf_dir)) == ""
