import pytest
from compare import DATA, spark_rows, sql_rows

from vellumine.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, str(DATA))) == sql_rows(queries.oracle_sql()[name])
