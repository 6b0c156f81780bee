import pytest

from quern.llm.queries import ORACLES, QUERIES
from tests import oracle

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert oracle.spark_rows(QUERIES[name](spark, SF)) == oracle.duck_rows(oracle.connect(SF), ORACLES[name])
