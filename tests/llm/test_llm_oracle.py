import pytest
from verify_oracle import connect, same

from plumbline.llm import registry


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query(spark, name):
    d = "/root/testdata/sf0.001"
    same(spark, connect(d), d, name)
