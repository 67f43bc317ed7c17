"""Every query of the engine beside its SQL on the smallest tables."""

import pytest
from verify_oracle import connect, same

from plumbline.plans.catalogue import Q

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q))
def test_query(spark, name):
    same(spark, connect(D), D, name)


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0 and set(E.oracle_sql()) <= set(E.queries())
