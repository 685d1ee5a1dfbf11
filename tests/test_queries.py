"""Every query of the library against its SQL, on the smallest tables."""

import os
import sys

sys.path.insert(0, os.path.dirname(__file__))

import pytest
from compare import assert_same

from veriloom.plans import catalog

ORACLE = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    if name in ORACLE:
        assert_same(df, duck, ORACLE[name])
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
