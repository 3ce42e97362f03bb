import os

import pytest

from srclens.plans.registry import FLAGSHIP, ORACLE, QUERIES
from tests.oracle import DATA, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLE:
        same(df, ORACLE[name])
    else:
        assert df.count() > 0


def test_flagship():
    assert FLAGSHIP in QUERIES
