import pytest

import __spark_entry__ as E
from tests.conftest import SF001

NAMES = sorted(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_runs_on_smallest_scale(spark, name):
    df = E.queries()[name](spark, SF001)
    assert len(df.columns) > 0
    df.write.format("noop").mode("overwrite").save()
