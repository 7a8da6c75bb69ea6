import pytest

from commitlake import catalog
from tests.compare import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_against_sql(spark, name):
    assert_same(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], SF)
