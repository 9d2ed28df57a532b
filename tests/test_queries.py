"""Every query of the library against its SQL on the smallest tables."""

import pytest

from inkspark.plans import catalog
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert difference(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name]) == ""


def test_flagship_has_rows(spark):
    assert catalog.flagship(spark, SF).count() > 100
