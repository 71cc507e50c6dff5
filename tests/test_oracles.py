"""Every query of the evidence engine that SQL expresses gives what its SQL gives."""

import pytest

from claimweave.plans import ORACLES, QUERIES
from tests.support import SF, duck, duck_rows, spark_rows


@pytest.fixture(scope="module")
def c():
    return duck()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, c, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(c, ORACLES[name])
