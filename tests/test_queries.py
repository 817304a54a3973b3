"""Every query of the catalogue against its SQL; those without SQL give rows."""

import pytest

from shotlake.plans import registry
from tests.oracle import agree, connect

SF = "/root/testdata/sf0.001"
PAIRS = {k: (v, m.ORACLE.get(k)) for m in registry.modules() for k, v in m.QUERIES.items()}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [k for k, v in PAIRS.items() if v[1]])
def test_same_as_sql(spark, con, name):
    agree(spark, con, *PAIRS[name], SF)


@pytest.mark.parametrize("name", [k for k, v in PAIRS.items() if not v[1]])
def test_gives_rows(spark, name):
    assert PAIRS[name][0](spark, SF).count() > 0
