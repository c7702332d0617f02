"""Every query of the package against its SQL, at the small scale."""

import pytest

from tests.compare import compare, connect
from tidemark.plans import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    result = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLE_SQL:
        assert compare(result, con, queries.ORACLE_SQL[name]) == ""
    else:
        assert result.count() > 0
