import pytest

from plexloom.plans import more  # noqa: F401  (adds queries)
from plexloom.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert check(df, ORACLE_SQL[name], SF) is None
    else:
        assert df.count() >= 0
