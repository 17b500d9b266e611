import pytest

from quireloom.llm import queries as Q
from tests.harness import TESTDATA, compare


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, name):
    got, want, extra, missing = compare(spark, Q.queries()[name], Q.oracle_sql()[name], f"{TESTDATA}/sf0.01")
    assert not extra and not missing, (got, want, extra, missing)
