import pytest

import __spark_entry__ as E
from tests.harness import TESTDATA, compare

CORE = {k for m in E.MODULES for k in getattr(m, "oracle_sql", dict)()}


@pytest.mark.parametrize("name", sorted(CORE))
def test_matches_sql(spark, name):
    got, want, extra, missing = compare(spark, E.queries()[name], E.oracle_sql()[name], f"{TESTDATA}/sf0.01")
    assert not extra and not missing, (got, want, extra, missing)


def test_entry_runs(spark):
    assert E.entry(spark).columns
