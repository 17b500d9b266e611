from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quireloom.functions import finance as N


def one(spark, col):
    return spark.range(1).select(col.alias("x")).collect()[0].x


@pytest.mark.parametrize(("old", "new", "want"), [("100", "110", "10"), ("-100", "-80", "20"), ("-100", "-120", "-20"), ("2.1", "2.2", "4.7619"), ("0", "10", None)])
def test_relative(spark, old, new, want):
    got = one(spark, N.relative_pct(F.lit(Decimal(old)), F.lit(Decimal(new))))
    assert got == (Decimal(want) if want else None)


@pytest.mark.parametrize(("text", "metric"), [("Adj. EBITDA margin", "ebitda_margin"), ("our TP", "target_price"), ("total cost of risk", "total_cost_of_risk"), ("loans", "loans"), ("the loans", None), ("net profit", "net_income"), ("nothing", None)])
def test_metric(spark, text, metric):
    assert one(spark, N.metric_name(F.lit(text))) == metric


@pytest.mark.parametrize(("text", "want"), [("FY2026E", ("FY2026E", "fiscal")), ("1H26", ("H1 2026", "fiscal")), ("Q3 2027E", ("Q3 2027E", "fiscal")), ("06/26E", ("FY06/2026E", "fiscal")), ("CY 25", ("CY2025", "calendar")), ("45", ("2045", "unspecified")), ("12.5", None), ("x", None)])
def test_period(spark, text, want):
    got = one(spark, N.fiscal_period(F.lit(text)))
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(("text", "share", "value", "unit"), [
    ("EUR 2.20", True, "2.2", "EUR/share"), ("EUR 100m", False, "100", "EURm"), ("1.234,5", False, "1234.5", None), ("1,234.5", False, "1234.5", None), ("(12.5)", False, "-12.5", None), ("12,5", False, "12.5", None), ("1,234", False, "1234", None),
    ("30bps", False, "30", "basis_points"), ("-3%", False, "-3", "%"), ("2pp", False, "2", "percentage_points"), ("n.m.", False, None, None), ("$1bn", False, "1", "USDbn"), ("SEK5", False, "5", "SEK"), ("words", False, None, None),
])
def test_value(spark, text, share, value, unit):
    got = one(spark, N.parse_value(F.lit(text), F.lit(share)))
    assert got.value == (Decimal(value) if value else None) and got.unit == unit


def test_stated(spark):
    assert tuple(one(spark, N.stated_change(F.lit("cut by 30bps, or up 5%")))) == (None, Decimal("0.3"))
    assert tuple(one(spark, N.stated_change(F.lit("revision of c. 8,5%")))) == (Decimal("8.5"), None)
    assert one(spark, N.stated_consensus(F.lit("consensus of EUR 2.10."), F.lit(True))).value == Decimal("2.1")
