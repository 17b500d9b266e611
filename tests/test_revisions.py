from decimal import Decimal

from quireloom.operators import revisions as R

SCHEMA = "document_id string, page_number int, block_id string, block_order int, text string"


def found(spark, *texts):
    b = spark.createDataFrame([("d", 1, f"b{i}", i, t) for i, t in enumerate(texts)], SCHEMA)
    return {r.block_ids[0]: r for r in R.deduplicate(R.text_revisions(b)).collect()}


def test_prose(spark):
    r = found(spark, "We raised adjusted diluted EPS FY2026E from EUR 2.00 to EUR 2.20 by 10%, consensus of EUR 2.10.", "We revised FY2026E adjusted EBIT margin from 10% to 12% by 2pp.", "We revised FY2027E cost of risk from 25bps to 30bps by 5bps.",
              "We raised revenue FY2026E from EUR 100m to EUR 110m by 8%.", "We raised EBIT FY2026E from EUR 0m to EUR 5m", "We raised revenue FY2030E from EUR 100m to USD 0.2bn", None, "", "We cut target price from USD 50 to USD 45 by 10%.", "Our important disclosures changed from 1 to 2 in FY26")
    eps, margin, risk, rev, ebit, mixed, target = (r[f"b{i}"] for i in (0, 1, 2, 3, 4, 5, 8))
    assert (eps.metric, eps.qualifiers, eps.period, eps.unit) == ("eps", ["adjusted", "diluted"], "FY2026E", "EUR/share")
    assert (eps.calc_pct, eps.old_vs_consensus, eps.new_vs_consensus) == (Decimal("10"), Decimal("-4.7619"), Decimal("4.7619")) and eps.confidence == "high" and eps.warnings == []
    assert (margin.calc_pp, margin.calc_pct) == (Decimal("2"), Decimal("20")) and (risk.stated_pp, risk.calc_pp) == (Decimal("0.05"), Decimal("0.05"))
    assert rev.warnings == ["stated_calculated_revision_mismatch"] and ebit.warnings == ["zero_old_value_no_relative_revision"]
    assert mixed.warnings == ["old_new_unit_mismatch"] and mixed.calc_pct is None and mixed.unit is None
    assert target.metric == "target_price" and target.period is None and target.direction == "decrease" and len(r) == 7


def test_inline_and_compact(spark):
    r = found(spark, "Change in EPS forecast FY26 new\n+3% FY2026E -2% FY2027E", "TP: EUR 12.5 (11) new 2026", "TP change in target price old\n5% raised 26")
    assert r["b1"].old_value == Decimal("11") and r["b1"].unit == "EUR" and r["b1"].method == "compact_target_header"
    assert r["b0"].method == "inline_stated_change" and "stated_change_without_old_new_values" in r["b0"].warnings and "b2" not in r


def test_consensus_only_if_unique(spark):
    b = spark.createDataFrame([("d", 1, "b", 0, "We raised EPS FY2026E from EUR 2.00 to EUR 2.20 now.")], SCHEMA)
    obs = "document_id string, page_number int, metric string, qualifiers array<string>, period string, unit string, value decimal(20,6), block_ids array<string>, seq int"
    row = ("d", 1, "eps", [], "FY2026E", "EUR/share", Decimal("2.1"), ["c"], 1)
    r = R.deduplicate(R.text_revisions(b))
    assert R.attach_consensus(r, spark.createDataFrame([row, row], obs)).collect()[0].new_vs_consensus == Decimal("4.7619")
    other = (*row[:6], Decimal("2.3"), ["c"], 2)
    assert R.attach_consensus(r, spark.createDataFrame([row, other], obs)).collect()[0].consensus_value is None
