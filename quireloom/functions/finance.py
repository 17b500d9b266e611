"""Metrics, fiscal periods, units, printed values and exact arithmetic as Columns.

Null in, null out. All arithmetic is decimal; ratios are rounded half up to four places.
"""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from quireloom.functions.columns import let, nonempty, spans

# Vocabularies and thresholds of the reference results.
CURRENCIES = ["AUD", "CAD", "CHF", "CNY", "DKK", "EUR", "GBP", "HKD", "JPY", "NOK", "SEK", "USD"]
PER_SHARE = ["eps", "dps", "book_value_per_share", "tangible_equity_per_share"]
TOLERANCE_PCT = 0.25
METRICS = [
    ("target_price", r"\b(?:target price|price target|price obj\.?|price objective|fair value|TP|PO)\b"), ("ebitda_margin", r"\bEBITDA\s+margin\b"), ("ebit_margin", r"\bEBIT\s+margin\b"),
    ("operating_margin", r"\boperating\s+margin\b"), ("gross_margin", r"\bgross\s+margin\b"), ("net_margin", r"\bnet\s+margin\b"), ("eps", r"\b(?:earnings per share|EPS)\b"),
    ("reinsurance_revenue_gross", r"\breinsurance revenue\s*\(gross\)"), ("reinsurance_revenue_net", r"\breinsurance revenue\s*\(net\)"), ("net_reinsurance_service_result", r"\bnet reinsurance service result\b"),
    ("reinsurance_service_result", r"\breinsurance service result\b"), ("revenue", r"\b(?:revenue|revenues|sales|turnover)\b"), ("ebitda", r"\bEBITDA\b"), ("ebit", r"\bEBIT\b"),
    ("operating_profit", r"\b(?:operating profit|operating income)\b"), ("pretax_profit", r"\b(?:pre-tax|pretax|profit before tax|PBT)\b"), ("net_income", r"\b(?:net income|net profit|net earnings)\b"),
    ("tax_rate", r"\b(?:tax rate|effective tax)\b"), ("tax", r"\b(?:tax expense|tax charge|taxation)\b"), ("net_interest_income", r"\b(?:net interest income|NII)\b"), ("net_fee_income", r"\bnet fee income\b"),
    ("trading_income", r"\btrading income\b"), ("insurance_income", r"\binsurance income\b|^insurance$"), ("other_income", r"\bother income\b"), ("total_income", r"\btotal income\b"),
    ("investment_income", r"\b(?:net investment income|investment income)\b"), ("interest_expense", r"\b(?:interest expense|interest cost)\b"), ("labour_costs", r"\b(?:labour|labor) costs?\b"),
    ("operating_expenses", r"\b(?:other )?operating expenses?\b"), ("depreciation", r"\bdepreciation\b"), ("total_cost_of_risk", r"\btotal cost of risk\b"), ("total_costs", r"\btotal costs?\b"),
    ("loan_loss_provisions", r"\bloan loss provisions?\b"), ("risk_provisions", r"\brisk provisions?\b"), ("cost_of_risk", r"\bcost of risk\b"), ("extraordinary_items", r"\bextraordinary(?: interest)? items?\b"),
    ("book_value_per_share", r"\bBV\s*(?:per share|ps)\b"), ("tangible_equity_per_share", r"\bTE\s*(?:per share|ps)\b"), ("tangible_return_on_equity", r"\b(?:tangible return on equity|tangible ROE)\b"),
    ("return_on_equity", r"\b(?:return on equity|ROE)\b"), ("loans", r"^loans?$"), ("customer_deposits", r"\bdue to customers?\b|\bcustomer deposits?\b"), ("cet1_ratio", r"\bCET1 ratio\b"),
    ("cost_income_ratio", r"\bcost income(?: ratio)?\b"), ("free_cash_flow", r"\b(?:free cash flow|FCF)\b"), ("capex", r"\b(?:capital expenditure|capex)\b"), ("dps", r"\b(?:dividend per share|DPS)\b"),
    ("combined_ratio", r"\b(?:combined ratio|COR)\b"), ("new_business_contractual_service_margin", r"\bnew business\s+(?:contractual service margin|CSM)\b"),
    ("contractual_service_margin", r"\b(?:contractual service margin|CSM)\b"), ("shareholders_equity", r"\bshareholders['’]?\s+equity\b"), ("solvency_ratio", r"\b(?:solvency\s*(?:II|2)?\s*ratio|solvency\s*(?:II|2))\b"),
]
QUALIFIERS = [
    ("adjusted", r"\b(?:adjusted|adj)\b"), ("diluted", r"\bdiluted\b"), ("reported", r"\b(?:reported|rep)\b"), ("restated", r"\brestated\b"), ("stated", r"\bstated\b"), ("ordinary", r"\b(?:ordinary|ord)\b"),
    ("basic", r"\bbasic\b"), ("organic", r"\borganic\b"), ("underlying", r"\bunderlying\b"), ("recurring", r"\brecurring\b"), ("normalized", r"\b(?:normalised|normalized)\b"), ("clean", r"\bclean\b"),
]
# Beginnings of the names above; only at these words a name can start.
METRIC_START = (
    r"\b(?:target|price|fair|TP|PO|EBITDA|EBIT|operating|gross|net|earnings|EPS|reinsurance|revenue|sales|turnover|pre|profit|PBT|tax|effective|NII|trading|insurance|other|total|investment|interest|labou?r|depreciation|"
    r"loan|risk|cost|extraordinary|BV|TE|tangible|return|ROE|due|customer|CET1|free|FCF|capital|capex|dividend|DPS|combined|COR|new|contractual|CSM|shareholders|solvency)"
)
PERIOD = (
    r"\b(?:0?[1-9]|1[0-2])/\d{2}[Ee]?\b|\b(?:[1-4]Q|Q[1-4])\s*(?:20\d{2}|\d{2})[Ee]?\b|\b(?:[12]H|H[12])\s*(?:20\d{2}|\d{2})[Ee]?\b|"
    r"(?<![\d/.,])\b(?:(?:FY|CY)\s*)?(?:20\d{2}|\d{2})[Ee]?\b(?![\d/%.,])"
)
NUMBER = r"(?<![A-Za-z0-9])\(?\s*(?:[A-Z]{3}\s*|[€$£¥]\s*)?[-+−]?\d(?:[\d.,]*\d)?\s*(?:%|bps?|bp|ppts?|pts?|pp|bn|mn|m|b|k)?(?:\s*/\s*share)?\)?(?![A-Za-z0-9])"
NULL_STATE = r"^(?:n\.?a\.?|n/?m|n\.?m\.?|ns|not meaningful|-)$"
SIGNAL = r"\b(?:old|new|previous|prev\.?|current|revis(?:e|ed|ion|ions)|change[ds]?|rais(?:e|ed|ing)|lower(?:ed|ing)?|cut(?:s|ting)?|increase[ds]?|decrease[ds]?)\b"
CONSENSUS = r"\bconsensus\b"
DISCLOSURE = (
    r"\b(?:analyst certification|important disclosures?|explanation of .{0,30} ratings|valuation methodology|other companies mentioned in this report|"
    r"risks which may impede the achievement of our price target|under no circumstances is to be construed as an offer|intended solely for accredited|past performance is not a guide)\b"
)
_CHANGE = r"(?:by|change(?:d)?(?:\s+of)?|revision(?:\s+of)?|up|down)\s*(?:c\.?\s*)?([+-]?\d+(?:[.,]\d+)?)\s*"


def ci(p: str) -> str:
    """A pattern without regard to case, words by Unicode, dots that stop at line feeds only."""
    return f"(?iUd){p}"


def metric_name(text: Column) -> Column:
    """The first metric, in the order of the list, that the text names."""
    return F.coalesce(*[F.when(text.rlike(ci(p)), name) for name, p in METRICS])


def qualifier_names(text: Column) -> Column:
    """All qualifiers in the text, in the order of the list."""
    return F.array_compact(F.array(*[F.when(text.rlike(ci(p)), name) for name, p in QUALIFIERS]))


def nearest_metric(text: Column, position: Column) -> Column:
    """struct<metric, qualifiers> of the metric whose name starts nearest to the position (the earlier on ties); qualifiers from around it."""
    anywhere = "(?iUd)^(?:" + "|".join(f"(?:{p})" for _, p in METRICS) + ")"
    named = F.transform(spans(text, ci(METRIC_START)), lambda s: F.struct(F.abs(s["s"] - position).alias("d"), s["s"].alias("s"), F.regexp_extract(F.substring(text, s["s"] + 1, F.lit(80)), anywhere, 0).alias("m")))
    near = F.array_min(F.filter(named, lambda s: s["m"] != ""))

    def read(n: Column) -> Column:
        around = F.substring(text, F.greatest(n["s"] - 50, F.lit(0)) + 1, F.least(n["s"], F.lit(50)) + F.length(n["m"]) + 30)
        return F.struct(metric_name(n["m"]).alias("metric"), qualifier_names(around).alias("qualifiers"))

    return let(near, lambda n: F.when(n.isNotNull(), read(n)))


def fiscal_period(text: Column) -> Column:
    """struct<period, basis> of the first fiscal period in the text; bare two-digit numbers count as years."""
    year = lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    part = lambda m, p, i: F.regexp_extract(m, f"(?i){p}", i)
    est = lambda m: F.when(F.upper(m).endswith("E"), "E").otherwise("")
    mon, sub, yr = r"^(\d{1,2})/(\d{2})e?$", r"^(?:([1-4])([QH])|([QH])([1-4]))\s*(\d+)e?$", r"^(FY|CY)?\s*(\d+)e?$"

    def read(m: Column) -> Column:
        month = F.concat(F.lit("FY"), F.lpad(part(m, mon, 1), 2, "0"), F.lit("/"), year(part(m, mon, 2)), est(m))
        split = F.concat(F.upper(F.concat(part(m, sub, 2), part(m, sub, 3))), part(m, sub, 1), part(m, sub, 4), F.lit(" "), year(part(m, sub, 5)), est(m))
        whole = F.concat(F.upper(part(m, yr, 1)), year(part(m, yr, 2)), est(m))
        basis = F.when(F.upper(part(m, yr, 1)) == "FY", "fiscal").when(F.upper(part(m, yr, 1)) == "CY", "calendar").otherwise("unspecified")
        return (
            F.when(m == "", F.lit(None)).when(m.rlike(f"(?i){mon}"), F.struct(month.alias("period"), F.lit("fiscal").alias("basis")))
            .when(m.rlike(f"(?i){sub}"), F.struct(split.alias("period"), F.lit("fiscal").alias("basis"))).otherwise(F.struct(whole.alias("period"), basis.alias("basis")))
        )

    return let(F.regexp_extract(text, ci(f"(?:{PERIOD})"), 0), read)


def unit_name(text: Column, per_share: Column) -> Column:
    """The unit that a text states; per_share tells that the metric is one per share."""
    p = F.coalesce(per_share, F.lit(False))

    def read(w: Column) -> Column:
        t, c, low = w["t"], w["c"], w["low"]
        eu = F.lower(F.regexp_extract(t, r"(?i)\bEu\s*(mn|m|bn|b)?\b", 1))
        eu_scale = F.when(eu.isin("bn", "b"), "bn").when(eu.isin("mn", "m"), "m").otherwise("")
        code = F.regexp_extract(c, r"\b([A-Z]{3})(?=[-+()\d])", 1)
        cur = F.when(c.rlike("(?i)€|EUR"), "EUR").when(c.rlike(r"(?i)\$|USD"), "USD").when(c.rlike("(?i)£|GBP"), "GBP").when(c.rlike("(?i)¥|JPY"), "JPY").when(code.isin(CURRENCIES), code)
        scale = F.when(low.rlike(r"(?:bn|b)(?:/share)?$"), "bn").when(low.rlike(r"(?:mn|m)(?:/share)?$"), "m").when(low.rlike(r"k(?:/share)?$"), "k")
        share = p | low.contains("/share")
        money = F.concat(F.coalesce(cur, F.lit("")), F.coalesce(scale, F.lit("")))
        return (
            F.when(t.rlike(r"(?i)\bEu\s*(?:mn|m|bn|b)?\b"), F.concat(F.lit("EUR"), eu_scale, F.when(p, "/share").otherwise("")))
            .when(low.rlike(r"(?:ppts?|pts?|pp)$"), "percentage_points").when(low.rlike(r"bps?$"), "basis_points").when(c.contains("%"), "%")
            .when(money != "", F.concat(money, F.when(share, "/share").otherwise(""))).when(share, "per_share")
        )

    compact = F.replace(text, F.lit(" "), F.lit(""))
    return let(F.struct(text.alias("t"), compact.alias("c"), F.lower(compact).alias("low")), read)


def parse_value(text: Column, per_share: Column) -> Column:
    """struct<value, unit, state> of a printed value; null states such as n.m. have a state and no value."""
    def number(tok: Column) -> Column:
        n = F.replace(F.regexp_extract(tok, r"[-+−]?\d(?:[\d.,]*\d)?", 0), F.lit("−"), F.lit("-"))
        both = n.contains(",") & n.contains(".")
        last_dot = F.instr(F.reverse(n), ".") < F.instr(F.reverse(n), ",")
        one = n.rlike(r"^[^,]*,\d{0,2}$")
        plain = F.when(both & last_dot, F.replace(n, F.lit(","), F.lit(""))).when(both, F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(one, F.replace(n, F.lit(","), F.lit("."))).otherwise(F.replace(n, F.lit(","), F.lit("")))
        v = plain.try_cast("decimal(20,6)")
        return F.when(tok.contains("(") & tok.contains(")") & (v > 0), (-v).cast("decimal(20,6)")).otherwise(v)

    none = F.lit(None).cast("string")

    def read(w: Column) -> Column:
        return F.when(w["t"].rlike(f"(?i){NULL_STATE}"), F.struct(F.lit(None).cast("decimal(20,6)").alias("value"), none.alias("unit"), F.lower(w["t"]).alias("state"))).when(w["tok"] != "", F.struct(number(w["tok"]).alias("value"), unit_name(w["tok"], per_share).alias("unit"), none.alias("state"))).otherwise(
            F.struct(F.lit(None).cast("decimal(20,6)").alias("value"), none.alias("unit"), none.alias("state")))

    return let(F.struct(F.trim(text).alias("t"), F.trim(F.regexp_extract(F.trim(text), f"(?i){NUMBER}", 0)).alias("tok")), read)


def relative_pct(old: Column, new: Column) -> Column:
    """(new - old) / |old| x 100, four places half up; null for a zero base."""
    o, n = old.cast("decimal(20,6)"), new.cast("decimal(20,6)")
    return F.when(o != 0, F.round(((n - o) * 100).cast("decimal(28,6)") / F.abs(o), 4).cast("decimal(20,4)"))


def consensus_spread(value: Column, consensus: Column) -> Column:
    return relative_pct(consensus, value)


def change_pp(old: Column, new: Column, unit: Column) -> Column:
    """The change in percentage points of values in per cent or basis points."""
    gap = new.cast("decimal(20,6)") - old.cast("decimal(20,6)")
    return F.when(unit == "%", F.round(gap, 4)).when(unit == "basis_points", F.round(gap / 100, 4)).cast("decimal(20,4)")


def stated_change(text: Column) -> Column:
    """struct<pct, pp>: a change that the text states; points win over per cent."""
    num = lambda s: F.replace(s, F.lit(","), F.lit(".")).try_cast("decimal(20,6)")
    pp, kind = F.regexp_extract(text, f"(?i){_CHANGE}(pp|ppts?|bps?)\\b", 1), F.lower(F.regexp_extract(text, f"(?i){_CHANGE}(pp|ppts?|bps?)\\b", 2))
    pct = F.regexp_extract(text, f"(?i){_CHANGE}%", 1)
    points = F.when(kind.startswith("bp"), (num(pp) / 100).cast("decimal(20,6)")).otherwise(num(pp))
    return F.struct(F.when((pp == "") & (pct != ""), num(pct)).alias("pct"), F.when(pp != "", points).alias("pp"))


def stated_consensus(text: Column, per_share: Column) -> Column:
    """The value after 'consensus of'."""
    raw = F.regexp_extract(text, f"(?iUd)\\bconsensus\\b(?:\\s+(?:of|at|is))?\\s*[:=]?\\s*({NUMBER})", 1)
    return parse_value(nonempty(raw), per_share)


def direction(old: Column, new: Column, text: Column) -> Column:
    words = F.when(text.rlike(r"(?i)\b(?:raise|raised|increase|increased|higher)\b"), "increase").when(text.rlike(r"(?i)\b(?:lower|lowered|cut|decrease|decreased|reduced)\b"), "decrease").otherwise("unknown")
    return F.when(old.isNotNull() & new.isNotNull(), F.when(new > old, "increase").when(new < old, "decrease").otherwise("unchanged")).otherwise(words)


def codes(*conditions: tuple[Column, str]) -> Column:
    """Warning codes whose condition holds, in the order given, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for c, name in conditions])))


