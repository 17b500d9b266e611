"""Quantities recorded in different units: reading of unit texts and choice of units by identities.

Null, blank or unreadable unit texts give a null unit. Nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireloom.functions.columns import let, once  # noqa: F401

# Currency codes, symbols, scale words and parts of a currency unit.
CODES = ["AUD", "CAD", "CHF", "CNY", "DKK", "EUR", "GBP", "HKD", "JPY", "NOK", "SEK", "USD"]
SYMBOLS = {"€": "EUR", "$": "USD", "£": "GBP", "¥": "JPY"}
SCALES = {
    "1000": ["k", "K", "T", "thousand", "thousands", "Tsd", "tsd", "'000", "000"],
    "1000000": ["m", "M", "mn", "Mn", "mln", "Mln", "mio", "Mio", "million", "millions"],
    "1000000000": ["b", "B", "bn", "Bn", "BN", "Mrd", "mrd", "billion", "billions"],
    "1000000000000": ["trn", "tn", "trillion"],
}
RATIOS = {
    "1": ["%", "pct", "percent", "per cent", "pp", "percentage_points", "percentage points"],
    "0.01": ["bp", "bps", "basis_points", "basis points", "basis point"],
    "0.1": ["‰", "permille", "per mille"],
    "100": ["ratio", "fraction", "as a fraction", "as a ratio", "as fraction"],
}
PENCE = ["p", "pence", "penny", "GBp", "GBX", "GBx"]
NUMBER = r"\(?[-−+]?\d[\d,]*(?:\.\d+)?\)?"
_CUR = "(" + "|".join(CODES + ["€", r"\$", "£", "¥"]) + ")"


def _lookup(groups: dict[str, list[str]], key: Column) -> Column:
    return reduce(lambda a, kv: F.when(key.isin(kv[1]), F.lit(kv[0])).otherwise(a), groups.items(), F.lit(None).cast("string"))


def unit_of(text: Column) -> Column:
    """struct<cur, part, scale, ratio>: what a unit text states; each null where it states nothing.

    part is the share of the currency unit (1 or 0.01), scale the multiple
    ('1' is never stated by itself), ratio the factor to per cent.
    """
    t = F.trim(F.regexp_replace(text, r"[()\s ]+", " "))
    t = F.trim(F.regexp_replace(t, r"(?i)\s*(?:/\s*share|per[ _]share)\s*$", ""))
    cents_of = rf"^(?:{_CUR}c|(US|EUR|USD|CHF|SEK|euro|Euro|{'|'.join(CODES)}) ?c(?:ents?)?|(USc))$"
    none = F.lit(None).cast("string")

    def read(w: Column) -> Column:
        t, cents, raw_cur, scale = w["t"], w["cents"], w["raw_cur"], w["scale"]
        ratio = _lookup(RATIOS, F.lower(t))
        cent_of = F.when(cents.rlike("^(?:US|USD|USc)"), "USD").when(cents.rlike("(?i)^eur"), "EUR").otherwise(F.substring(cents, 1, 3))
        is_pence, is_cent = t.isin(PENCE), cents != ""
        cur = reduce(lambda a, kv: F.when(raw_cur == kv[0], kv[1]).otherwise(a), SYMBOLS.items(), F.when(raw_cur != "", raw_cur))
        readable = (w["rest"] == "") | scale.isNotNull()
        return F.struct(
            F.when(is_pence, "GBP").when(is_cent, cent_of).when(readable, cur).otherwise(none).alias("cur"),
            F.when(is_pence | is_cent, "0.01").when(readable & (raw_cur != ""), "1").otherwise(none).alias("part"),
            F.when(~is_pence & ~is_cent, scale).otherwise(none).alias("scale"),
            ratio.alias("ratio"),
        )

    def split(t: Column) -> Column:
        rest = F.trim(F.regexp_replace(t, _CUR, " "))
        return let(rest, lambda r: F.struct(t.alias("t"), r.alias("rest"), F.regexp_extract(t, cents_of, 0).alias("cents"), F.regexp_extract(t, _CUR, 1).alias("raw_cur"), _lookup(SCALES, F.trim(F.regexp_replace(r, r"\.$", ""))).alias("scale")))

    return let(t, lambda t: let(split(t), read))


def around_number(text: Column) -> Column:
    """What a table cell prints around its number."""
    return F.regexp_replace(F.regexp_replace(text, "'000", " thousand "), NUMBER, " ")


def after_title(text: Column) -> Column:
    """What a header says of units: 'All figures in EURm', 'Currency: EUR', 'Name, bps', '(GBP m)'."""
    t = F.regexp_replace(text, r"^.*,\s*", "")
    t = F.regexp_replace(F.trim(t), r"(?i)^\(?\s*(?:all )?(?:figures|values|amounts|numbers|units?|currency)?\s*(?:are\s+)?(?:in\b|:)?\s*", "")
    return t


def number_in(text: Column) -> Column:
    """The first number of a text as decimal(30,6); parentheses or a minus sign make it negative."""
    raw = F.regexp_extract(F.regexp_replace(text, "'000", " "), NUMBER, 0)
    n = lambda raw: F.regexp_replace(raw, r"[(),+\-−]", "").try_cast("decimal(30,6)")
    return let(raw, lambda raw: F.when(raw.rlike(r"[-−(]"), -n(raw)).otherwise(n(raw)))


def milli_factor(unit: Column, quantity: Column) -> Column:
    """decimal(24,5): amount in the common unit x 1000 of one recorded unit; null if the unit doesn't fit the quantity.

    quantity: money (common unit is a million), per_share or price (one), ratio (per cent).
    """
    dec = lambda c: c.cast("decimal(18,3)")
    scale, part = dec(F.coalesce(unit["scale"], F.lit("1"))), dec(unit["part"])
    money = (scale * part / F.lit(1000)).cast("decimal(24,5)")
    single = (scale * part * F.lit(1000)).cast("decimal(24,5)")
    ratio = (dec(unit["ratio"]) * F.lit(1000)).cast("decimal(24,5)")
    return F.when(quantity == "money", money).when(quantity.isin("per_share", "price"), single).when(quantity == "ratio", ratio)


def candidate_factors(quantity: Column, scale: Column, scale_told: Column) -> Column:
    """array<decimal(24,5)>: the milli factors that a value of this quantity may have.

    Every scale and part of a currency unit (or every kind of ratio) where
    scale_told is false; else only those of the scale told.
    """
    d = F.lit(None).cast("string")
    one = lambda s, p, r: milli_factor(F.struct(s.alias("scale"), p.alias("part"), r.alias("ratio")), quantity)
    parts = [F.lit("1"), F.lit("0.01")]
    every = F.array(*[one(F.lit(s), p, d) for s in ["1", *SCALES] for p in parts])
    ratios = F.array(*[one(d, d, F.lit(r)) for r in RATIOS])
    return F.when(quantity == "ratio", ratios).when(scale_told, F.array(*[one(scale, p, d) for p in parts])).otherwise(every)


def choose_by_identities(
    candidates: dict[str, Column], residual: Callable[[dict[str, Column]], Column], match: float = float("inf"), prefer: Callable[[dict[str, Column]], Column] | None = None, solution: Callable[[dict[str, Column]], Column] | None = None, tolerance: float = 1e-6
) -> Column:
    """struct<residual, n_best, pick_<name>...>: the combination of one candidate per quantity with the least residual.

    candidates: an array column per quantity (bounded: the readings of one row);
    residual: from one candidate of each, the sum of |log| deviations of the
    physical identities, null where none can be evaluated. A residual above match
    contradicts a combination. Of equals, and where all are contradicted, the
    least value of prefer wins, then the earlier candidates. n_best counts the
    different solutions (by default, combinations) within the tolerance of the
    best: more than one flags a solution that isn't unique. Empty or null
    candidate arrays give null.
    """
    names, inf = list(candidates), F.lit(float("inf"))
    of = solution or (lambda p: F.struct(*[p[n].alias(n) for n in names]))

    def combos(left: list[str], picked: dict[str, Column], at: list[Column]) -> Column:
        if left:
            return F.flatten(F.transform(candidates[left[0]], lambda x, i: combos(left[1:], picked | {left[0]: x}, [*at, i])))
        r = F.coalesce(residual(picked).cast("double"), inf)
        second = F.round(F.coalesce(prefer(picked).cast("double"), inf), 9) if prefer else F.lit(0.0)
        return F.array(F.struct(F.when(r <= match, F.round(r, 9)).otherwise(inf).alias("rank"), second.alias("second"), F.array(*at).alias("at"), r.alias("residual"), of(picked).alias("solution"), *[picked[n].alias(f"pick_{n}") for n in names]))

    def pick(every: Column) -> Column:
        def best_of(best: Column) -> Column:
            equal = F.filter(every, lambda c: (c["rank"] <= best["rank"] + F.lit(tolerance)) & ((best["rank"] < inf) | (c["second"] <= best["second"] + F.lit(tolerance))))
            n = F.size(F.array_distinct(F.transform(equal, lambda c: c["solution"])))
            return F.struct(best["residual"].alias("residual"), n.alias("n_best"), *[best[f"pick_{n}"].alias(f"pick_{n}") for n in names])

        return F.when(F.size(every) > 0, let(F.array_min(every), best_of))

    return let(combos(names, {}, []), pick)


def log_gap(a: Column, b: Column) -> Column:
    """|ln a - ln b| of two amounts; two zeros agree, null and opposite signs can't be compared."""
    x, y = a.cast("double"), b.cast("double")
    return F.when((x == 0) & (y == 0), F.lit(0.0)).when(x * y > 0, F.abs(F.log(F.abs(x)) - F.log(F.abs(y))))
