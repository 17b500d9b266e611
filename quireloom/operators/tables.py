"""Revisions and consensus values out of tables, by the places of their words.

Each parser works on the lines of one page (see layout.pages): headers are
exploded, rows below are picked by their distance, cells by the nearest column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireloom.functions import finance as N
from quireloom.functions.columns import once
from quireloom.operators import layout as L
from quireloom.operators.revisions import HEADING, VALUE

# Labels of columns and distances in points.
OLD, NEW, CHANGE = ("old", "previous", "prev", "former"), ("new", "current", "revised"), ("change", "revision")
VS_PREVIOUS = r"\bchange\s+(?:vs\.?|versus)\s+previous\b"
TABLE_HEADING = r"\b(?:key|estimate|forecast)\s+(?:changes?|revisions?)\b"
ROWS, LOOK_BACK, PERIOD_LINE, GROUP_ROWS, MATRIX_HEADER, MATRIX_ROWS, CONSENSUS_REACH, CONSENSUS_LINES = 180, 100, 45, 520, 90, 350, 140, 20
POINTS = ("percentage_points", "basis_points")


def _ws(col: str) -> Column:
    return F.col(f"{col}.ws")


def headers(pages: DataFrame) -> DataFrame:
    """Lines with columns of old and new values: h, the four anchors and the line of periods below, if the table is grouped by years."""
    h = pages.withColumn("h", F.explode(F.filter("lines", lambda x: L.anchor(x["ws"], *OLD).isNotNull() & L.anchor(x["ws"], *NEW).isNotNull() & (L.anchor(x["ws"], *OLD) != L.anchor(x["ws"], *NEW)))))
    h = h.withColumns({"a_old": L.anchor(_ws("h"), *OLD), "a_new": L.anchor(_ws("h"), *NEW), "a_chg": L.anchor(_ws("h"), *CHANGE), "a_con": L.anchor(_ws("h"), "consensus")})
    many = lambda x: F.size(F.filter(x["ws"], lambda w: w["period"].isNotNull())) >= 4
    below = F.filter("lines", lambda x: (x["n"] > F.col("h.n")) & (x["y"] - F.col("h.y") <= PERIOD_LINE) & many(x))
    return once(h, "pl", F.when(F.col("a_chg").isNotNull(), F.get(below, F.lit(0))))


def _row(method: str, parser: int, period: Column, basis: Column, old: Column, new: Column, pct: Column, pp: Column, cons: Column, blocks: Column, source: Column, notes: list[str], col: Column) -> list[Column]:
    return ["document_id", "page_number", F.struct(F.lit(parser).alias("parser"), F.col("h.n").alias("block_order"), F.col("row.n").alias("form"), col.cast("int").alias("s")).alias("seq"), F.col("mq.metric").alias("metric"), F.col("mq.qualifiers").alias("qualifiers"), period.alias("period"), basis.alias("basis"), old.cast(VALUE).alias("old"), new.cast(VALUE).alias("new"),
            pct.cast("decimal(20,6)").alias("stated_pct"), pp.cast("decimal(20,6)").alias("stated_pp"), cons.cast(VALUE).alias("consensus"), blocks.alias("block_ids"), F.lit(method).alias("method"), source.alias("source_text"), F.array(*[F.lit(n) for n in notes]).cast("array<string>").alias("notes")]


def _metric(text: Column) -> Column:
    return F.struct(N.metric_name(text).alias("metric"), N.qualifier_names(text).alias("qualifiers"))


def aligned_tables(pages: DataFrame) -> DataFrame:
    """One row a metric below a header with an old and a new column, and perhaps consensus and change."""
    h = headers(pages).where(F.col("pl").isNull() & ~F.col("h.text").rlike(N.ci(VS_PREVIOUS)))
    anchors = F.array_compact(F.array("a_old", "a_new", "a_chg", "a_con"))
    first, last = F.array_min(anchors), F.array_max(anchors)
    above = F.filter("lines", lambda x: (x["n"] < F.col("h.n")) & (F.col("h.y") - x["y"]).between(0, LOOK_BACK) & x["text"].rlike(N.ci(TABLE_HEADING)))
    h = once(h.withColumns({"first": first, "last": last}), "head", F.try_element_at(above, F.lit(-1)))
    of = F.transform(F.filter(_ws("head"), lambda w: w["text"].rlike(r"(?i)^(?:changes?|revisions?)$")), lambda w: w["block_id"])
    left = F.coalesce(F.array_min(F.transform(F.filter(_ws("head"), lambda w: F.array_contains(of, w["block_id"])), lambda w: w["x0"])), F.col("first") - 240)
    h = h.withColumn("left", left).withColumn("right", F.col("last") + 90)
    stop = F.coalesce(F.array_min(F.transform(F.filter("lines", lambda x: (x["n"] > F.col("h.n")) & x["text"].rlike(N.ci(HEADING))), lambda x: x["n"])), F.lit(1 << 30))
    h = h.withColumn("hw", L.scoped(_ws("h"), F.col("left"), F.col("right"))).withColumn("stop", stop)
    h = once(h, "hp", F.struct(N.fiscal_period(L.text_of(F.col("hw"))).alias("p"), N.unit_name(L.text_of(F.col("hw")), F.lit(False)).alias("unit")))
    unit = F.when(~(F.col("a_chg").isNotNull() & F.col("hp.unit").isin("%", *POINTS)), F.col("hp.unit"))
    r = h.withColumn("tu", unit).withColumn("row", F.explode(F.filter("lines", lambda x: (x["n"] > F.col("h.n")) & (x["n"] < F.col("stop")) & (x["y"] - F.col("h.y") <= ROWS)))).drop("lines")
    r = r.withColumn("rw", L.scoped(_ws("row"), F.col("left"), F.col("right"))).withColumn("label", L.text_of(F.filter("rw", lambda w: w["x0"] < F.col("first") - 4)))
    r = once(r, "mq", _metric(F.coalesce(F.nullif("label", F.lit("")), L.text_of(F.col("rw"))))).where(F.col("mq.metric").isNotNull())
    share = F.col("mq.metric").isin(N.PER_SHARE)
    cell = lambda a: F.when(F.col(a).isNotNull(), L.with_unit(L.nearest_cell(_ws("row"), F.col(a), share), F.col("tu"), share))
    r = once(r, "v", F.struct(cell("a_old").alias("old"), cell("a_new").alias("new"), cell("a_con").alias("con"), F.when(F.col("a_chg").isNotNull(), L.nearest_cell(_ws("row"), F.col("a_chg"), share)).alias("chg"), N.fiscal_period(F.coalesce(F.nullif("label", F.lit("")), F.col("row.text"))).alias("p")))
    pct, pp = F.when(F.col("v.chg.unit") == "%", F.col("v.chg.value")), F.when(F.col("v.chg.unit") == "percentage_points", F.col("v.chg.value"))
    r = r.where(F.col("v.old.value").isNotNull() | F.col("v.new.value").isNotNull() | pct.isNotNull() | pp.isNotNull())
    period, basis = F.coalesce("v.p.period", "hp.p.period"), F.coalesce("v.p.basis", "hp.p.basis")
    return r.select(*_row("table_old_new", 2, period, basis, F.col("v.old"), F.col("v.new"), pct, pp, F.col("v.con"), L.blocks_of(F.col("hw"), F.col("rw")), F.concat_ws(" ", L.text_of(F.col("hw")), L.text_of(F.col("rw"))), [], F.lit(0)))


def grouped_tables(pages: DataFrame) -> DataFrame:
    """Tables of three groups of years, new, old and change from left to right: one row a metric and year that all groups have."""
    h = headers(pages).where(F.col("pl").isNotNull() & F.col("a_chg").isNotNull())
    b1, b2 = (F.col("a_new") + F.col("a_old")) / 2, (F.col("a_old") + F.col("a_chg")) / 2
    group = lambda w: F.when(w["c"] < b1, "new").when(w["c"] < b2, "old").otherwise("change")
    per = F.filter(_ws("pl"), lambda w: w["period"].isNotNull())
    last = lambda g: F.aggregate(F.filter(per, lambda w: group(w) == g), F.create_map().cast("map<string,struct<c:double,basis:string>>"), lambda m, w: F.map_concat(F.map_filter(m, lambda k, v: k != w["period"]), F.create_map(w["period"], F.struct(w["c"].alias("c"), w["basis"].alias("basis")))))
    h = once(h, "g", F.struct(last("new").alias("new"), last("old").alias("old"), last("change").alias("change")))
    common = F.filter(F.map_keys("g.new"), lambda k: F.map_contains_key("g.old", k) & F.map_contains_key("g.change", k))
    near = F.array_join(F.transform(F.filter("lines", lambda x: (x["y"] - F.col("h.y")).between(-35, PERIOD_LINE)), lambda x: x["text"]), " ")
    h = h.withColumns({"common": common, "first": F.array_min(F.transform(F.map_values("g.new"), lambda v: v["c"]))}).where(F.size("common") >= 2)
    h = once(h, "ctx", F.struct(N.unit_name(near, F.lit(False)).alias("u")))
    r = h.withColumn("row", F.explode(F.filter("lines", lambda x: (x["y"] > F.col("pl.y")) & (x["y"] <= F.col("pl.y") + GROUP_ROWS)))).drop("lines")
    r = r.withColumn("label", L.text_of(F.filter(_ws("row"), lambda w: w["x0"] < F.col("first") - 4)))
    r = once(r, "mq", _metric(F.col("label"))).where(F.col("mq.metric").isNotNull())
    share = F.col("mq.metric").isin(N.PER_SHARE)
    r = once(r, "cu", F.struct(F.coalesce(N.unit_name(F.col("label"), share), F.col("ctx.u")).alias("u")))
    r = r.withColumn("unit", F.when(share & F.col("cu.u").endswith("m"), F.when(F.col("cu.u").startswith("EUR"), "EUR/share").otherwise("per_share")).otherwise(F.col("cu.u")))
    r = r.withColumn("k", F.explode("common"))
    cell = lambda g: L.nearest_cell(_ws("row"), F.col(f"g.{g}")[F.col("k")]["c"], share)
    r = once(r, "v", F.struct(L.with_unit(cell("old"), F.col("unit"), share).alias("old"), L.with_unit(cell("new"), F.col("unit"), share).alias("new"), cell("change").alias("chg"))).where(F.col("v.old.value").isNotNull() & F.col("v.new.value").isNotNull())
    pct = F.when(F.col("v.chg.unit") == "%", F.col("v.chg.value"))
    pp = F.when(F.col("v.chg.unit") == "percentage_points", F.col("v.chg.value")).when(F.col("v.chg.unit") == "basis_points", F.col("v.chg.value") / 100)
    place = F.col("g.new")[F.col("k")]
    return r.select(*_row("table_grouped_old_new", 3, F.col("k"), place["basis"], F.col("v.old"), F.col("v.new"), pct, pp, F.lit(None), L.blocks_of(_ws("h"), _ws("pl"), _ws("row")), F.concat_ws(" ", F.col("h.text"), F.col("pl.text"), F.col("row.text")), [], place["c"]))


def matrix_tables(pages: DataFrame) -> DataFrame:
    """Below a heading of estimate changes, a line of periods, and rows of changes in per cent or points; no values are made up for them."""
    is_ctx = lambda x: x["text"].rlike(N.ci(HEADING)) & ~x["text"].rlike(N.ci(VS_PREVIOUS))
    c = pages.withColumn("ctx", F.explode(F.filter("lines", is_ctx)))
    of = F.transform(F.filter(_ws("ctx"), lambda w: w["text"].rlike(r"(?i)^(?:estimates?|forecasts?)$")), lambda w: w["block_id"])
    c = c.withColumn("cx", F.array_min(F.transform(F.filter(_ws("ctx"), lambda w: F.array_contains(of, w["block_id"])), lambda w: w["x0"])))
    other = F.coalesce(F.array_min(F.transform(F.filter("lines", lambda x: is_ctx(x) & (x["y"] > F.col("ctx.y"))), lambda x: x["y"])), F.lit(float("inf")))
    c = c.withColumn("next_y", other)
    h = c.withColumn("h", F.explode(F.filter("lines", lambda x: (x["y"] - F.col("ctx.y")).between(0, MATRIX_HEADER) & (x["y"] < F.col("next_y")))))
    vs = F.try_element_at(F.filter("lines", lambda x: (x["y"] >= F.col("ctx.y")) & (x["y"] < F.col("h.y")) & x["text"].rlike(N.ci(VS_PREVIOUS))), F.lit(-1))
    h = once(h, "vs", vs)
    word = F.array_min(F.transform(F.filter(_ws("vs"), lambda w: F.lower(w["text"]) == "change"), lambda w: w["x0"]))
    h = h.withColumn("mx", F.coalesce(word - 15, "cx")).withColumn("hw", L.scoped(_ws("h"), F.col("mx") - 5)).withColumn("per", F.filter("hw", lambda w: w["period"].isNotNull())).where(F.size("per") >= 2)
    r = h.withColumn("row", F.explode(F.filter("lines", lambda x: (x["n"] > F.col("h.n")) & (x["y"] - F.col("h.y") <= MATRIX_ROWS)))).drop("lines").withColumn("rw", L.scoped(_ws("row"), F.col("cx") - 5))
    r = once(r, "mq", _metric(L.text_of(F.col("rw")))).where(F.col("mq.metric").isNotNull()).withColumn("k", F.explode("per"))
    r = once(r, "v", L.nearest_cell(_ws("row"), F.col("k.c"), F.col("mq.metric").isin(N.PER_SHARE))).where(F.col("v.unit").isin("%", *POINTS))
    pct = F.when(F.col("v.unit") == "%", F.col("v.value"))
    pp = F.when(F.col("v.unit") == "percentage_points", F.col("v.value")).when(F.col("v.unit") == "basis_points", F.col("v.value") / 100)
    return r.select(*_row("table_revision_matrix", 4, F.col("k.period"), F.col("k.basis"), F.lit(None), F.lit(None), pct, pp, F.lit(None), L.blocks_of(_ws("ctx"), F.col("hw"), F.col("rw")), F.concat_ws(" ", F.col("ctx.text"), L.text_of(F.col("hw")), L.text_of(F.col("rw"))), ["matrix_supplies_change_without_old_new_values"], F.col("k.c")))


def consensus_rows(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, metric, qualifiers, period, value, unit, block_ids, seq): consensus values under the nearest line of forecast periods above."""
    r = pages.withColumn("row", F.explode(F.filter("lines", lambda x: x["text"].rlike(N.ci(N.CONSENSUS)))))
    r = once(r, "mq", _metric(F.col("row.text"))).where(F.col("mq.metric").isNotNull())
    forecast = lambda w: w["period"].isNotNull() & (w["period"].endswith("E") | w["period"].rlike("^(?:FY|CY|Q|H)"))
    cand = F.filter("lines", lambda x: (x["n"] < F.col("row.n")) & (x["n"] >= F.col("row.n") - CONSENSUS_LINES) & (F.col("row.y") - x["y"] <= CONSENSUS_REACH) & (F.size(F.filter(x["ws"], forecast)) >= 2))
    r = once(r, "h", F.try_element_at(cand, F.lit(-1))).where(F.col("h").isNotNull())
    share = F.col("mq.metric").isin(N.PER_SHARE)
    up = F.reverse(F.filter("lines", lambda x: (x["n"] < F.col("h.n")) & (x["n"] >= F.col("h.n") - 3)))
    units = F.concat(F.array(N.unit_name(F.col("h.text"), share)), F.transform(up, lambda x: N.unit_name(x["text"], share)))
    r = once(r, "unit", F.get(F.array_compact(units), F.lit(0))).drop("lines").withColumn("k", F.explode(F.filter(_ws("h"), forecast)))
    r = once(r, "v", L.with_unit(L.nearest_cell(_ws("row"), F.col("k.c"), share), F.col("unit"), share)).where(F.col("v.value").isNotNull())
    return r.select("document_id", "page_number", "mq.metric", "mq.qualifiers", F.col("k.period").alias("period"), F.col("v.value").alias("value"), F.col("v.unit").alias("unit"), L.blocks_of(_ws("h"), _ws("row")).alias("block_ids"), F.struct(F.col("row.n").alias("n"), F.col("k.c").alias("c")).alias("seq"))
