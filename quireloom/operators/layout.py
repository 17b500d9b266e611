"""Positioned words: lines of a page, columns and nearest cells, boxes.

A page is one small array; lines are found by one fold over its words, so the
only shuffle is the grouping by (document_id, page_number). Words without a
box, and repeated rows of a word, are dropped first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireloom.functions import finance as N
from quireloom.functions.columns import let, once

ROW_TOLERANCE, CELL_REACH = 2.5, 70  # fixed values: points between words of a line, and from a column's centre to a cell
_WORD = "struct<y0:double,x0:double,block_id:string,x1:double,text:string,tok:string,full:boolean,period:string,basis:string,value:decimal(20,6),unit:string>"


def word_rows(words: DataFrame) -> DataFrame:
    """(document_id, page_number, w): each word with what it reads as: period, printed value, letters only."""
    w = words.where(F.col("bbox").isNotNull() & F.col("text").isNotNull() & (F.col("bbox.x0") < F.col("bbox.x1"))).select("document_id", "page_number", "block_id", "text", "bbox").distinct()
    w = once(w, "r", F.struct(N.fiscal_period(F.col("text")).alias("p"), N.parse_value(F.col("text"), F.lit(False)).alias("v"), F.trim("text").rlike(f"(?iUd)^(?:{N.PERIOD})$").alias("full")))
    return w.select("document_id", "page_number", F.struct(F.col("bbox.y0").alias("y0"), F.col("bbox.x0").alias("x0"), "block_id", F.col("bbox.x1").alias("x1"), "text", F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("tok"), F.col("r.full").alias("full"), F.col("r.p.period").alias("period"), F.col("r.p.basis").alias("basis"), F.col("r.v.value").alias("value"), F.col("r.v.unit").alias("unit")).alias("w"))


def _cluster(ws: Column) -> Column:
    """array<array<word>>: words in order of y; a word more than ROW_TOLERANCE from the running mean of the line opens the next."""
    start = F.struct(F.array().cast(f"array<array<{_WORD}>>").alias("done"), F.array().cast(f"array<{_WORD}>").alias("line"), F.lit(0.0).alias("sum"))

    def step(acc: Column, w: Column) -> Column:
        joins = (F.size(acc["line"]) > 0) & (F.abs(acc["sum"] / F.size(acc["line"]) - w["y0"]) <= ROW_TOLERANCE)
        return F.when(joins | (F.size(acc["line"]) == 0), F.struct(acc["done"].alias("done"), F.concat(acc["line"], F.array(w)).alias("line"), (acc["sum"] + w["y0"]).alias("sum"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(acc["line"])).alias("done"), F.array(w).alias("line"), w["y0"].alias("sum")))

    return F.aggregate(ws, start, step, lambda acc: F.concat(acc["done"], F.array(acc["line"])))


def pages(words: DataFrame) -> DataFrame:
    """(document_id, page_number, lines): lines top down with y, text and words from left to right; cur is the currency word before a word."""
    p = word_rows(words).groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    p = once(p, "g", _cluster(F.col("ws"))).drop("ws")
    left_first = lambda g: F.array_sort(g, lambda a, b: F.when(a["x0"] != b["x0"], F.when(a["x0"] < b["x0"], -1).otherwise(1)).when(a["x1"] != b["x1"], F.when(a["x1"] < b["x1"], -1).otherwise(1)).when(a["block_id"] < b["block_id"], -1).when(a["block_id"] > b["block_id"], 1).otherwise(0))
    p = once(p, "s", F.transform("g", lambda g: F.struct(F.round(F.aggregate(g, F.lit(0.0), lambda a, w: a + w["y0"]) / F.size(g), 3).alias("y"), left_first(g).alias("ws")))).drop("g")
    currency = lambda t: F.when(F.upper(t).isin(N.CURRENCIES), F.upper(t)).when(t == "€", "EUR").when(t == "$", "USD").when(t == "£", "GBP").when(t == "¥", "JPY")
    def word(ws: Column, w: Column, i: Column) -> Column:
        return F.struct(w["x0"].alias("x0"), w["x1"].alias("x1"), ((w["x0"] + w["x1"]) / 2).alias("c"), w["text"].alias("text"), w["tok"].alias("tok"), w["block_id"].alias("block_id"), w["full"].alias("full"), w["period"].alias("period"), w["basis"].alias("basis"), w["value"].alias("value"), w["unit"].alias("unit"), F.when(i > 0, currency(F.get(ws, i - 1)["text"])).alias("cur"))

    line = F.transform("s", lambda s, n: F.struct(n.alias("n"), s["y"].alias("y"), F.array_join(F.transform(s["ws"], lambda w: w["text"]), " ").alias("text"), let(s["ws"], lambda ws: F.transform(ws, lambda w, i: word(ws, w, i))).alias("ws")))
    return once(p, "lines", line).drop("s")


def scoped(ws: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """The words that begin at low or right of it and before high."""
    return F.filter(ws, lambda w: (F.lit(True) if low is None else w["x0"] >= low) & (F.lit(True) if high is None else w["x0"] < high))


def text_of(ws: Column) -> Column:
    return F.array_join(F.transform(ws, lambda w: w["text"]), " ")


def blocks_of(*ws: Column) -> Column:
    return F.array_distinct(F.concat(*[F.transform(x, lambda w: w["block_id"]) for x in ws]))


def anchor(ws: Column, *labels: str) -> Column:
    """The centre of the first word that is one of the labels."""
    return F.get(F.filter(ws, lambda w: w["tok"].isin(*labels)), F.lit(0))["c"]


def cell_unit(w: Column, share: Column) -> Column:
    """The unit of a cell with the currency word before it, for a metric per share or not."""
    money = F.when(w["unit"].isin("%", "percentage_points", "basis_points"), F.lit(None)).otherwise(F.coalesce(F.concat(w["cur"], F.when(w["unit"].isin("bn", "m", "k"), w["unit"])), F.when(w["unit"].isNull(), w["cur"]), w["unit"]))
    fixed = w["unit"].isin("%", "percentage_points", "basis_points")
    return F.when(fixed, w["unit"]).when(share & money.isNull(), "per_share").when(share & ~money.endswith("/share"), F.concat(money, F.lit("/share"))).otherwise(money)


def nearest_cell(ws: Column, at: Column, share: Column) -> Column:
    """struct<value, unit, state>: the number nearest to a column's centre, within CELL_REACH; periods are none, the left one wins ties."""
    near = F.transform(ws, lambda w, i: F.when(~w["full"] & w["value"].isNotNull() & (F.abs(w["c"] - at) <= CELL_REACH), F.struct(F.abs(w["c"] - at).alias("d"), i.alias("i"), F.struct(w["value"].alias("value"), cell_unit(w, share).alias("unit"), F.lit(None).cast("string").alias("state")).alias("v"))))
    best = F.array_min(F.transform(F.array_compact(near), lambda x: F.struct(x["d"].alias("d"), x["i"].alias("i"), x["v"]["value"].alias("value"), x["v"]["unit"].alias("unit"))))
    return let(best, lambda b: F.struct(b["value"].alias("value"), b["unit"].alias("unit"), F.lit(None).cast("string").alias("state")))


def with_unit(v: Column, context: Column, share: Column) -> Column:
    """v with the unit of its table where the cell states none."""
    fill = F.when(share & ~context.endswith("/share"), F.concat(context, F.lit("/share"))).otherwise(context)
    open_ = lambda v: v["value"].isNotNull() & (v["unit"].isNull() | (v["unit"] == "per_share")) & context.isNotNull()
    return let(v, lambda v: F.struct(v["value"].alias("value"), F.when(open_(v), fill).otherwise(v["unit"]).alias("unit"), v["state"].alias("state")))


def clip_box(b: Column, width: Column, height: Column) -> Column:
    """A box cut to its page; null if nothing is left."""
    c = F.struct(*[F.round(F.least(F.greatest(b[k], F.lit(0.0)), m), 3).alias(k) for k, m in (("x0", width), ("y0", height), ("x1", width), ("y1", height))])
    return let(c, lambda c: F.when((c["x0"] < c["x1"]) & (c["y0"] < c["y1"]), c))


def merge_boxes(boxes: Column, gap: float = 4.0) -> Column:
    """Boxes from left to right joined where they overlap in height and are at most gap apart."""
    kind = "array<struct<x0:double,y0:double,x1:double,y1:double>>"

    def step(acc: Column, b: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        touch = (F.size(acc) > 0) & (b["x0"] - last["x1"] <= gap) & (b["y0"] <= last["y1"]) & (b["y1"] >= last["y0"])
        joined = F.struct(F.least(last["x0"], b["x0"]).alias("x0"), F.least(last["y0"], b["y0"]).alias("y0"), F.greatest(last["x1"], b["x1"]).alias("x1"), F.greatest(last["y1"], b["y1"]).alias("y1"))
        return F.when(touch, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(F.struct(*[b[k].alias(k) for k in ("x0", "y0", "x1", "y1")]))))

    return F.aggregate(F.array_sort(boxes), F.array().cast(kind), step)
