"""Round trips: texts and page layouts are made from the columns of other tables and parsed again.

The SQL computes the answer from the columns, so it shares no pattern with the
parsers. Layouts have the forms of the table parsers, one page per customer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.operators import layout as L
from quireloom.operators import revisions as R
from quireloom.operators import tables as T
from quireloom.plans.documents_plan import _pct
from quireloom.session import table

_TEXT = lambda c: c.cast("string")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("old"), F.col("o_custkey").alias("ck"), (F.year("o_orderdate") + 30).alias("y")).distinct()
    new = (F.col("old") + (F.col("ck") % 500 - 250).cast("decimal(12,2)") + F.lit("0.25").cast("decimal(12,2)")).cast("decimal(12,2)")
    return o.withColumn("new", new)


def _as_blocks(o: DataFrame, text: Column) -> DataFrame:
    return o.select(F.concat(F.lit("o"), _TEXT(F.col("o_orderkey"))).alias("document_id"), F.lit(1).alias("page_number"), F.concat(F.lit("b"), _TEXT(F.col("o_orderkey"))).alias("block_id"), F.lit(1).alias("block_order"), text.alias("text"))


def _out(r: DataFrame) -> DataFrame:
    dbl = lambda c: F.col(c).cast("double").alias(c)
    return r.select("document_id", "metric", F.array_join("qualifiers", "|").alias("qualifiers"), "period", dbl("old_value"), dbl("new_value"), "unit", dbl("calc_pct"), dbl("stated_pct"), dbl("consensus_value"), "method")


def prose_round_trip(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    t = F.concat(F.lit("We revised adjusted revenue FY"), _TEXT(F.col("y")), F.lit("E\nfrom EUR "), _TEXT(F.col("old")), F.lit("m to EUR "), _TEXT(F.col("new")), F.lit("m by 5% on new inputs, consensus of EUR "), _TEXT(F.col("old")), F.lit("m."))
    return _out(R.deduplicate(R.text_revisions(_as_blocks(o, t))))


def inline_round_trip(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    pct = F.concat(F.lit("+"), _TEXT((F.col("ck") % 90 + 1).cast("int")), F.lit(".5% FY"), _TEXT(F.col("y")), F.lit("E"))
    return _out(R.deduplicate(R.text_revisions(_as_blocks(o, F.concat(F.lit("New change in EBITDA margin\n"), pct, F.lit("\nother text"))))))


def compact_round_trip(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d).withColumns({"a": (F.col("ck") % 900 + 1).cast("int"), "b": (F.col("o_orderkey") % 800 + 1).cast("int")})
    t = F.concat(F.lit("Rating Buy, TP: EUR "), _TEXT(F.col("a")), F.lit(".5 ("), _TEXT(F.col("b")), F.lit(".25) old, raised in 2026"))
    return _out(R.deduplicate(R.text_revisions(_as_blocks(o, t))))


def _customers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(12,2)").alias("old"), F.col("c_nationkey").alias("nk")).distinct()
    return c.withColumns({"new": (F.col("old") + F.col("nk") + F.lit("1.50").cast("decimal(12,2)")).cast("decimal(12,2)"), "y": F.lit(2024) + F.col("nk") % 4})


def _words(c: DataFrame, rows: list[tuple[int, list[tuple[int, Column | str]]]]) -> DataFrame:
    """Words of one page a customer: rows of (y, [(x, word)]); every word is 24 points wide."""
    ws = [F.struct(F.lit(f"b{i}").alias("block_id"), F.lit(i).alias("line_number"), F.lit(k).alias("word_number"), (F.lit(t) if isinstance(t, str) else t).alias("text"), F.struct(F.lit(float(x)).alias("x0"), F.lit(float(y) + 0.3 * (k % 3)).alias("y0"), F.lit(x + 24.0).alias("x1"), F.lit(y + 9.0).alias("y1")).alias("bbox")) for i, (y, cells) in enumerate(rows) for k, (x, t) in enumerate(cells)]
    return c.select(F.concat(F.lit("c"), _TEXT(F.col("c_custkey"))).alias("document_id"), F.lit(1).alias("page_number"), F.inline(F.array(*ws)))


def _year(add: int = 0) -> Column:
    return F.concat(_TEXT(F.col("y") + add), F.lit("E"))


def aligned_table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    c = _customers(spark, d)
    w = _words(c, [(20, [(40, "Estimate"), (70, "revisions")]), (50, [(40, "Metric"), (250, "Previous"), (350, "Current"), (450, "Consensus"), (550, "Change")]), (70, [(40, "Reported"), (70, "EBITDA"), (110, F.concat(F.lit("FY"), _year())), (220, "EUR"), (250, F.concat(_TEXT(F.col("old")), F.lit("m"))), (320, "EUR"), (350, F.concat(_TEXT(F.col("new")), F.lit("m"))), (420, "EUR"), (450, F.concat(_TEXT(F.col("old")), F.lit("m"))), (550, "+7%")])])
    return _out(R.deduplicate(R.finalize(T.aligned_tables(L.pages(w)).select(*R.ROW))))


def grouped_table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    c = _customers(spark, d)
    w = _words(c, [(50, [(240, "New"), (440, "Old"), (640, "Change")]), (70, [(x, _year(k)) for x, k in ((200, 0), (280, 1), (400, 0), (480, 1), (600, 0), (680, 1))]), (90, [(40, "Revenue"), (200, F.concat(_TEXT(F.col("new")), F.lit("m"))), (280, F.concat(_TEXT(F.col("old")), F.lit("m"))), (400, F.concat(_TEXT(F.col("old")), F.lit("m"))), (480, F.concat(_TEXT(F.col("new")), F.lit("m"))), (600, "3%"), (680, "-3%")])])
    return _out(R.deduplicate(R.finalize(T.grouped_tables(L.pages(w)).select(*R.ROW))))


def matrix_table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    c = _customers(spark, d)
    w = _words(c, [(100, [(40, "Forecast"), (70, "changes")]), (120, [(250, F.concat(F.lit("FY"), _year())), (350, F.concat(F.lit("FY"), _year(1)))]), (140, [(40, "Revenue"), (250, F.concat(F.lit("+"), _TEXT(F.col("nk")), F.lit(".5%"))), (350, "-2%")])])
    return _out(R.deduplicate(R.finalize(T.matrix_tables(L.pages(w)).select(*R.ROW))))


def consensus_table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """An aligned table without a consensus column, joined to the consensus rows further down its page."""
    c = _customers(spark, d)
    w = _words(c, [(20, [(40, "Key"), (70, "changes")]), (50, [(40, "Metric"), (250, "Previous"), (350, "Current")]), (70, [(40, "EBIT"), (110, F.concat(F.lit("FY"), _year())), (250, F.concat(_TEXT(F.col("old")), F.lit("m"))), (350, F.concat(_TEXT(F.col("new")), F.lit("m")))]),
                   (300, [(250, F.concat(F.lit("FY"), _year())), (350, F.concat(F.lit("FY"), _year(1)))]), (320, [(40, "Consensus"), (80, "EBIT"), (250, F.concat(_TEXT(F.col("old")), F.lit("m"))), (350, "5m")])])
    p = L.pages(w)
    r = R.attach_consensus(R.deduplicate(R.finalize(T.aligned_tables(p).select(*R.ROW))), T.consensus_rows(p))
    return _out(r)


def word_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every page of the words table: number, height and words of each."""
    p = L.pages(table(spark, d, "words").dropDuplicates(["word_id"]))
    return p.select("document_id", "page_number", F.inline(F.transform("lines", lambda x: F.struct(x["n"].alias("line"), x["y"].alias("y"), F.size(x["ws"]).alias("n_words")))))


def table_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Revisions that the table parsers find on the pages of the words table."""
    from functools import reduce

    w = table(spark, d, "words").dropDuplicates(["word_id"])
    # Only pages that have a column label or a heading can hold a table.
    hint = w.where(F.lower(F.regexp_replace("text", "[^A-Za-z]", "")).isin("old", "previous", "prev", "former", "changes", "revisions", "change", "revision")).select("document_id", "page_number").distinct()
    p = L.pages(w.join(hint, ["document_id", "page_number"], "left_semi"))
    rows = [f(p).select(*R.ROW) for f in (T.aligned_tables, T.grouped_tables, T.matrix_tables)]
    return _out(R.deduplicate(R.finalize(reduce(DataFrame.unionByName, rows))))


def queries() -> dict:
    fs = [prose_round_trip, inline_round_trip, compact_round_trip, aligned_table_round_trip, grouped_table_round_trip, matrix_table_round_trip, consensus_table_round_trip, word_lines, table_revisions]
    return {f.__name__: f for f in fs}


_O = "(SELECT DISTINCT o_orderkey, o_custkey AS ck, CAST(o_totalprice AS DECIMAL(12,2)) AS old, CAST(CAST(o_totalprice AS DECIMAL(12,2)) + (o_custkey % 500 - 250) + 0.25 AS DECIMAL(12,2)) AS new, year(o_orderdate) + 30 AS y FROM orders)"
_C = "(SELECT DISTINCT c_custkey, CAST(c_acctbal AS DECIMAL(12,2)) AS old, CAST(CAST(c_acctbal AS DECIMAL(12,2)) + c_nationkey + 1.5 AS DECIMAL(12,2)) AS new, c_nationkey AS nk, 2024 + c_nationkey % 4 AS y FROM customer)"


def _sql(src: str, key: str, metric: str, quals: str, period: str, old: str, new: str, unit: str, stated: str, cons: str, method: str) -> str:
    d = lambda x: "CAST(NULL AS DOUBLE)" if x == "NULL" else f"CAST({x} AS DOUBLE)"
    calc = "CAST(NULL AS DOUBLE)" if old == "NULL" else _pct(old, new)
    return f"SELECT {key} AS document_id, '{metric}' AS metric, '{quals}' AS qualifiers, {period} AS period, {d(old)} AS old_value, {d(new)} AS new_value, {unit} AS unit, {calc} AS calc_pct, {d(stated)} AS stated_pct, {d(cons)} AS consensus_value, '{method}' AS method FROM {src}"


def oracle_sql() -> dict:
    o, c = "'o' || o_orderkey", "'c' || c_custkey"
    yr = lambda k=0: f"(y + {k}) || 'E'"
    return {
        "prose_round_trip": _sql(_O, o, "revenue", "adjusted", "'FY' || y || 'E'", "old", "new", "'EURm'", "5", "old", "prose_old_new"),
        "inline_round_trip": _sql(_O, o, "ebitda_margin", "", "'FY' || y || 'E'", "NULL", "NULL", "CAST(NULL AS VARCHAR)", "(ck % 90 + 1) + 0.5", "NULL", "inline_stated_change"),
        "compact_round_trip": _sql(_O, o, "target_price", "", "CAST(NULL AS VARCHAR)", "CAST((o_orderkey % 800 + 1) + 0.25 AS DECIMAL(12,2))", "CAST((ck % 900 + 1) + 0.5 AS DECIMAL(12,2))", "'EUR'", "NULL", "NULL", "compact_target_header"),
        "aligned_table_round_trip": _sql(_C, c, "ebitda", "reported", "'FY' || y || 'E'", "old", "new", "'EURm'", "7", "old", "table_old_new"),
        "grouped_table_round_trip": " UNION ALL ".join([_sql(_C, c, "revenue", "", yr(), "old", "new", "'m'", "3", "NULL", "table_grouped_old_new"), _sql(_C, c, "revenue", "", yr(1), "new", "old", "'m'", "-3", "NULL", "table_grouped_old_new")]),
        "matrix_table_round_trip": " UNION ALL ".join([_sql(_C, c, "revenue", "", "'FY' || " + yr(), "NULL", "NULL", "CAST(NULL AS VARCHAR)", "nk + 0.5", "NULL", "table_revision_matrix"), _sql(_C, c, "revenue", "", "'FY' || " + yr(1), "NULL", "NULL", "CAST(NULL AS VARCHAR)", "-2", "NULL", "table_revision_matrix")]),
        "consensus_table_round_trip": _sql(_C, c, "ebit", "", "'FY' || y || 'E'", "old", "new", "'m'", "NULL", "old", "table_old_new"),
    }
