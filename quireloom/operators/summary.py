"""Revision tables: grouping, conflicts, answers by drivers, rows of a brief, small charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Order of metrics in a brief; others come last.
METRIC_ORDER = {
    "revenue": 10, "reinsurance_revenue_gross": 11, "reinsurance_revenue_net": 12, "ebitda": 20, "ebit": 30, "operating_profit": 31, "gross_margin": 40, "ebitda_margin": 41, "ebit_margin": 42,
    "operating_margin": 43, "net_margin": 44, "eps": 50, "tax": 60, "tax_rate": 61, "interest_expense": 62, "net_interest_income": 63, "share_count": 64, "target_price": 70,
}
LAST = 100


def metric_order(metric: Column) -> Column:
    return F.coalesce(*[F.when(metric == m, k) for m, k in METRIC_ORDER.items()], F.lit(LAST))


def periods_by_direction(revisions: DataFrame) -> DataFrame:
    """(document_id, metric, direction, periods): distinct periods in order; a null one is not_given."""
    return revisions.groupBy("document_id", "metric", "direction").agg(F.array_sort(F.collect_set(F.coalesce("fiscal_period", F.lit("not_given")))).alias("periods"))


def unanswered(revisions: DataFrame, drivers: DataFrame) -> DataFrame:
    """Revisions for which no explicit driver of their document names the metric and the period.

    Drivers are exploded to (document, metric, period) keys, so that this is an
    equi anti join; a driver without periods answers revisions without one, and
    any explicit driver of the target price answers its undated revisions.
    """
    d = drivers.where(F.col("causal_link") == "explicit").select("document_id", F.explode("impacted_metrics").alias("metric"), F.coalesce("fiscal_periods", F.array().cast("array<string>")).alias("ps"))
    dated = d.select("document_id", "metric", F.explode("ps").alias("pk"))
    undated = d.where((F.size("ps") == 0) | (F.col("metric") == "target_price")).select("document_id", "metric", F.lit("\x00").alias("pk"))
    r = revisions.withColumn("pk", F.coalesce("fiscal_period", F.lit("\x00")))
    return r.join(dated.unionByName(undated).distinct(), ["document_id", "metric", "pk"], "left_anti").drop("pk")


def merged_groups(revisions: DataFrame) -> DataFrame:
    """One row per (document, metric, qualifiers, period): the first one's values, null where the group disagrees."""
    g = revisions.groupBy("document_id", "metric", "metric_qualifiers", "fiscal_period").agg(
        F.size(F.collect_set(F.struct("old_value", "new_value", "unit"))).alias("n_obs"), F.size(F.collect_set(F.struct("consensus_value"))).alias("n_cons"), F.min_by(F.struct("old_value", "new_value", "unit", "consensus_value"), F.struct("seq", "revision_id")).alias("f"))
    one, agreed = F.col("n_obs") == 1, F.col("n_cons") == 1
    return g.select("document_id", "metric", "metric_qualifiers", "fiscal_period", F.when(one, F.col("f.old_value")).alias("old_value"), F.when(one, F.col("f.new_value")).alias("new_value"), F.col("f.unit").alias("unit"), F.when(agreed, F.col("f.consensus_value")).alias("consensus_value"), "n_obs")


def marked_conflicts(revisions: DataFrame) -> DataFrame:
    """revisions with conflict: whether their document, metric, qualifiers and period have different values."""
    w = Window.partitionBy("document_id", "metric", "metric_qualifiers", "fiscal_period")
    return revisions.withColumn("conflict", F.size(F.collect_set(F.struct("old_value", "new_value", "unit")).over(w)) > 1)


def best_rows(revisions: DataFrame, k: int = 8) -> DataFrame:
    """The k rows of each document that say most, with rank by weight and display order; revision_id decides ties."""
    full = F.col("old_value").isNotNull() & F.col("new_value").isNotNull()
    r = revisions.withColumn("m", metric_order(F.col("metric")))
    w = Window.partitionBy("document_id").orderBy(F.col("consensus_value").isNull(), ~full, "m", "metric", F.coalesce("fiscal_period", F.lit("")), "seq", "revision_id")
    top = r.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    show = Window.partitionBy("document_id").orderBy("m", "metric", F.array_join("metric_qualifiers", "|"), F.coalesce("fiscal_period", F.lit("")), "seq", "revision_id")
    return top.withColumn("display", F.row_number().over(show)).drop("m")


def number_text(v: Column) -> Column:
    """A number with as many decimals as its size needs, without zeros at the end."""
    a = F.abs(v)
    digits = lambda n: F.regexp_replace(F.format_number(v, n), r"(\.\d*?)0+$", "$1")
    t = F.when(a >= 100, F.format_number(v, 0)).when(a >= 10, digits(1)).when(a >= 1, digits(2)).when(a >= 0.01, digits(3)).otherwise(digits(4))
    return F.when(v == 0, "0").otherwise(F.regexp_replace(t, r"\.$", ""))


def bars(revisions: DataFrame, width: int = 10) -> DataFrame:
    """(revision_id, label, value, line): a bar chart line of old, new and consensus value where two of them differ."""
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("label"), F.col(c).alias("value")) for i, (n, c) in enumerate((("Old", "old_value"), ("New", "new_value"), ("Consensus", "consensus_value")))])
    r = revisions.withColumn("vs", F.filter(rows, lambda x: x["value"].isNotNull()))
    r = r.withColumn("top", F.array_max(F.transform("vs", lambda x: F.abs(x["value"])))).where((F.size(F.array_distinct(F.transform("vs", lambda x: x["value"]))) >= 2) & F.col("unit").isNotNull() & (F.col("top") > 0))
    x = r.select("revision_id", "top", F.explode("vs").alias("v"))
    v = F.col("v.value")
    n = F.greatest(F.when(v != 0, 1).otherwise(0), F.bround((F.abs(v) / F.col("top") * width).cast("double"), 0).cast("int"))
    bar = F.repeat(F.lit("█"), n)
    left, right = F.when(v < 0, F.lpad(bar, width, " ")).otherwise(" " * width), F.when(v > 0, F.rpad(bar, width, " ")).otherwise(" " * width)
    return x.select("revision_id", F.col("v.label").alias("label"), v.alias("value"), F.concat(F.rpad("v.label", 10, " "), F.lit(" "), left, F.lit("│"), right, F.lit("  "), number_text(v)).alias("line"))
