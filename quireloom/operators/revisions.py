"""Estimate revisions out of prose and tables, their conflicts, and their join to consensus values.

The parsers give one form of rows, ROW; finalize adds the arithmetic and the
warnings. Everything is local to a block or a page: the only shuffles are by
(document_id, page_number).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireloom.functions import finance as N
from quireloom.functions import text as X
from quireloom.functions.columns import let, once, spans
from quireloom.session import cut

ROW = ["document_id", "page_number", "seq", "metric", "qualifiers", "period", "basis", "old", "new", "stated_pct", "stated_pp", "consensus", "block_ids", "method", "source_text", "notes"]
# Methods from the last to the first choice for one and the same revision, and their ranks.
METHOD_RANK = {"table_revision_matrix": 1, "inline_stated_change": 2, "prose_old_new": 3, "table_old_new": 4, "table_grouped_old_new": 5, "compact_target_header": 5}
HEADING = r"\b(?:estimate|forecast)\s+(?:changes?|revisions?)\b"
VALUE = "struct<value:decimal(20,6),unit:string,state:string>"


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def candidate_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that may speak of a revision: a heading, a header of old and new, or a metric with three signals of four; no disclosures."""
    b = blocks.where(F.col("text").isNotNull()).withColumn("flat", X.collapse(F.col("text")))
    t = F.col("flat")
    old, new = r"\b(?:old|previous|prev\.?)\b", r"\b(?:new|current|revised)\b"
    header = t.rlike(N.ci(f"{old}.*{new}|{new}.*{old}"))
    n = sum(t.rlike(N.ci(f"(?:{p})")).cast("int") for p in (N.SIGNAL, N.CONSENSUS, N.PERIOD, N.NUMBER))
    b = once(b, "n_signals", n)
    # Cheap tests first: a metric's pattern is looked for only in texts with three signals, and only after one of the words it can start with.
    named = (F.col("n_signals") >= 3) & t.rlike(N.ci(N.METRIC_START)) & t.rlike(N.ci("|".join(f"(?:{p})" for _, p in N.METRICS)))
    return b.where(t.rlike(N.ci(HEADING)) | header | named).where(~t.rlike(N.ci(N.DISCLOSURE))).drop("n_signals")


def prose_revisions(candidates: DataFrame) -> DataFrame:
    """'from A to B', 'to B from A', 'to B (vs A)' with a word of revision near: every match of each form."""
    num = N.NUMBER
    forms = [(rf"(?iUd)\bfrom\s+({num})\s+(?:to|versus)\s+({num})", 1, 2), (rf"(?iUd)\b(?:to|at)\s+({num})\s+from\s+({num})", 2, 1), (rf"(?iUd)\b(?:to|at|of)\s+({num})\s*\(?\s*(?:vs\.?|versus)\s+({num})\s*(?:before|previously)?\s*\)?", 2, 1)]
    t = F.col("flat")

    def matches(k: int, p: str, a: int, b: int) -> Column:
        def read(s: Column) -> Column:
            begin = F.greatest(s["s"] - 160, F.lit(0))
            return F.struct(F.lit(k).alias("form"), s["s"].alias("s"), F.regexp_extract(s["m"], p, a).alias("old"), F.regexp_extract(s["m"], p, b).alias("new"), F.substring(t, begin + 1, s["e"] + 120 - begin).alias("context"))

        return F.transform(spans(t, p), read)

    found = F.concat(*[matches(k, *form) for k, form in enumerate(forms)])
    m = candidates.select("document_id", "page_number", "block_id", "block_order", "flat", F.explode(found).alias("f")).where(F.col("f.context").rlike(N.ci(N.SIGNAL)))
    m = once(m, "near", N.nearest_metric(F.col("flat"), F.col("f.s"))).where(F.col("near.metric").isNotNull())
    share = F.col("near.metric").isin(N.PER_SHARE)
    m = once(m, "read", F.struct(N.fiscal_period(F.col("f.context")).alias("p"), N.parse_value(F.col("f.old"), share).alias("old"), N.parse_value(F.col("f.new"), share).alias("new"), N.stated_change(F.col("f.context")).alias("st"), N.stated_consensus(F.col("f.context"), share).alias("cons")))
    dated = F.col("near.metric") != "target_price"
    return m.select("document_id", "page_number", F.struct(F.lit(1).alias("parser"), "block_order", "f.form", "f.s").alias("seq"), F.col("near.metric").alias("metric"), F.col("near.qualifiers").alias("qualifiers"), F.when(dated, F.col("read.p.period")).alias("period"),
                    F.when(dated, F.col("read.p.basis")).alias("basis"), F.col("read.old").alias("old"), F.col("read.new").alias("new"), F.col("read.st.pct").alias("stated_pct"), F.col("read.st.pp").alias("stated_pp"), F.col("read.cons").alias("consensus"),
                    F.array("block_id").alias("block_ids"), F.lit("prose_old_new").alias("method"), F.col("f.context").alias("source_text"), F.array().cast("array<string>").alias("notes"))


def inline_changes(candidates: DataFrame) -> DataFrame:
    """'Change in X  5% FY26 ...': stated changes without values, from the line and the next one."""
    lines = let(X.split_lines(F.col("text")), lambda a: F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("x"), F.concat_ws(" ", x, F.get(a, i + 1)).alias("two"))))
    m = candidates.select("document_id", "page_number", "block_id", "block_order", F.explode(lines).alias("l")).where(F.col("l.x").rlike(N.ci(r"\bchange\s+in\b")))
    m = once(m, "mq", F.struct(N.metric_name(F.col("l.two")).alias("metric"), N.qualifier_names(F.col("l.two")).alias("qualifiers"))).where(F.col("mq.metric").isNotNull())
    change, per = r"([+-]?\d+(?:[.,]\d+)?)\s*(%|ppts?|pp|bps|bp)", r"\s*((?:FY|CY)?\s*(?:20\d{2}|\d{2})[Ee]?)"
    pairs, alone = spans(F.col("l.two"), f"(?i){change}{per}"), F.slice(spans(F.col("l.two"), f"(?i){change}"), 1, 1)
    use = F.when(F.size(pairs) > 0, pairs).when(F.col("mq.metric") == "target_price", alone)
    m = m.withColumn("paired", F.size(pairs) > 0).withColumn("f", F.explode(use))
    raw, kind = F.replace(F.regexp_extract("f.m", f"(?i){change}", 1), F.lit(","), F.lit(".")).try_cast("decimal(20,6)"), F.lower(F.regexp_extract("f.m", f"(?i){change}", 2))
    m = once(m, "p", F.when(F.col("paired"), N.fiscal_period(F.regexp_extract("f.m", f"(?i){change}{per}", 3))))
    return m.select("document_id", "page_number", F.struct(F.lit(5).alias("parser"), "block_order", F.col("l.i").alias("form"), F.col("f.s").alias("s")).alias("seq"), "mq.metric", "mq.qualifiers", F.col("p.period").alias("period"), F.col("p.basis").alias("basis"),
                    _none(VALUE).alias("old"), _none(VALUE).alias("new"), F.when(kind == "%", raw).alias("stated_pct"), F.when(kind.startswith("bp"), (raw / 100).cast("decimal(20,6)")).when(kind.startswith("pp"), raw).alias("stated_pp"), _none(VALUE).alias("consensus"),
                    F.array("block_id").alias("block_ids"), F.lit("inline_stated_change").alias("method"), F.col("l.two").alias("source_text"), F.array(F.lit("stated_change_without_old_new_values")).alias("notes"))


def compact_targets(candidates: DataFrame) -> DataFrame:
    """'TP: NEW (OLD)', the first of a block; the old value takes the new one's unit."""
    p = r"(?iUd)\b(?:target price|price target|price obj\.?|price objective|TP|PO)\b\s*:?\s*((?:[A-Z]{3}\s*|[€$£¥]\s*)?[-+]?\d+(?:[.,]\d+)?)\s*\(\s*(\d+(?:[.,]\d+)?)\s*\)"
    no = F.lit(False)
    m = once(candidates.where(F.col("flat").rlike(p)), "r", F.struct(N.parse_value(F.regexp_extract("flat", p, 1), no).alias("new"), N.parse_value(F.regexp_extract("flat", p, 2), no).alias("old"), N.stated_change(F.col("flat")).alias("st")))
    old = F.struct(F.col("r.old.value").alias("value"), F.coalesce("r.old.unit", F.when(F.col("r.old.value").isNotNull(), F.col("r.new.unit"))).alias("unit"), F.col("r.old.state").alias("state"))
    return m.select("document_id", "page_number", F.struct(F.lit(6).alias("parser"), "block_order", F.lit(0).alias("form"), F.lit(0).alias("s")).alias("seq"), F.lit("target_price").alias("metric"), F.array().cast("array<string>").alias("qualifiers"), _none("string").alias("period"), _none("string").alias("basis"),
                    old.alias("old"), F.col("r.new").alias("new"), F.col("r.st.pct").alias("stated_pct"), F.col("r.st.pp").alias("stated_pp"), _none(VALUE).alias("consensus"), F.array("block_id").alias("block_ids"), F.lit("compact_target_header").alias("method"), F.col("flat").alias("source_text"), F.array().cast("array<string>").alias("notes"))


def finalize(rows: DataFrame) -> DataFrame:
    """ROW with unit, calculated changes, spreads, direction, confidence and warnings in their fixed order."""
    o, n, c = F.col("old.value"), F.col("new.value"), F.col("consensus.value")
    r = rows.withColumn("mismatch", F.coalesce((F.col("old.unit") != F.col("new.unit")), F.lit(False)))
    r = r.withColumn("own_unit", F.when(~F.col("mismatch"), F.coalesce("old.unit", "new.unit")))
    r = r.withColumn("cons_mismatch", F.coalesce(c.isNotNull() & (F.col("consensus.unit") != F.col("own_unit")), F.lit(False)))
    r = r.withColumns({"cons_value": F.when(~F.col("cons_mismatch"), c), "calc_pct": F.when(~F.col("mismatch"), N.relative_pct(o, n)), "calc_pp": F.when(~F.col("mismatch"), N.change_pp(o, n, F.col("own_unit")))})
    k = F.col("cons_value")
    warnings = F.array_distinct(F.concat("notes", N.codes(
        (F.col("mismatch"), "old_new_unit_mismatch"), (F.col("cons_mismatch"), "consensus_unit_mismatch"), (~F.col("mismatch") & n.isNotNull() & (o == 0), "zero_old_value_no_relative_revision"),
        (F.abs(F.col("stated_pct") - F.col("calc_pct")) > N.TOLERANCE_PCT, "stated_calculated_revision_mismatch"), (F.abs(F.col("stated_pp") - F.col("calc_pp")) > N.TOLERANCE_PCT, "stated_calculated_percentage_point_mismatch"),
        (o.isNotNull() & (k == 0), "old_zero_consensus_no_relative_spread"), (n.isNotNull() & (k == 0), "new_zero_consensus_no_relative_spread"),
        (F.col("period").isNull() & (F.col("metric") != "target_price"), "fiscal_period_unresolved"), (o.isNull(), "old_value_unresolved"), (n.isNull(), "new_value_unresolved"))))
    nothing = o.isNull() & n.isNull() & F.col("stated_pct").isNull() & F.col("stated_pp").isNull()
    conf = F.when(nothing, "low").when(o.isNotNull() & n.isNotNull() & (F.col("period").isNotNull() | (F.col("metric") == "target_price")), "high").otherwise("medium")
    return r.select("document_id", "page_number", "seq", "metric", "qualifiers", "period", "basis", o.alias("old_value"), n.alias("new_value"), F.coalesce("own_unit", "consensus.unit").alias("unit"), "stated_pct", "calc_pct", "stated_pp", "calc_pp",
                    k.alias("consensus_value"), N.consensus_spread(o, k).alias("old_vs_consensus"), N.consensus_spread(n, k).alias("new_vs_consensus"), N.direction(o, n, F.col("source_text")).alias("direction"), "block_ids", "method", conf.alias("confidence"), warnings.alias("warnings"))


def method_rank(method: Column) -> Column:
    return F.coalesce(*[F.when(method == m, k) for m, k in METHOD_RANK.items()], F.lit(0))


def deduplicate(r: DataFrame) -> DataFrame:
    """The best method's row of each revision, the first on ties; then no valueless target beside a complete one; then conflicts marked."""
    complete = (F.col("metric") == "target_price") & F.col("old_value").isNotNull() & F.col("new_value").isNotNull()
    open_ = lambda c: F.when(~complete, F.col(c))
    key = Window.partitionBy("document_id", "page_number", "metric", "qualifiers", "period", "old_value", "new_value", "unit", open_("stated_pct"), open_("stated_pp"))
    r = r.withColumns({"first_seq": F.min("seq").over(key), "k": F.row_number().over(key.orderBy(F.desc(method_rank(F.col("method"))), "seq"))}).where("k = 1").drop("k")
    page = Window.partitionBy("document_id", "page_number")
    valueless = (F.col("metric") == "target_price") & F.col("old_value").isNull() & F.col("new_value").isNull()
    r = r.withColumn("has_target", F.max(complete).over(page)).where(~(valueless & F.col("has_target"))).drop("has_target")
    group = Window.partitionBy("document_id", "page_number", "metric", "qualifiers", "period")
    differ = F.size(F.collect_set(F.struct("old_value", "new_value", "unit")).over(group)) > 1
    code = F.array(F.lit("conflicting_candidates_same_metric_period"))
    return r.withColumn("warnings", F.when(differ, F.array_distinct(F.concat("warnings", code))).otherwise(F.col("warnings")))


def attach_consensus(r: DataFrame, observations: DataFrame) -> DataFrame:
    """Revisions with the consensus value of their page, metric, qualifiers, period and unit, if there is exactly one such value.

    observations: document_id, page_number, metric, qualifiers, period, value, unit, block_ids, seq.
    """
    key = ["document_id", "page_number", "metric", "qualifiers", "period", "unit"]
    obs = observations.where(F.col("value").isNotNull()).groupBy(*key).agg(F.size(F.collect_set("value")).alias("n"), F.first("value").alias("obs_value"), F.min_by("block_ids", "seq").alias("obs_blocks")).where("n = 1").drop("n")
    j = r.join(obs, key, "left")
    hit, k = F.col("obs_value").isNotNull(), F.col("obs_value")
    old, new = F.col("old_value"), F.col("new_value")
    more = N.codes((hit & old.isNotNull() & (k == 0), "old_zero_consensus_no_relative_spread"), (hit & new.isNotNull() & (k == 0), "new_zero_consensus_no_relative_spread"))
    return j.withColumns({"consensus_value": F.coalesce(k, "consensus_value"), "old_vs_consensus": F.when(hit, N.consensus_spread(old, k)).otherwise(F.col("old_vs_consensus")), "new_vs_consensus": F.when(hit, N.consensus_spread(new, k)).otherwise(F.col("new_vs_consensus")), "warnings": F.array_distinct(F.concat("warnings", more))}).drop("obs_value")


def statuses(documents: DataFrame, candidates: DataFrame, revisions: DataFrame) -> DataFrame:
    """(document_id, status, n_candidates, n_revisions) of every document."""
    c = candidates.groupBy("document_id").agg(F.count("*").alias("n_candidates"))
    n = revisions.groupBy("document_id").agg(F.count("*").alias("n_revisions"))
    d = documents.select("document_id").distinct().join(c, "document_id", "left").join(n, "document_id", "left").na.fill(0, ["n_candidates", "n_revisions"])
    return d.withColumn("status", F.when(F.col("n_revisions") > 0, "revisions_found").when(F.col("n_candidates") > 0, "candidates_unresolved").otherwise("no_revisions"))


def text_revisions(blocks: DataFrame) -> DataFrame:
    """All revisions that stand in the text of blocks, finalised, not yet deduplicated. The candidates are written once for all parsers."""
    c = cut(candidate_blocks(blocks))
    rows = [p(c).select(*ROW) for p in (prose_revisions, inline_changes, compact_targets)]
    return finalize(reduce(DataFrame.unionByName, rows))
