"""Checks of structured semantic output and of inputs: keys, codes, siblings, paths, boxes, doubles.

Each check is a Column or keeps its rows and adds a code; nothing is dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireloom.operators import grounding as G
from quireloom.operators.citations import TOLERANCE
from quireloom.operators.layout import clip_box

# Keys of a semantic result, form of a warning code, warnings on arithmetic that a brief shows.
SEMANTIC_KEYS = [
    "rationale_clarity", "drivers", "why_now", "report_context", "context_evidence_block_ids", "management_contact", "management_evidence_block_ids", "people_met", "one_line_takeaway", "jargon_definitions", "important_first_read_items", "warnings",
]
WARNING_CODE = r"^[a-z][a-z0-9_]{0,79}$"
MATERIAL = [
    "old_new_unit_mismatch", "consensus_unit_mismatch", "zero_old_value_no_relative_revision", "zero_consensus_no_relative_spread", "stated_calculated_revision_mismatch", "stated_calculated_percentage_point_mismatch", "conflicting_candidates_same_metric_period",
]


def exact_keys(json: Column, keys: list[str] = SEMANTIC_KEYS) -> Column:
    """Whether a JSON text is an object with exactly these keys; false for anything else, null included."""
    have = F.array_sort(F.json_object_keys(json))
    return F.coalesce(have == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))


def warning_codes(warnings: Column) -> Column:
    """The warnings that have the form of a code, in order, each once."""
    return F.array_distinct(F.filter(warnings, lambda w: w.rlike(WARNING_CODE)))


def material_warnings(warnings: Column) -> Column:
    """The warnings on arithmetic that matter, in their order."""
    return F.array_intersect(warnings, F.array(*[F.lit(w) for w in MATERIAL]))


def neutral_text(text: Column) -> Column:
    """Lower case, one blank between words, every word of a direction as 'effect': what two opposite claims share."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), f"(?i){G.POSITIVE}", " effect "), f"(?i){G.NEGATIVE}", " effect ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def sibling_problems(rows: DataFrame, group: list[str], order: list[str], key: list[Column], scope: list[Column], text: Column) -> DataFrame:
    """rows with sibling: duplicate (an earlier accepted row of the group has the key), contradiction or null.

    A contradiction has a direction that no earlier accepted row of its scope
    has. As there are two directions, the accepted rows before need not be
    folded: the first row with a direction sets the scope's, and once a row has
    both, nothing contradicts any more.
    """
    g = [F.col(c) for c in group]
    before = lambda by: Window.partitionBy(*g, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = rows.withColumn("_p", F.array_sort(G.polarities(text)))
    x = x.withColumns({"_first": F.first(F.when(F.size("_p") > 0, F.col("_p")), ignorenulls=True).over(before(scope)), "_both": F.coalesce(F.max(F.size("_p") == 2).over(before(scope)), F.lit(False))})
    x = x.withColumn("_against", (F.size("_p") > 0) & F.col("_first").isNotNull() & ~F.arrays_overlap("_p", F.coalesce("_first", "_p")) & ~F.col("_both"))
    x = x.withColumn("_dup", F.coalesce(F.max(~F.col("_against")).over(before(key)), F.lit(False)))
    return x.withColumn("sibling", F.when(F.col("_dup"), "duplicate").when(F.col("_against"), "contradiction")).drop("_p", "_first", "_both", "_against", "_dup")


# Categories of drivers.
CATEGORIES = [
    "revenue or volume", "pricing", "product mix", "gross margin", "operating costs", "restructuring", "foreign exchange", "commodities or input costs", "tax", "interest", "share count", "accounting treatment", "acquisitions or disposals", "regulation",
    "guidance", "valuation only", "other",
]


def driver_confidence(link: Column, n_metrics: Column, n_periods: Column) -> Column:
    """high: explicit with metrics and periods; medium: explicit, or either of them; else low."""
    e, m, p = link == "explicit", n_metrics > 0, n_periods > 0
    return F.when(e & m & p, "high").when(e | m | p, "medium").otherwise("low")


def validated_drivers(drivers: DataFrame, revisions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, driver_id, problem, link, metrics, periods, category, confidence): each driver, and the first rule that removes it.

    revisions: document_id, metric, fiscal_period. Rules in order: supported by
    its evidence, a valuation's link to the target price, a causal link that the
    evidence carries, then duplicates and contradictions among those accepted.
    Drivers with null metrics or periods have none.
    """
    r = revisions.groupBy("document_id").agg(F.collect_set("metric").alias("doc_metrics"), F.collect_set("fiscal_period").alias("doc_periods"))
    e = G.cited_evidence(drivers.select("document_id", "driver_id", "ordinal", "driver", "causal_link", "category", "impacted_metrics", "fiscal_periods", "evidence_block_ids"), ["driver_id"], blocks).join(r, "document_id", "left")
    ev, text = F.col("evidence"), F.col("driver")
    kept = lambda items, allowed: F.coalesce(G.supported_items(F.col(items), ev, F.col(allowed)), F.array().cast("array<string>"))
    e = e.withColumns({"metrics": kept("impacted_metrics", "doc_metrics"), "periods": kept("fiscal_periods", "doc_periods"), "link": G.causal_link(text, ev, F.col("causal_link")), "category": F.when(F.col("category").isin(CATEGORIES), F.col("category"))})
    valuation = (F.col("category") == "valuation only") & (~F.contains(F.lower(ev), F.lit("target price")) | F.exists("metrics", lambda m: m != "target_price"))
    first = F.when(~G.supported(text, ev) | (F.size("ids") == 0), "unsupported_driver_removed").when(F.coalesce(valuation, F.lit(False)), "valuation_only_driver_not_linked_to_target_price").when(F.col("link").isNull(), "unsupported_causal_driver_removed")
    e = e.withColumn("first", first)
    same = [F.col("metrics"), F.col("periods"), F.col("ids")]
    plain = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    ok = sibling_problems(e.where(F.col("first").isNull()), ["document_id"], ["ordinal", "driver_id"], [plain, *same], [*same, neutral_text(text)], text)
    ok = ok.withColumn("problem", F.when(F.col("sibling") == "duplicate", "duplicate_driver_removed").when(F.col("sibling") == "contradiction", "contradictory_driver_removed")).drop("sibling")
    both = ok.unionByName(e.where(F.col("first").isNotNull()).withColumn("problem", F.col("first")))
    return both.select("document_id", "driver_id", "problem", "link", "metrics", "periods", "category", driver_confidence(F.col("link"), F.size("metrics"), F.size("periods")).alias("confidence"))


def safe_source(path: Column) -> Column:
    """Whether a path is relative, stays inside its root and names a PDF file; symbolic links can only be seen where files are opened."""
    parts = F.split(path, "/")
    fine = ~F.contains(path, F.lit("\\")) & F.forall(parts, lambda p: ~p.isin("", ".", "..")) & F.lower(path).endswith(".pdf")
    return F.coalesce(fine, F.lit(False))


def box_check(box: Column, width: Column, height: Column) -> Column:
    """struct<code, box>: invalid_bounding_box for boxes that are not finite, degenerate or off the page by more than TOLERANCE; else the box cut to its page."""
    sides = [box[k] for k in ("x0", "y0", "x1", "y1")]
    finite = F.lit(True)
    for s in sides:
        finite = finite & s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))
    inside = (sides[0] >= -TOLERANCE) & (sides[1] >= -TOLERANCE) & (sides[2] <= width + TOLERANCE) & (sides[3] <= height + TOLERANCE)
    ok = F.coalesce(finite & (sides[0] < sides[2]) & (sides[1] < sides[3]) & inside, F.lit(False))
    return F.struct(F.when(~ok, "invalid_bounding_box").alias("code"), F.when(ok, clip_box(box, width, height)).alias("box"))


def doubled_keys(rows: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """(key, n_contents) of the keys that stand for more than one content; rows delivered twice are no doubles."""
    return rows.select(*key, F.xxhash64(*content).alias("h")).distinct().groupBy(*key).agg(F.count("*").alias("n_contents")).where(F.col("n_contents") > 1)
