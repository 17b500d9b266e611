"""Passages of a report worth reading: scores from many signals, ranked, under a budget.

Contributions are rows (document_id, block_id, score, reason) that are summed;
the hot document is split by its blocks, only the ranked list is a group.
Blocks without text are never chosen; repeated rows count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireloom.functions import finance as N

# Signals, contexts, causal phrases and the scores of contributions.
SIGNALS = [
    ("revision", r"\b(?:we\s+)?(?:raise|raised|lower|lowered|cut|increase|increased|reduce|reduced|revise|revised)\b"), ("cause", r"\b(?:driven by|due to|reflecting|on the back of|because|as a result of|owing to)\b"),
    ("timing", r"\b(?:following|after results|ahead of results|preview|review|results?|trading update|capital markets day)\b"), ("management", r"\b(?:roadshow|met with|spoke with|management|CEO|CFO|chief executive|chief financial)\b"),
    ("coverage", r"\b(?:initiating coverage|initiation|reiterate|reiterating|upgrade|downgrade|rating change)\b"), ("first_read", r"\b(?:target price|price target|guidance|valuation|catalyst|risk|rating|buy|hold|sell|overweight|underweight)\b"),
]
MANAGEMENT = (
    r"\b(?:met with|meeting with|spoke with|roadshow with)\b|\b(?:meeting|meetings|roadshow|hosted)\b.{0,120}\b(?:management|CEO|CFO|chief executive|chief financial|investor relations)\b|"
    r"\b(?:management|CEO|CFO|chief executive|chief financial|investor relations)\b.{0,120}\b(?:meeting|meetings|roadshow|hosted)\b"
)
CONTEXTS = [
    ("results_preview", r"\b(?:results?|earnings)\s+preview\b|\bahead of (?:the )?(?:results?|earnings)\b"), ("results_review", r"\b(?:results?|earnings)\s+review\b|\bafter (?:the )?(?:results?|earnings)\b|\bpost[- ]results?\b"), ("roadshow", r"\broadshow\b"),
    ("management_meeting", MANAGEMENT), ("initiation", r"\b(?:initiating coverage|initiation of coverage|initiate with)\b"), ("reiteration", r"\b(?:reiterate|reiterating|reaffirm)\b"),
    ("rating_change", r"\bwe\s+(?:upgrade|downgrade)(?:d)?\b|\b(?:upgrade|upgraded|downgrade|downgraded)\b.{0,35}\bto\s+(?:buy|hold|sell|overweight|underweight|neutral|outperform|underperform)\b|\brating\s+(?:upgrade|downgrade|change)\b"),
    ("event_reaction", r"\b(?:reaction to|following|after)\s+(?:the\s+)?(?:announcement|event|trading update|capital markets day|acquisition|disposal)\b"),
]
CAUSAL = r"\b(?:driven by|due to|reflecting|on the back of|because|as a result of|owing to|we (?:raise|raised|lower|lowered|cut|increase|increased|reduce|reduced).{0,100}(?:after|following|to reflect))\b"
INFERRED = r"\b(?:may|might|could|likely|appears?|suggests?)\b.{0,80}\b(?:affect|impact|contribut|drive|support|weigh|lead|result)\w*\b"
SCORES = {"opening_context": 12, "revision_evidence": 100, "adjacent_to_revision": 45, "signal": 18, "first_context": 1000, "later_context": 120, "direct_causal_language": 90, "opening_page_signal": 20, "nearby_revision_metric": 20, "explicit_cross_reference": 35}
MAX_BLOCKS, MAX_CHARACTERS = 24, 12_000


def _s(p: str) -> str:
    return f"(?isU){p}"


def matched(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """Names of the patterns that the text matches, in their order."""
    return F.array_compact(F.array(*[F.when(text.rlike(_s(f"(?:{p})")), n) for n, p in patterns]))


def with_positions(blocks: DataFrame) -> DataFrame:
    """Blocks with their position in the document and on the page, by page and order; blocks that have them stay as they are."""
    if "on_page" in blocks.columns:
        return blocks
    d, p = Window.partitionBy("document_id").orderBy("page_number", "block_order", "block_id"), Window.partitionBy("document_id", "page_number").orderBy("block_order", "block_id")
    return blocks.select("document_id", "page_number", "block_order", "block_id", "text").withColumns({"pos": F.row_number().over(d), "on_page": F.row_number().over(p)})


def context_signals(blocks: DataFrame) -> DataFrame:
    """(document_id, contexts): contexts that any block of the document has, in their order."""
    flags = [F.max(F.col("text").rlike(_s(f"(?:{p})"))).alias(n) for n, p in CONTEXTS]
    g = blocks.where(F.col("text").isNotNull()).groupBy("document_id").agg(*flags)
    return g.select("document_id", F.array_compact(F.array(*[F.when(F.col(n), n) for n, _ in CONTEXTS])).alias("contexts"))


def contributions(blocks: DataFrame, revisions: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(document_id, block_id, score, ord, reason); revisions: document_id, metric, block_ids; candidates: (document_id, block_id) that count as evidence as well."""
    b = with_positions(blocks)
    t = F.col("text")
    out = [b.where((F.col("page_number") == 1) & (F.col("on_page") <= 4)).select("document_id", "block_id", F.lit(SCORES["opening_context"]).alias("score"), F.lit(0).alias("ord"), F.lit("opening_context").alias("reason"))]
    cited = revisions.select("document_id", F.explode("block_ids").alias("block_id"))
    ev = (cited if candidates is None else cited.unionByName(candidates.select("document_id", "block_id"))).distinct().join(b.select("document_id", "block_id", "page_number", "pos"), ["document_id", "block_id"])
    out.append(ev.select("document_id", "block_id", F.lit(SCORES["revision_evidence"]), F.lit(1), F.lit("revision_evidence")).toDF("document_id", "block_id", "score", "ord", "reason"))
    near = ev.select("document_id", F.col("page_number").alias("p"), F.explode(F.expr("filter(sequence(pos - 2, pos + 2), x -> x <> pos)")).alias("pos"))
    adj = near.join(b, ["document_id", "pos"]).where("page_number = p")
    out.append(adj.select("document_id", "block_id", F.lit(SCORES["adjacent_to_revision"]).alias("score"), F.lit(2).alias("ord"), F.lit("adjacent_to_revision").alias("reason")))
    own = b.where(t.isNotNull()).where(~t.rlike(N.ci(N.DISCLOSURE))).withColumns({"sig": matched(t, SIGNALS), "ctx": matched(t, CONTEXTS)})
    first = own.select("document_id", "pos", F.explode("ctx").alias("c")).groupBy("document_id", "c").agg(F.min("pos").alias("pos")).select("document_id", "pos").distinct().withColumn("first", F.lit(True))
    own = own.join(first, ["document_id", "pos"], "left")
    metrics = revisions.groupBy("document_id").agg(F.collect_set(F.replace("metric", F.lit("_"), F.lit(" "))).alias("metrics"))
    pages = ev.select("document_id", F.explode(F.array(F.col("page_number") - 1, F.col("page_number"), F.col("page_number") + 1)).alias("page_number")).distinct().withColumn("near", F.lit(True))
    own = own.join(metrics, "document_id", "left").join(pages, ["document_id", "page_number"], "left")
    low = F.replace(F.lower(t), F.lit("_"), F.lit(" "))
    row = lambda cond, score, k, reason: F.when(cond, F.struct(F.lit(score).cast("int").alias("score") if isinstance(score, int) else score.cast("int").alias("score"), F.lit(k).alias("ord"), reason.alias("reason")))
    rows = F.array_compact(F.array(
        row(F.size("sig") > 0, F.size("sig") * SCORES["signal"], 3, F.concat(F.lit("signal:"), F.array_join("sig", ","))),
        row(F.size("ctx") > 0, F.when(F.col("first"), SCORES["first_context"]).otherwise(SCORES["later_context"]), 4, F.concat(F.lit("direct_context:"), F.array_join("ctx", ","))),
        row(t.rlike(_s(f"(?:{CAUSAL})")) | t.rlike(_s(f"(?:{INFERRED})")), SCORES["direct_causal_language"], 5, F.lit("direct_causal_language")),
        row((F.col("page_number") <= 2) & (F.size("sig") > 0), SCORES["opening_page_signal"], 6, F.lit("opening_page_signal")),
        row(F.col("near") & F.exists("metrics", lambda m: low.contains(m)), SCORES["nearby_revision_metric"], 7, F.lit("nearby_revision_metric"))))
    out.append(own.select("document_id", "block_id", F.inline(rows)))
    base = reduce(DataFrame.unionByName, out)
    ref = F.regexp_extract_all(t, F.lit(r"(?i)\b(?:see|refer to)\s+(?:section\s+)?(?:on\s+)?page\s+(\d{1,3})\b"), 1)
    scored = base.select("document_id", "block_id").distinct().join(b.where(t.rlike(r"(?i)\bpage\s+\d")), ["document_id", "block_id"])
    target = scored.select("document_id", F.explode(ref).alias("n")).select("document_id", F.col("n").cast("int").alias("page_number"))
    cross = target.join(b.where("on_page <= 4"), ["document_id", "page_number"])
    return base.unionByName(cross.select("document_id", "block_id", F.lit(SCORES["explicit_cross_reference"]).alias("score"), F.lit(8).alias("ord"), F.lit("explicit_cross_reference").alias("reason")))


def scores(blocks: DataFrame, revisions: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(document_id, block_id, score, reasons) of blocks with any contribution."""
    g = contributions(blocks, revisions, candidates).groupBy("document_id", "block_id").agg(F.sum("score").alias("score"), F.array_sort(F.collect_set(F.struct("ord", "reason"))).alias("r"))
    return g.select("document_id", "block_id", "score", F.transform("r", lambda x: x["reason"]).alias("reasons"))


def select_passages(blocks: DataFrame, scored: DataFrame, max_blocks: int = MAX_BLOCKS, max_characters: int = MAX_CHARACTERS) -> DataFrame:
    """(document_id, rank, block_id, page_number, score, reasons, text): the best blocks that fit.

    A block too long for what is left is passed over, but the first one is cut
    to the budget. The fold runs over ids and lengths of one document's scored
    blocks, texts are joined to the chosen ones afterwards.
    """
    b = with_positions(blocks).withColumn("text", F.trim("text")).where(F.length("text") > 0)
    j = scored.join(b, ["document_id", "block_id"])
    ranked = j.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "page_number", "pos", "block_id", F.length("text").alias("n")))).alias("xs"))
    kind = "array<struct<rank:int,block_id:string,take:int>>"

    def step(acc: Column, x: Column) -> Column:
        left = F.lit(max_characters) - acc["used"]
        take = F.least(x["n"], left)
        ok = (F.size(acc["out"]) < max_blocks) & (left > 0) & ((F.size(acc["out"]) == 0) | (x["n"] <= left))
        return F.when(ok, F.struct(F.concat(acc["out"], F.array(F.struct((F.size(acc["out"]) + 1).alias("rank"), x["block_id"].alias("block_id"), take.alias("take")))).alias("out"), (acc["used"] + take).alias("used"))).otherwise(acc)

    chosen = F.aggregate("xs", F.struct(F.array().cast(kind).alias("out"), F.lit(0).alias("used")), step, lambda acc: acc["out"])
    c = ranked.select("document_id", F.inline(chosen))
    out = c.join(j, ["document_id", "block_id"])
    cut = F.col("take") < F.length("text")
    return out.select("document_id", "rank", "block_id", "page_number", "score", F.when(cut, F.concat("reasons", F.array(F.lit("truncated_for_model_input")))).otherwise(F.col("reasons")).alias("reasons"), F.expr("substring(text, 1, take)").alias("text"))
