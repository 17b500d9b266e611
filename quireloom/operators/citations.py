"""Citations: requests resolved to blocks, split by page, identified by content, with boxes.

A request with an unknown block fails as a whole and stays as a row with a
reason. Repeated requests give one citation; all claims stay bound to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireloom.operators import layout as L

TOLERANCE = 0.5  # fixed value: points that a box may stand beyond its page


def resolve_requests(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """request_id, document_id, label, claim_key, highlight_metric, highlight_period, block_id, page_number, i, bbox, and reason (null: resolved) per id; requests without ids have one row with a reason."""
    for c in {"highlight_metric", "highlight_period"} - set(requests.columns):
        requests = requests.withColumn(c, F.lit(None).cast("string"))
    x = requests.select("request_id", "document_id", "label", "claim_key", "highlight_metric", "highlight_period", F.posexplode_outer(F.array_distinct("evidence_block_ids")).alias("i", "block_id")).distinct()
    b = blocks.select("document_id", "block_id", "page_number", "bbox").dropDuplicates(["document_id", "block_id"]).withColumn("known", F.lit(True))
    j = x.join(b, ["document_id", "block_id"], "left")
    w = Window.partitionBy("request_id")
    bad = F.max(F.col("known").isNull()).over(w)
    # Reasons.
    reason = F.when(F.col("block_id").isNull() & F.col("i").isNull(), "invalid_request_metadata").when(F.trim(F.coalesce("label", F.lit(""))) == "", "invalid_request_metadata").when(bad, "unknown_evidence_block")
    return j.withColumn("reason", reason).drop("known")


def citation_id(document: Column, page: Column, ids: Column, metric: Column, period: Column) -> Column:
    """cit- and 24 hex over document, page, blocks and what is highlighted, as the reference hashes them (ASCII values)."""
    # Fixed value: 1, the reference's schema version.
    body = F.to_json(F.struct(document.alias("document_id"), ids.alias("evidence_block_ids"), metric.alias("highlight_metric"), period.alias("highlight_period"), page.alias("page_number"), F.lit(1).alias("schema")), {"ignoreNullFields": "false"})
    return F.concat(F.lit("cit-"), F.substring(F.sha2(body, 256), 1, 24))


def requests_from_revisions(revisions: DataFrame) -> DataFrame:
    """(document_id, evidence_block_ids, label, claim_key, highlight_metric, highlight_period): a request per evidence of each revision.

    Revisions are numbered per document by seq and revision_id, from 1.
    """
    r = revisions.withColumn("no", F.row_number().over(Window.partitionBy("document_id").orderBy("seq", "revision_id")))
    x = r.select("document_id", "revision_id", "no", "metric", "fiscal_period", F.posexplode("evidence").alias("e", "v"))
    label = F.concat(F.replace("metric", F.lit("_"), F.lit(" ")), F.lit(" "), F.coalesce("fiscal_period", F.lit("current")), F.lit(" revision evidence"))
    key = F.concat(F.lit("revision:"), F.col("no").cast("string"), F.lit(":evidence:"), (F.col("e") + 1).cast("string"))
    return x.select("document_id", "revision_id", F.col("v.block_ids").alias("evidence_block_ids"), label.alias("label"), key.alias("claim_key"), F.col("metric").alias("highlight_metric"), F.col("fiscal_period").alias("highlight_period"))


def requests_from_rationale(drivers: DataFrame, claims: DataFrame) -> DataFrame:
    """(document_id, evidence_block_ids, label, claim_key): drivers and first-read items numbered per document, why_now and takeaway; none without ids."""
    number = lambda df, *order: df.withColumn("no", F.row_number().over(Window.partitionBy("document_id").orderBy(*order)).cast("string"))
    row = lambda df, label, key: df.select("document_id", "evidence_block_ids", label.alias("label"), key.alias("claim_key"))
    d = number(drivers, "ordinal", "driver_id")
    out = row(d, F.concat(F.lit("Rationale driver "), "no"), F.concat(F.lit("rationale:driver:"), "no"))
    f = number(claims.where(F.col("kind") == "first_read"), "ordinal", "claim_id")
    out = out.unionByName(row(f, F.concat(F.lit("First-read item "), "no"), F.concat(F.lit("rationale:first_read:"), "no")))
    for kind, label, key in (("why_now", "Why now", "rationale:why_now"), ("one_line_takeaway", "One-line takeaway", "rationale:takeaway")):
        one = number(claims.where(F.col("kind") == kind), "ordinal", "claim_id").where("no = '1'")
        out = out.unionByName(row(one, F.lit(label), F.lit(key)))
    return out.where(F.size("evidence_block_ids") > 0)


def row_citations(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, revision_id, citation_ids): the citations of each revision's evidence, in order, each once; none without a resolved evidence."""
    x = requests.withColumns({"request_id": F.struct("revision_id", "claim_key")})
    b = build(resolve_requests(x, blocks))
    g = b.groupBy("document_id", F.col("request_id.revision_id").alias("revision_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("claim_key"), "page_number", "citation_id"))).alias("c"))
    return g.select("document_id", "revision_id", F.array_distinct(F.transform("c", lambda v: v["citation_id"])).alias("citation_ids"))


def lookup(citations: DataFrame, wanted: str) -> DataFrame:
    """The citation of an id; a text that is no id of a citation is an error."""
    import re

    if not re.fullmatch(r"cit-[0-9a-f]{24}", wanted):
        raise ValueError("no id of a citation")
    return citations.where(F.col("citation_id") == wanted)


def build(resolved: DataFrame) -> DataFrame:
    """One row per request and page: citation_id, document_id, page_number, block_ids, boxes, label, claim_key, highlight_metric, highlight_period, split."""
    ok = resolved.where(F.col("reason").isNull())
    first = [F.first(c).alias(c) for c in ("label", "claim_key", "highlight_metric", "highlight_period")]
    g = ok.groupBy("request_id", "document_id", "page_number").agg(*first, F.array_sort(F.collect_list(F.struct("i", "block_id", "bbox"))).alias("xs"))
    g = g.withColumn("split", F.count("*").over(Window.partitionBy("request_id")) > 1)
    g = g.withColumns({"block_ids": F.transform("xs", lambda x: x["block_id"]), "boxes": F.array_distinct(F.array_compact(F.transform("xs", lambda x: x["bbox"])))})
    identity = citation_id(*map(F.col, ("document_id", "page_number", "block_ids", "highlight_metric", "highlight_period")))
    return g.select("request_id", identity.alias("citation_id"), "document_id", "page_number", "block_ids", "boxes", "label", "claim_key", "highlight_metric", "highlight_period", "split")


def distinct_citations(built: DataFrame) -> DataFrame:
    """Each citation once, with the label of its first request."""
    w = Window.partitionBy("citation_id").orderBy("request_id")
    return built.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "claim_key")


def bindings(built: DataFrame) -> DataFrame:
    """(claim_key, citation_id), each once."""
    return built.where(F.col("claim_key").isNotNull()).select("claim_key", "citation_id").distinct()


def stale(built: DataFrame, blocks: DataFrame) -> DataFrame:
    """(citation_id, status): whether the blocks that are alive still give a citation's page and boxes."""
    c = distinct_citations(built).select("citation_id", "document_id", "page_number", "block_ids", "boxes", F.posexplode("block_ids").alias("i", "block_id"))
    b = blocks.select("document_id", "block_id", F.col("page_number").alias("p"), "bbox").dropDuplicates(["document_id", "block_id"])
    j = c.join(b, ["document_id", "block_id"], "left")
    g = j.groupBy("citation_id", "page_number", "block_ids", "boxes").agg(F.min(F.col("p") == F.col("page_number")).alias("same"), F.count("p").alias("n"), F.array_sort(F.collect_list(F.struct("i", "bbox"))).alias("xs"))
    again = F.array_distinct(F.array_compact(F.transform("xs", lambda x: x["bbox"])))
    return g.select("citation_id", F.when(F.col("n") < F.size("block_ids"), "missing_block").when(~F.col("same"), "moved").when(again != F.col("boxes"), "changed").otherwise("valid").alias("status"))


def highlight_boxes(requests: DataFrame, words: DataFrame) -> DataFrame:
    """(request_id, document_id, page_number, boxes, fallback): boxes over the words of the cited lines.

    requests: request_id, document_id, block_id, metric, period (null: no
    selector). Lines that name the metric or the period are taken, all lines
    if none does (then fallback). Words of a line are joined where their gap
    is small. Only words of cited blocks are read.
    """
    from quireloom.functions import finance as N

    w = words.where(F.col("bbox").isNotNull() & F.col("text").isNotNull()).select("document_id", "page_number", "block_id", "line_number", "word_number", "text", "bbox").distinct()
    cited = requests.select("document_id", "block_id").distinct()
    line = w.join(cited, ["document_id", "block_id"], "left_semi").groupBy("document_id", "page_number", "block_id", "line_number").agg(F.array_sort(F.collect_list(F.struct("word_number", "text", "bbox"))).alias("ws"))
    line = line.select("document_id", "page_number", "block_id", "line_number", F.array_join(F.transform("ws", lambda x: x["text"]), " ").alias("t"), F.transform("ws", lambda x: x["bbox"]).alias("bs"), F.transform("ws", lambda x: N.fiscal_period(x["text"])["period"]).alias("ps"))
    line = line.withColumn("m", N.metric_name(F.col("t")))
    j = requests.join(line, ["document_id", "block_id"]).withColumn("none", F.col("metric").isNull() & F.col("period").isNull())
    hit = F.coalesce(F.col("m") == F.col("metric"), F.lit(False)) | F.coalesce(F.array_contains(F.array_compact("ps"), F.col("period")), F.lit(False)) | F.coalesce(F.contains(F.col("t"), F.col("period")), F.lit(False))
    j = j.withColumn("hit", hit).withColumn("any", F.max("hit").over(Window.partitionBy("request_id")))
    j = j.where(F.col("none") | F.col("hit") | ~F.col("any"))
    g = j.groupBy("request_id", "document_id", "page_number").agg(F.array_sort(F.collect_set(F.struct("block_id", "line_number", "bs"))).alias("ls"), F.max(~F.col("none") & ~F.col("any")).alias("fallback"))
    return g.select("request_id", "document_id", "page_number", F.array_distinct(F.flatten(F.transform("ls", lambda x: L.merge_boxes(x["bs"])))).alias("boxes"), "fallback")
