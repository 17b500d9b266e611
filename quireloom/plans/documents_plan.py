"""Queries of revisions, passages, claims, citations and metadata over the report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.functions import finance as N
from quireloom.operators import citations as C
from quireloom.operators import contacts as K
from quireloom.operators import grounding as G
from quireloom.operators import layout as L
from quireloom.operators import passages as P
from quireloom.operators import revisions as R
from quireloom.operators import summary as S
from quireloom.operators import tables as T
from quireloom.session import cut, table
from quireloom.sources.reports import live_blocks


def _revisions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "revisions").dropDuplicates(["revision_id"])


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return live_blocks(table(spark, d, "blocks"))


def revision_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """Relative change, spreads to consensus and change in points of every revision."""
    r, o, n, k = _revisions(spark, d), F.col("old_value"), F.col("new_value"), F.col("consensus_value")
    unit = F.when(F.col("unit").isin("%", "pct", "percent", "per cent"), "%").when(F.col("unit").isin("bp", "bps", "basis_points"), "basis_points")
    return r.select("revision_id", N.relative_pct(o, n).cast("double").alias("pct"), N.consensus_spread(o, k).cast("double").alias("old_spread"), N.consensus_spread(n, k).cast("double").alias("new_spread"), N.change_pp(o, n, unit).cast("double").alias("pp"), N.direction(o, n, F.lit("")).alias("direction"))


def reconcile_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """Revisions whose stated change is further than the tolerance from the recomputed one."""
    r = _revisions(spark, d).withColumn("pct", N.relative_pct(F.col("old_value"), F.col("new_value")))
    return r.where(F.abs(F.col("stated_revision_pct") - F.col("pct")) > N.TOLERANCE_PCT).select("revision_id", F.col("stated_revision_pct").cast("double").alias("stated"), F.col("pct").cast("double").alias("pct"))


def conflict_flag(spark: SparkSession, d: str) -> DataFrame:
    return S.marked_conflicts(_revisions(spark, d)).select("revision_id", "conflict")


def revision_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.periods_by_direction(_revisions(spark, d)).select("document_id", "metric", "direction", F.array_join("periods", "|").alias("periods"))


def unexplained_revisions(spark: SparkSession, d: str) -> DataFrame:
    return S.unanswered(_revisions(spark, d), table(spark, d, "drivers").dropDuplicates(["driver_id"])).select("revision_id", "document_id", "metric")


def question_groups(spark: SparkSession, d: str) -> DataFrame:
    m = S.merged_groups(_revisions(spark, d))
    return m.select("document_id", "metric", F.array_join("metric_qualifiers", "|").alias("qualifiers"), "fiscal_period", F.col("old_value").cast("double").alias("old_value"), F.col("new_value").cast("double").alias("new_value"), F.col("consensus_value").cast("double").alias("consensus_value"), F.col("n_obs"))


def brief_rows_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.best_rows(_revisions(spark, d)).select("document_id", "revision_id", "rank", "display")


def estimate_bars(spark: SparkSession, d: str) -> DataFrame:
    return S.bars(_revisions(spark, d)).select("revision_id", "label", "line")


def consensus_unique_join(spark: SparkSession, d: str) -> DataFrame:
    """Revisions with the consensus value of their key in the document, if there is only one such value."""
    r = _revisions(spark, d).where(F.col("fiscal_period").isNotNull() & F.col("unit").isNotNull())
    key = ["document_id", "metric", "metric_qualifiers", "fiscal_period", "unit"]
    obs = r.where(F.col("consensus_value").isNotNull()).groupBy(*key).agg(F.size(F.collect_set("consensus_value")).alias("n"), F.first("consensus_value").alias("k")).where("n = 1")
    j = r.join(obs, key, "left")
    return j.select("revision_id", F.col("k").cast("double").alias("consensus"), N.consensus_spread(F.col("new_value"), F.col("k")).cast("double").alias("spread"))


def candidate_blocks(spark: SparkSession, d: str) -> DataFrame:
    return R.candidate_blocks(_blocks(spark, d)).select("document_id", "page_number", "block_id")


def text_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Revisions parsed from all blocks, deduplicated and with conflicts marked."""
    r = R.deduplicate(R.text_revisions(_blocks(spark, d)))
    return r.select("document_id", "page_number", F.element_at("block_ids", 1).alias("block_id"), "metric", F.array_join("qualifiers", "|").alias("qualifiers"), "period", "old_value", "new_value", "unit", "calc_pct", "direction", "method", "confidence", F.array_join("warnings", "|").alias("warnings"))


def revision_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many recorded revisions the text parsers find again in the cited block with the same new value."""
    rec = _revisions(spark, d).where(F.col("new_value").isNotNull()).select("revision_id", "document_id", F.explode(F.flatten("evidence.block_ids")).alias("block_id"), "new_value")
    b = table(spark, d, "blocks").dropDuplicates(["document_id", "block_id"])
    got = R.text_revisions(b).select("document_id", F.explode("block_ids").alias("block_id"), "new_value").distinct().withColumn("hit", F.lit(1))
    j = rec.join(b.select("document_id", "block_id"), ["document_id", "block_id"], "left_semi").join(got, ["document_id", "block_id", "new_value"], "left")
    return j.agg(F.countDistinct("revision_id").alias("n_recorded"), F.countDistinct(F.when(F.col("hit") == 1, F.col("revision_id"))).alias("n_found"))


def _extracted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Revisions of all six parsers on the pages that have candidates, deduplicated, with the consensus values of their pages; the statuses of all documents."""
    b = _blocks(spark, d)
    c = cut(R.candidate_blocks(b))
    w = table(spark, d, "words").dropDuplicates(["word_id"]).join(c.select("document_id", "page_number").distinct(), ["document_id", "page_number"], "left_semi")
    p = cut(L.pages(w.join(b.select("document_id", "block_id"), ["document_id", "block_id"], "left_semi")))
    rows = [f(c).select(*R.ROW) for f in (R.prose_revisions, R.inline_changes, R.compact_targets)] + [f(p).select(*R.ROW) for f in (T.aligned_tables, T.grouped_tables, T.matrix_tables)]
    r = cut(R.attach_consensus(R.deduplicate(R.finalize(cut(reduce(DataFrame.unionByName, rows)))), T.consensus_rows(p)))
    return r, R.statuses(b, c.select("document_id"), r)


def document_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Status of every document with its revisions in text and tables; one row with nulls if it has none."""
    r, s = _extracted(spark, d)
    r = r.select("document_id", "page_number", "metric", F.array_join("qualifiers", "|").alias("qualifiers"), "period", "old_value", "new_value", "unit", "stated_pct", "consensus_value", "old_vs_consensus", "new_vs_consensus", "direction", "method", "confidence", F.array_join("warnings", "|").alias("warnings"))
    return s.select("document_id", "status").join(r, "document_id", "left")


def revision_statuses(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d)[1]


def context_signals(spark: SparkSession, d: str) -> DataFrame:
    return P.context_signals(_blocks(spark, d)).select("document_id", F.array_join("contexts", "|").alias("contexts"))


def _scored(spark: SparkSession, d: str):  # noqa: ANN202
    b = cut(P.with_positions(_blocks(spark, d)))  # written once: the contributions read only their columns of it
    r = _revisions(spark, d).select("document_id", "metric", F.flatten("evidence.block_ids").alias("block_ids"))
    return b, cut(P.scores(b, r, R.candidate_blocks(b)))


def passage_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)[1].select("document_id", "block_id", "score", F.array_join("reasons", "|").alias("reasons"))


def passage_budget(spark: SparkSession, d: str) -> DataFrame:
    p = P.select_passages(*_scored(spark, d))
    return p.select("document_id", "rank", "block_id", "score", F.length("text").alias("n_chars"))


def semantic_tokens(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "claims").select("claim_id", "text").distinct().where(F.col("text").isNotNull())
    return c.select("claim_id", F.array_join(F.array_sort(G.content_tokens(F.col("text"))), "|").alias("tokens"))


def claim_support(spark: SparkSession, d: str) -> DataFrame:
    """Each claim: whether its blocks support it, how well, and what was wrong."""
    c = table(spark, d, "claims").dropDuplicates(["claim_id"]).select("claim_id", "document_id", "text", "evidence_block_ids")
    v = G.validate_claims(c, ["claim_id"], table(spark, d, "blocks"), "text")
    return v.select("claim_id", "valid", "own_confidence", F.array_join("problems", "|").alias("problems"))


def driver_links(spark: SparkSession, d: str) -> DataFrame:
    """Each driver: the causal link that its evidence carries, against the stated one."""
    c = table(spark, d, "drivers").dropDuplicates(["driver_id"]).select("driver_id", "document_id", "driver", "causal_link", "evidence_block_ids")
    e = G.cited_evidence(c, ["driver_id"], table(spark, d, "blocks"))
    return e.select("driver_id", F.col("causal_link").alias("stated_link"), G.causal_link(F.col("driver"), F.col("evidence"), F.col("causal_link")).alias("link"), G.supported(F.col("driver"), F.col("evidence")).alias("supported"))


def driver_items(spark: SparkSession, d: str) -> DataFrame:
    """Each driver's metrics and periods that its document revises and its evidence names, and how many were dropped."""
    c = table(spark, d, "drivers").dropDuplicates(["driver_id"]).select("driver_id", "document_id", "impacted_metrics", "fiscal_periods", "evidence_block_ids")
    r = _revisions(spark, d).groupBy("document_id").agg(F.collect_set("metric").alias("doc_metrics"), F.collect_set("fiscal_period").alias("doc_periods"))
    e = G.cited_evidence(c, ["driver_id"], table(spark, d, "blocks")).join(r, "document_id", "left")
    kept = lambda items, allowed: F.coalesce(G.supported_items(F.col(items), F.col("evidence"), F.col(allowed)), F.array().cast("array<string>"))
    m, p = kept("impacted_metrics", "doc_metrics"), kept("fiscal_periods", "doc_periods")
    n = lambda c: F.coalesce(F.size(F.array_distinct(c)), F.lit(0))
    return e.select("driver_id", F.array_join(m, "|").alias("metrics"), F.array_join(p, "|").alias("periods"), (F.greatest(n("impacted_metrics"), F.lit(0)) - F.size(m)).alias("n_metrics_dropped"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return C.resolve_requests(table(spark, d, "citation_requests").dropDuplicates(["request_id"]), table(spark, d, "blocks"))


def citation_requests_status(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).groupBy("request_id").agg(F.first("reason").alias("reason"), F.countDistinct("page_number").alias("n_pages"))


def citation_build(spark: SparkSession, d: str) -> DataFrame:
    return C.build(_resolved(spark, d)).select("request_id", "citation_id", "document_id", "page_number", F.array_join("block_ids", "|").alias("block_ids"), F.size("boxes").alias("n_boxes"), "split")


def citation_dedup(spark: SparkSession, d: str) -> DataFrame:
    return C.distinct_citations(C.build(_resolved(spark, d))).select("citation_id", "document_id", "page_number", "label")


def claim_bindings(spark: SparkSession, d: str) -> DataFrame:
    return C.bindings(C.build(_resolved(spark, d)))


def citation_stale(spark: SparkSession, d: str) -> DataFrame:
    return C.stale(C.build(_resolved(spark, d)), _blocks(spark, d))


def highlight_boxes(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "citation_requests").dropDuplicates(["request_id"]).select("request_id", "document_id", F.explode(F.array_distinct("evidence_block_ids")).alias("block_id"), F.col("highlight_metric").alias("metric"), F.col("highlight_period").alias("period")).where(F.col("block_id").isNotNull())
    h = C.highlight_boxes(q, table(spark, d, "words"))
    return h.select("request_id", "page_number", F.size("boxes").alias("n_boxes"), "fallback")


def contact_extract(spark: SparkSession, d: str) -> DataFrame:
    return K.contacts(_blocks(spark, d))


def queries() -> dict:
    fs = [revision_arithmetic, reconcile_tolerance, conflict_flag, revision_summary, unexplained_revisions, question_groups, brief_rows_topk, estimate_bars, consensus_unique_join, candidate_blocks, text_revisions, revision_recall, document_revisions, revision_statuses, context_signals, passage_score,
          passage_budget, semantic_tokens, claim_support, driver_links, driver_items, citation_requests_status, citation_build, citation_dedup, claim_bindings, citation_stale, highlight_boxes, contact_extract]
    return {f.__name__: f for f in fs}


def _pct(old: str, new: str) -> str:
    """Half-up division in whole numbers."""
    o, n = f"CAST({old} * 1000000 AS HUGEINT)", f"CAST({new} * 1000000 AS HUGEINT)"
    x = f"(({n} - {o}) * 1000000)"
    return f"(CASE WHEN {old} <> 0 THEN CAST(sign({x}) * ((2 * abs({x}) + abs({o})) // (2 * abs({o}))) AS DOUBLE) / 10000 END)"


_R = "(SELECT DISTINCT ON (revision_id) * FROM revisions ORDER BY revision_id)"
_LIVE = "(SELECT DISTINCT ON (document_id, block_id) * FROM blocks WHERE deleted_at IS NULL ORDER BY document_id, block_id)"
_ALL = "(SELECT DISTINCT ON (document_id, block_id) * FROM blocks ORDER BY document_id, block_id)"
_ORDER = "CASE metric " + " ".join(f"WHEN '{m}' THEN {k}" for m, k in S.METRIC_ORDER.items()) + f" ELSE {S.LAST} END"
_Q = "list_distinct(evidence_block_ids)"
_STOP = "[" + ", ".join(f"'{w}'" for w in G.STOPWORDS) + "]"
_POS, _NEG = G.POSITIVE.replace("'", "''"), G.NEGATIVE.replace("'", "''")


def _tokens(x: str, stop: bool) -> str:
    pol = f"list_concat(if(regexp_matches({x}, '(?i){_POS}'), ['positive_effect'], []), if(regexp_matches({x}, '(?i){_NEG}'), ['negative_effect'], []))"
    t = f"list_distinct(list_concat(list_transform(regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9_-]{{2,}}'), lambda w: lower(w)), {pol}))"
    return f"list_filter({t}, lambda w: NOT list_contains({_STOP}, w))" if stop else t


_REQ = f"""(SELECT q.request_id, q.document_id, q.label, q.claim_key, q.i, q.block_id, b.page_number, b.bbox, CASE WHEN q.block_id IS NULL AND q.i IS NULL OR trim(coalesce(q.label, '')) = '' THEN 'invalid_request_metadata' WHEN bool_or(b.block_id IS NULL) OVER (PARTITION BY q.request_id) THEN 'unknown_evidence_block' END AS reason
FROM (SELECT request_id, document_id, label, claim_key, i, CASE WHEN i IS NOT NULL THEN ids[i] END AS block_id FROM (SELECT DISTINCT ON (request_id) *, list_filter(evidence_block_ids, lambda x, j: list_position(evidence_block_ids, x) = j) AS ids FROM citation_requests ORDER BY request_id) LEFT JOIN (SELECT unnest(range(1, 200)) AS i) n ON n.i <= len(ids)) q
LEFT JOIN {_ALL} b ON b.document_id = q.document_id AND b.block_id = q.block_id)"""


_BUILT = f"""WITH g AS (SELECT request_id, document_id, page_number, any_value(label) AS label, '"' || string_agg(block_id, '","' ORDER BY i) || '"' AS ids, list_sort(list_distinct(list(bbox))) AS boxes, count(DISTINCT bbox) AS n_boxes FROM {_REQ} WHERE reason IS NULL GROUP BY 1, 2, 3),
h AS (SELECT g.*, q.claim_key, coalesce('"' || highlight_metric || '"', 'null') AS hm, coalesce('"' || highlight_period || '"', 'null') AS hp FROM g JOIN (SELECT DISTINCT ON (request_id) * FROM citation_requests ORDER BY request_id) q USING (request_id)),
built AS (SELECT *, 'cit-' || substr(sha256('{{"document_id":"' || document_id || '","evidence_block_ids":[' || ids || '],"highlight_metric":' || hm || ',"highlight_period":' || hp || ',"page_number":' || page_number || ',"schema":1}}'), 1, 24) AS citation_id FROM h)"""


# RE2 has no look-around: what must not stand beside a match is read as a sign that may stand there.
_FREE = r"(?:^|[^A-Za-z0-9])", r"(?:$|[^A-Za-z0-9])"
_NUMBER_SQL = _FREE[0] + r"\(?\s*(?:[A-Z]{3}\s*|[€$£¥]\s*)?[-+−]?\d(?:[\d.,]*\d)?\s*(?:%|bps?|bp|ppts?|pts?|pp|bn|mn|m|b|k)?(?:\s*/\s*share)?\)?" + _FREE[1]
_PERIOD_SQL = r"\b(?:0?[1-9]|1[0-2])/\d{2}E?\b|\b(?:[1-4]Q|Q[1-4])\s*(?:20\d{2}|\d{2})E?\b|\b(?:[12]H|H[12])\s*(?:20\d{2}|\d{2})E?\b|(?:^|[^\d/.,])\b(?:(?:FY|CY)\s*)?(?:20\d{2}|\d{2})E?\b(?:$|[^\d/%.,])"
_HAS = lambda p: "regexp_matches(flat, '(?i)" + p.replace("'", "''") + "')"
_CANDIDATES = f"""(SELECT document_id, page_number, block_id FROM (SELECT *, trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g')) AS flat FROM {_LIVE} WHERE text IS NOT NULL)
WHERE NOT {_HAS(N.DISCLOSURE)} AND ({_HAS(R.HEADING)} OR {_HAS(r"\b(?:old|previous|prev\.?)\b.*\b(?:new|current|revised)\b|\b(?:new|current|revised)\b.*\b(?:old|previous|prev\.?)\b")}
 OR ({_HAS("|".join(f"(?:{p})" for _, p in N.METRICS))} AND CAST({_HAS(N.SIGNAL)} AS INT) + CAST({_HAS(N.CONSENSUS)} AS INT) + CAST({_HAS(_PERIOD_SQL)} AS INT) + CAST({_HAS(_NUMBER_SQL)} AS INT) >= 3)))"""


_TXT = lambda p: "regexp_matches(text, '(?is)(?:" + p.replace("'", "''") + ")')"
_NAMED = lambda ps: "list_filter([" + ", ".join(f"CASE WHEN {_TXT(p)} THEN '{n}' END" for n, p in ps) + "], lambda x: x IS NOT NULL)"
_K = P.SCORES
_SCORED = f"""RECURSIVE b AS (SELECT document_id, page_number, block_id, text, row_number() OVER (PARTITION BY document_id ORDER BY page_number, block_order, block_id) AS pos, row_number() OVER (PARTITION BY document_id, page_number ORDER BY block_order, block_id) AS on_page FROM {_LIVE}),
ev AS (SELECT b.* FROM b JOIN (SELECT document_id, unnest(flatten(list_transform(evidence, lambda e: e.block_ids))) AS block_id FROM {_R} UNION SELECT document_id, block_id FROM {_CANDIDATES}) USING (document_id, block_id)),
own AS (SELECT *, {_NAMED(P.SIGNALS)} AS sig, {_NAMED(P.CONTEXTS)} AS ctx, {_TXT(P.CAUSAL)} OR {_TXT(P.INFERRED)} AS causal, replace(lower(text), '_', ' ') AS low FROM b WHERE text IS NOT NULL AND NOT regexp_matches(text, '(?i){N.DISCLOSURE}')),
fi AS (SELECT DISTINCT document_id, pos FROM (SELECT document_id, c, min(pos) AS pos FROM (SELECT document_id, pos, unnest(ctx) AS c FROM own) GROUP BY 1, 2)),
me AS (SELECT document_id, list(DISTINCT replace(metric, '_', ' ')) AS ms FROM {_R} GROUP BY 1), pg AS (SELECT DISTINCT document_id, unnest([page_number - 1, page_number, page_number + 1]) AS page_number FROM ev),
base AS (SELECT document_id, block_id, {_K["opening_context"]} AS score, 0 AS ord, 'opening_context' AS reason FROM b WHERE page_number = 1 AND on_page <= 4 UNION ALL SELECT document_id, block_id, {_K["revision_evidence"]}, 1, 'revision_evidence' FROM ev
 UNION ALL SELECT b.document_id, b.block_id, {_K["adjacent_to_revision"]}, 2, 'adjacent_to_revision' FROM ev JOIN b ON b.document_id = ev.document_id AND b.page_number = ev.page_number AND abs(b.pos - ev.pos) BETWEEN 1 AND 2
 UNION ALL SELECT document_id, block_id, len(sig) * {_K["signal"]}, 3, 'signal:' || array_to_string(sig, ',') FROM own WHERE len(sig) > 0
 UNION ALL SELECT document_id, block_id, CASE WHEN (document_id, pos) IN (SELECT (document_id, pos) FROM fi) THEN {_K["first_context"]} ELSE {_K["later_context"]} END, 4, 'direct_context:' || array_to_string(ctx, ',') FROM own WHERE len(ctx) > 0
 UNION ALL SELECT document_id, block_id, {_K["direct_causal_language"]}, 5, 'direct_causal_language' FROM own WHERE causal
 UNION ALL SELECT document_id, block_id, {_K["opening_page_signal"]}, 6, 'opening_page_signal' FROM own WHERE page_number <= 2 AND len(sig) > 0
 UNION ALL SELECT own.document_id, block_id, {_K["nearby_revision_metric"]}, 7, 'nearby_revision_metric' FROM own JOIN pg USING (document_id, page_number) JOIN me ON me.document_id = own.document_id WHERE len(list_filter(ms, lambda m: contains(low, m))) > 0),
rf AS (SELECT document_id, CAST(unnest(regexp_extract_all(text, '(?i)\\b(?:see|refer to)\\s+(?:section\\s+)?(?:on\\s+)?page\\s+(\\d{{1,3}})\\b', 1)) AS INT) AS page_number FROM b WHERE (document_id, block_id) IN (SELECT (document_id, block_id) FROM base)),
al AS (SELECT * FROM base UNION ALL SELECT b.document_id, b.block_id, {_K["explicit_cross_reference"]}, 8, 'explicit_cross_reference' FROM rf JOIN b ON b.document_id = rf.document_id AND b.page_number = rf.page_number AND on_page <= 4),
sc AS (SELECT document_id, block_id, sum(score)::BIGINT AS score, array_to_string(list_transform(list_sort(list(DISTINCT {{'o': ord, 'r': reason}})), lambda x: x.r), '|') AS reasons FROM al GROUP BY 1, 2)"""


def oracle_sql() -> dict:
    unit = "(CASE WHEN unit IN ('%', 'pct', 'percent', 'per cent') THEN '%' WHEN unit IN ('bp', 'bps', 'basis_points') THEN 'bp' END)"
    quals, period = "array_to_string(metric_qualifiers, '|')", "coalesce(fiscal_period, '')"
    ctx = [p for p in P.CONTEXTS]
    flags = ", ".join(f"bool_or(regexp_matches(text, '(?is)(?:{p})')) AS {n}" for n, p in ctx)
    lists = "list_concat(" * (len(ctx) - 1) + f"if({ctx[0][0]}, ['{ctx[0][0]}'], [])" + "".join(f", if({n}, ['{n}'], []))" for n, _ in ctx[1:])
    return {
        "revision_arithmetic": f"SELECT revision_id, {_pct('old_value', 'new_value')} AS pct, {_pct('consensus_value', 'old_value')} AS old_spread, {_pct('consensus_value', 'new_value')} AS new_spread, CASE {unit} WHEN '%' THEN round(CAST(new_value - old_value AS DECIMAL(30,6)), 4)::DOUBLE WHEN 'bp' THEN CAST(sign(new_value - old_value) * ((abs(CAST((new_value - old_value) * 1000000 AS HUGEINT)) + 5000) // 10000) AS DOUBLE) / 10000 END AS pp, CASE WHEN old_value IS NULL OR new_value IS NULL THEN 'unknown' WHEN new_value > old_value THEN 'increase' WHEN new_value < old_value THEN 'decrease' ELSE 'unchanged' END AS direction FROM {_R}",
        "reconcile_tolerance": f"SELECT revision_id, stated_revision_pct::DOUBLE AS stated, p AS pct FROM (SELECT *, {_pct('old_value', 'new_value')} AS p FROM {_R}) WHERE abs(stated_revision_pct::DOUBLE - p) > 0.25000001",
        "conflict_flag": f"SELECT revision_id, n > 1 AS conflict FROM {_R} r JOIN (SELECT document_id, metric, {quals} AS q, {period} AS p, fiscal_period IS NULL AS z, count(DISTINCT (coalesce(old_value::VARCHAR, '~'), coalesce(new_value::VARCHAR, '~'), coalesce(unit, '~'))) AS n FROM {_R} GROUP BY ALL) g ON g.document_id = r.document_id AND g.metric = r.metric AND g.q = {quals} AND g.p = {period} AND g.z = (fiscal_period IS NULL)",
        "revision_summary": f"SELECT document_id, metric, direction, string_agg(DISTINCT coalesce(fiscal_period, 'not_given'), '|' ORDER BY coalesce(fiscal_period, 'not_given')) AS periods FROM {_R} GROUP BY ALL",
        "unexplained_revisions": f"SELECT revision_id, document_id, metric FROM {_R} r WHERE NOT EXISTS (SELECT 1 FROM drivers v WHERE v.document_id = r.document_id AND v.causal_link = 'explicit' AND list_contains(v.impacted_metrics, r.metric) AND (list_contains(v.fiscal_periods, r.fiscal_period) OR (r.fiscal_period IS NULL AND (r.metric = 'target_price' OR coalesce(len(v.fiscal_periods), 0) = 0))))",
        "question_groups": f"SELECT document_id, metric, {quals} AS qualifiers, fiscal_period, CASE WHEN n = 1 THEN o END AS old_value, CASE WHEN n = 1 THEN w END AS new_value, CASE WHEN c = 1 THEN k END AS consensus_value, n AS n_obs FROM (SELECT document_id, metric, metric_qualifiers, fiscal_period, count(DISTINCT (coalesce(old_value::VARCHAR, '~'), coalesce(new_value::VARCHAR, '~'), coalesce(unit, '~'))) AS n, count(DISTINCT coalesce(consensus_value::VARCHAR, '~')) AS c, (list(old_value ORDER BY seq, revision_id))[1]::DOUBLE AS o, (list(new_value ORDER BY seq, revision_id))[1]::DOUBLE AS w, (list(consensus_value ORDER BY seq, revision_id))[1]::DOUBLE AS k FROM {_R} GROUP BY ALL)",
        "brief_rows_topk": f"SELECT document_id, revision_id, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY document_id ORDER BY m, metric, {quals}, {period}, seq, revision_id) AS INTEGER) AS display FROM (SELECT *, {_ORDER} AS m, row_number() OVER (PARTITION BY document_id ORDER BY consensus_value IS NULL, old_value IS NULL OR new_value IS NULL, {_ORDER}, metric, {period}, seq, revision_id) AS rank FROM {_R}) WHERE rank <= 8",
        "consensus_unique_join": f"WITH r AS (SELECT *, {quals} AS q FROM {_R} WHERE fiscal_period IS NOT NULL AND unit IS NOT NULL), o AS (SELECT document_id, metric, q, fiscal_period, unit, any_value(consensus_value) AS k FROM r WHERE consensus_value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT consensus_value) = 1) SELECT revision_id, k::DOUBLE AS consensus, {_pct('k', 'new_value')} AS spread FROM r LEFT JOIN o USING (document_id, metric, q, fiscal_period, unit)",
        "context_signals": f"SELECT document_id, array_to_string({lists}, '|') AS contexts FROM (SELECT document_id, {flags} FROM {_LIVE} WHERE text IS NOT NULL GROUP BY 1)",
        "semantic_tokens": f"SELECT DISTINCT claim_id, array_to_string(list_sort({_tokens('text', True)}), '|') AS tokens FROM claims WHERE text IS NOT NULL",
        "citation_requests_status": f"SELECT request_id, any_value(reason) AS reason, count(DISTINCT page_number) AS n_pages FROM {_REQ} GROUP BY 1",
        "candidate_blocks": f"SELECT * FROM {_CANDIDATES}",
        "passage_score": f"WITH {_SCORED} SELECT * FROM sc",
        "passage_budget": f"""WITH {_SCORED}, rk AS (SELECT sc.document_id, sc.block_id, score, length(trim(text)) AS n, row_number() OVER (PARTITION BY sc.document_id ORDER BY score DESC, page_number, pos, sc.block_id) AS k FROM sc JOIN b USING (document_id, block_id) WHERE length(trim(text)) > 0),
fo AS (SELECT document_id, 0::BIGINT AS k, 0 AS taken, 0::BIGINT AS used, NULL::VARCHAR AS block_id, NULL::BIGINT AS score, NULL::BIGINT AS take FROM rk GROUP BY document_id UNION ALL
 SELECT rk.document_id, rk.k, taken + ok, used + ok * least(n, 12000 - used), CASE WHEN ok = 1 THEN rk.block_id END, rk.score, least(n, 12000 - used) FROM (SELECT fo.document_id, fo.k, fo.taken, fo.used FROM fo) fo JOIN rk ON rk.document_id = fo.document_id AND rk.k = fo.k + 1, LATERAL (SELECT CAST(taken < 24 AND used < 12000 AND (taken = 0 OR n <= 12000 - used) AS INT) AS ok))
SELECT document_id, taken AS rank, block_id, score, take AS n_chars FROM fo WHERE block_id IS NOT NULL""",
        "citation_dedup": f"""{_BUILT} SELECT citation_id, document_id, page_number, arg_min(label, request_id) AS label FROM built GROUP BY 1, 2, 3""",
        "citation_build": f"""{_BUILT} SELECT request_id, citation_id, document_id, page_number, replace(replace(ids, '","', '|'), '"', '') AS block_ids, CAST(n_boxes AS INTEGER) AS n_boxes, count(*) OVER (PARTITION BY request_id) > 1 AS split FROM built""",
        "claim_bindings": f"""{_BUILT} SELECT DISTINCT claim_key, citation_id FROM built WHERE claim_key IS NOT NULL""",
        "citation_stale": f"""{_BUILT}, c AS (SELECT citation_id, document_id, page_number, any_value(ids) AS ids, any_value(boxes) AS boxes FROM built GROUP BY 1, 2, 3),
k AS (SELECT citation_id, document_id, page_number, boxes, unnest(string_split(trim(ids, '"'), '","')) AS block_id FROM c), j AS (SELECT k.*, b.page_number AS p, b.bbox FROM k LEFT JOIN {_LIVE} b USING (document_id, block_id))
SELECT citation_id, CASE WHEN bool_or(p IS NULL) THEN 'missing_block' WHEN bool_or(p <> page_number) THEN 'moved' WHEN list_sort(list_distinct(list(bbox))) IS DISTINCT FROM any_value(boxes) THEN 'changed' ELSE 'valid' END AS status FROM j GROUP BY citation_id""",
        "driver_links": f"""WITH c AS (SELECT DISTINCT ON (driver_id) driver_id, document_id, driver AS said, causal_link, evidence_block_ids FROM drivers ORDER BY driver_id), x AS (SELECT driver_id, document_id, ids[i] AS block_id, i FROM (SELECT driver_id, document_id, list_filter(evidence_block_ids, lambda x, j: list_position(evidence_block_ids, x) = j)[1:100] AS ids FROM c), LATERAL (SELECT unnest(range(1, len(ids) + 1)) AS i)),
e AS (SELECT driver_id, coalesce(string_agg(b.text, chr(10) ORDER BY i), '') AS evidence FROM x LEFT JOIN {_ALL} b USING (document_id, block_id) GROUP BY 1), t AS (SELECT c.*, coalesce(evidence, '') AS evidence FROM c LEFT JOIN e USING (driver_id)),
u AS (SELECT *, {_tokens('said', True)} AS ct, {_tokens('evidence', False)} AS et, list_transform(regexp_extract_all(' ' || said, '[^A-Za-z]([-+]?[0-9]+(?:[.,][0-9]+)?%?)', 1), lambda z: replace(z, ',', '.')) AS cn, list_transform(regexp_extract_all(' ' || evidence, '[^A-Za-z]([-+]?[0-9]+(?:[.,][0-9]+)?%?)', 1), lambda z: replace(z, ',', '.')) AS en FROM t),
se AS (SELECT driver_id, ct, unnest(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(evidence, '\\s*\\n\\s*', ' ', 'g'), '(?i)\\bvs\\.', 'vs', 'g'), '(?i)\\be\\.g\\.', 'eg', 'g'), '(?i)\\bi\\.e\\.', 'ie', 'g'), '[.!?]\\s+')) AS s FROM u),
sn AS (SELECT driver_id, bool_or(fits AND regexp_matches(s, '(?is)(?:{P.CAUSAL})')) AS e, bool_or(fits AND regexp_matches(s, '(?is)(?:{P.INFERRED})')) AS i FROM (SELECT *, len(list_intersect(ct, {_tokens('s', False)})) >= greatest(1, (len(ct) + 1) // 2) AS fits FROM se) GROUP BY 1)
SELECT driver_id, causal_link AS stated_link, CASE WHEN causal_link = 'explicit' AND e THEN 'explicit' WHEN e OR i THEN 'inferred' END AS link, coalesce(length(said) > 0 AND list_has_all(en, cn) AND list_has_all(et, list_filter(ct, lambda w: w IN ('positive_effect', 'negative_effect'))) AND (len(ct) = 0 OR len(list_intersect(ct, et)) >= greatest(1, (len(ct) + 1) // 2)), false) AS supported FROM u LEFT JOIN sn USING (driver_id)""",
        "driver_items": f"""WITH c AS (SELECT DISTINCT ON (driver_id) * FROM drivers ORDER BY driver_id), x AS (SELECT driver_id, document_id, ids[i] AS block_id, i FROM (SELECT driver_id, document_id, list_filter(evidence_block_ids, lambda x, j: list_position(evidence_block_ids, x) = j)[1:100] AS ids FROM c), LATERAL (SELECT unnest(range(1, len(ids) + 1)) AS i)),
e AS (SELECT driver_id, lower(coalesce(string_agg(b.text, chr(10) ORDER BY i), '')) AS low FROM x LEFT JOIN {_ALL} b USING (document_id, block_id) GROUP BY 1), r AS (SELECT document_id, list(DISTINCT metric) AS ms, list(DISTINCT fiscal_period) AS ps FROM {_R} GROUP BY 1),
k AS (SELECT c.driver_id, list_filter(list_filter(impacted_metrics, lambda x, j: list_position(impacted_metrics, x) = j), lambda x: list_contains(ms, x) AND contains(coalesce(low, ''), lower(replace(x, '_', ' ')))) AS m, list_filter(list_filter(fiscal_periods, lambda x, j: list_position(fiscal_periods, x) = j), lambda x: list_contains(ps, x) AND contains(coalesce(low, ''), lower(replace(x, '_', ' ')))) AS p, len(list_distinct(impacted_metrics)) AS n FROM c LEFT JOIN e USING (driver_id) LEFT JOIN r USING (document_id))
SELECT driver_id, coalesce(array_to_string(m, '|'), '') AS metrics, coalesce(array_to_string(p, '|'), '') AS periods, CAST(coalesce(n, 0) - coalesce(len(m), 0) AS INTEGER) AS n_metrics_dropped FROM k""",
        "claim_support": f"""WITH c AS (SELECT DISTINCT ON (claim_id) claim_id, document_id, text, evidence_block_ids FROM claims ORDER BY claim_id),
x AS (SELECT claim_id, document_id, i, ids[i] AS block_id FROM (SELECT claim_id, document_id, list_filter(evidence_block_ids, lambda x, j: list_position(evidence_block_ids, x) = j) AS ids FROM c), LATERAL (SELECT unnest(range(1, len(ids) + 1)) AS i)),
e AS (SELECT claim_id, coalesce(string_agg(b.text, chr(10) ORDER BY i), '') AS evidence, count(b.block_id) AS n, bool_or(b.block_id IS NULL) AS dropped FROM x LEFT JOIN {_ALL} b USING (document_id, block_id) GROUP BY 1),
t AS (SELECT c.claim_id, CASE WHEN length(trim(text)) BETWEEN 1 AND 500 THEN trim(text) END AS said, coalesce(evidence, '') AS evidence, coalesce(n, 0) AS n, coalesce(dropped, false) AS dropped FROM c LEFT JOIN e USING (claim_id)),
u AS (SELECT *, {_tokens('said', True)} AS ct, {_tokens('evidence', False)} AS et, list_transform(regexp_extract_all(' ' || said, '[^A-Za-z]([-+]?[0-9]+(?:[.,][0-9]+)?%?)', 1), lambda z: replace(z, ',', '.')) AS cn, list_transform(regexp_extract_all(' ' || evidence, '[^A-Za-z]([-+]?[0-9]+(?:[.,][0-9]+)?%?)', 1), lambda z: replace(z, ',', '.')) AS en FROM t),
v AS (SELECT *, len(list_intersect(ct, et)) AS o, said IS NOT NULL AND n > 0 AND list_has_all(en, cn) AND list_has_all(et, list_filter(ct, lambda w: w IN ('positive_effect', 'negative_effect'))) AND (len(ct) = 0 OR len(list_intersect(ct, et)) >= greatest(1, (len(ct) + 1) // 2)) AS ok FROM u)
SELECT claim_id, coalesce(ok, false) AS valid, CASE WHEN ok THEN CASE WHEN n = 1 AND o >= 0.8 * greatest(len(ct), 1) THEN 'high' WHEN o >= 0.5 * greatest(len(ct), 1) THEN 'medium' ELSE 'low' END END AS own_confidence, array_to_string(list_concat(if(dropped, ['invented_or_unselected_block_id_removed'], []), if(said IS NULL, ['malformed_grounded_claim_removed'], if(coalesce(ok, false), [], ['unsupported_claim_removed']))), '|') AS problems FROM v""",
    }
