"""Queries of front matter, citation requests, and checks of inputs and semantic output, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.functions import text as X
from quireloom.operators import checks as H
from quireloom.operators import citations as C
from quireloom.operators import contacts as K
from quireloom.operators import grounding as G
from quireloom.operators import summary as S
from quireloom.session import table
from quireloom.sources.reports import live_blocks


def _live(spark: SparkSession, d: str) -> DataFrame:
    return live_blocks(table(spark, d, "blocks"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "words").groupBy("document_id", "page_number").agg(F.max("page_width").alias("width"), F.max("page_height").alias("height"))


def _once(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    return table(spark, d, name).dropDuplicates([key])


def report_title(spark: SparkSession, d: str) -> DataFrame:
    """Title of every report that has one, with its score and block."""
    return K.titles(_live(spark, d), _pages(spark, d))


def publication_date(spark: SparkSession, d: str) -> DataFrame:
    """The date that stands alone on top of a report's first page; null where there are several."""
    return _dates(K.publication_dates(_live(spark, d), _pages(spark, d)))


def made_dates(spark: SparkSession, d: str) -> DataFrame:
    """publication_date over first blocks to which lines of dates in all forms are added, as the reports write none on a line of its own."""
    b = _live(spark, d)
    n = F.regexp_extract("block_id", r"([0-9a-f])$", 1)
    day = F.make_date(F.lit(2025), F.col("page_number") + F.length("text") % 12, F.lit(1) + F.length("text") % 28)
    forms = [("0", "'Date:' d MMMM yyyy"), ("1", "'Published: 'd MMM yyyy"), ("2", "yyyy-MM-dd"), ("3", "d/M/yyyy"), ("4", "'publication date 'dd.MM.yyyy"), ("5", "d-M-yyyy"), ("6", "'On 'd MMMM yyyy"), ("7", "d MMMM yyyy', rated Buy'")]
    line = F.coalesce(*[F.when(n == k, F.date_format(day, f)) for k, f in forms], F.when(n == "8", F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("\n2024-01-01"))), F.lit(""))
    first = (F.col("page_number") == 1) & (F.col("block_order") <= 1) & F.col("text").isNotNull()
    return _dates(K.publication_dates(b.withColumn("text", F.when(first, F.concat("text", F.lit("\n"), line)).otherwise(F.col("text"))), _pages(spark, d)))


def _dates(df: DataFrame) -> DataFrame:
    return df.select("document_id", "published", F.array_join("block_ids", "|").alias("block_ids"))


def analyst_order(spark: SparkSession, d: str) -> DataFrame:
    return K.analyst_order(_once(spark, d, "analysts", "analyst_row_id"), "analyst_row_id").select("document_id", "analyst_row_id", "place")


def _revision_requests(spark: SparkSession, d: str) -> DataFrame:
    return C.requests_from_revisions(_once(spark, d, "revisions", "revision_id"))


def revision_requests(spark: SparkSession, d: str) -> DataFrame:
    r = _revision_requests(spark, d)
    return r.select("document_id", "claim_key", "label", F.array_join("evidence_block_ids", "|").alias("block_ids"), "highlight_metric", "highlight_period")


def rationale_requests(spark: SparkSession, d: str) -> DataFrame:
    r = C.requests_from_rationale(_once(spark, d, "drivers", "driver_id"), _once(spark, d, "claims", "claim_id"))
    return r.select("document_id", "claim_key", "label", F.array_join("evidence_block_ids", "|").alias("block_ids"))


def revision_citations(spark: SparkSession, d: str) -> DataFrame:
    """Number of citations of each revision that has one."""
    c = C.row_citations(_revision_requests(spark, d), table(spark, d, "blocks"))
    return c.select("document_id", "revision_id", F.size("citation_ids").alias("n_citations"))


def brief_rows_cited(spark: SparkSession, d: str) -> DataFrame:
    """Per document the rows of a brief that have a citation, and how many cited rows are left out."""
    r = _once(spark, d, "revisions", "revision_id").join(C.row_citations(_revision_requests(spark, d), table(spark, d, "blocks")).select("revision_id"), "revision_id", "left_semi")
    top = S.best_rows(r).groupBy("document_id").agg(F.count("*").alias("n_rows"))
    every = r.groupBy("document_id").agg(F.count("*").alias("n_cited"))
    return every.join(top, "document_id").select("document_id", "n_rows", F.greatest(F.lit(0), F.col("n_cited") - F.col("n_rows")).alias("n_omitted"))


def semantic_keys(spark: SparkSession, d: str) -> DataFrame:
    """The check of exact keys on objects with all keys, one too few and one too many, by claim."""
    every = ",".join(f'"{k}":1' for k in H.SEMANTIC_KEYS)
    n = F.col("claim_id") % 4
    json = F.when(n == 0, F.lit("{" + every + "}")).when(n == 1, F.lit("{" + every.rsplit(",", 1)[0] + "}")).when(n == 2, F.lit("{" + every + ',"more":1}')).otherwise(F.col("text"))
    return _once(spark, d, "claims", "claim_id").select("claim_id", H.exact_keys(json).alias("exact"))


def sibling_items(spark: SparkSession, d: str) -> DataFrame:
    """Supported first-read items, each said again as it is and with a word of each direction, as a report's semantic result would hold them: duplicates and contradictions."""
    c = _once(spark, d, "claims", "claim_id").where(F.col("kind") == "first_read").select("claim_id", "document_id", "ordinal", "text", "evidence_block_ids")
    v = G.validate_claims(c, ["claim_id"], table(spark, d, "blocks"), "text").where("valid").select("claim_id", "document_id", "ordinal", "said", "ids")
    forms = F.array(*[F.struct(F.lit(i).alias("no"), F.concat(F.lit(p), F.col("said")).alias("text")) for i, p in enumerate(["", "", "We raised it: ", "We cut it: ", "We raised and cut it: ", "We lowered it: "])])
    x = v.select("claim_id", "document_id", "ordinal", "ids", F.inline(forms))
    same = F.lower(X.collapse(F.col("text")))
    out = H.sibling_problems(x, ["document_id"], ["ordinal", "claim_id", "no"], [same, F.col("ids")], [F.col("ids"), H.neutral_text(F.col("text"))], F.col("text"))
    return out.select("claim_id", "no", "sibling")


def driver_validation(spark: SparkSession, d: str) -> DataFrame:
    """Every driver with the first rule that removes it, else its link and confidence."""
    v = H.validated_drivers(_once(spark, d, "drivers", "driver_id"), _once(spark, d, "revisions", "revision_id").select("document_id", "metric", "fiscal_period"), table(spark, d, "blocks"))
    kept = F.col("problem").isNull()
    return v.select("driver_id", "problem", F.when(kept, F.col("link")).alias("link"), F.when(kept, F.col("confidence")).alias("confidence"), F.array_join("metrics", "|").alias("metrics"), F.array_join("periods", "|").alias("periods"))


def warning_filter(spark: SparkSession, d: str) -> DataFrame:
    """Codes and warnings that matter out of what stands beside a revision."""
    w = F.array_compact(F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.array("direction", F.col("unit"), F.upper("direction"), F.lit("zero_old_value_no_relative_revision"), "extraction_method", F.when(F.col("revision_id") % 2 == 0, "consensus_unit_mismatch"), "direction")))
    return _once(spark, d, "revisions", "revision_id").select("revision_id", F.array_join(H.warning_codes(w), "|").alias("codes"), F.array_join(H.material_warnings(w), "|").alias("material"))


def safe_sources(spark: SparkSession, d: str) -> DataFrame:
    """File names and paths, some of them made unsafe, and whether they are safe."""
    name = F.col("source_filename")
    made = [name, F.concat(F.lit("a/b/"), name), F.concat(F.lit("../"), name), F.concat(F.lit("/a/"), name), F.concat(F.lit("a//"), name), F.concat(F.lit("a/./"), name), F.concat(F.lit("a\\"), name), F.upper(name)]
    b = table(spark, d, "blocks").select(F.explode(F.array(*made)).alias("path"))
    return b.unionByName(table(spark, d, "documents").select("path")).distinct().select("path", H.safe_source(F.col("path")).alias("safe"))


def box_checks(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of blocks, some of them moved or emptied, checked against their page and cut to it."""
    k, n = F.col("block_order") % 6, F.lit(float("nan"))
    side = lambda c, *cases: F.coalesce(*[F.when(k == i, v) for i, v in cases], F.col(f"bbox.{c}"))
    box = F.struct(side("x0", (1, F.lit(-0.4)), (2, F.lit(-0.6)), (3, F.col("bbox.x1")), (4, n)).alias("x0"), F.col("bbox.y0").alias("y0"), side("x1", (5, F.col("width") + 0.5)).alias("x1"), F.col("bbox.y1").alias("y1"))
    b = _live(spark, d).join(_pages(spark, d), ["document_id", "page_number"]).select("document_id", "block_id", H.box_check(box, F.col("width"), F.col("height")).alias("c"))
    return b.select("document_id", "block_id", "c.code", "c.box.x0", "c.box.y0", "c.box.x1", "c.box.y1")


def doubled_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Block ids of a document that stand for several contents: a citation of one would be ambiguous."""
    b = table(spark, d, "blocks").select("document_id", "block_id", "text", "page_number", F.to_json("bbox").alias("box"), F.col("ingested_at").cast("string").alias("at"))
    return H.doubled_keys(b, ["document_id", "block_id"], ["text", "page_number", "box", "at"])


def citation_by_document(spark: SparkSession, d: str) -> DataFrame:
    """How many citations of which documents there are."""
    b = C.distinct_citations(C.build(C.resolve_requests(_once(spark, d, "citation_requests", "request_id"), table(spark, d, "blocks"))))
    return b.groupBy("document_id").agg(F.count("*").alias("n_citations"))


def queries() -> dict:
    fs = [report_title, publication_date, made_dates, analyst_order, revision_requests, rationale_requests, revision_citations, brief_rows_cited, semantic_keys, sibling_items, driver_validation, warning_filter, safe_sources, box_checks, doubled_blocks, citation_by_document]
    return {f.__name__: f for f in fs}


_LIVE = "(SELECT DISTINCT ON (document_id, block_id) * FROM blocks WHERE deleted_at IS NULL ORDER BY document_id, block_id)"
_PAGES = "(SELECT document_id, page_number, max(page_width) AS width, max(page_height) AS height FROM words GROUP BY 1, 2)"
_FRONT = f"""front AS (SELECT b.document_id, block_id, place, bbox.y0 AS y0, height, (bbox.y1 - bbox.y0) / greatest(len(ls), 1) AS lh, ls FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY block_order, block_id) AS place,
 list_filter(list_transform(string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10)), lambda x: trim(trim(regexp_replace(x, '[\\s\\p{{Z}}]+', ' ', 'g')), ' |')), lambda x: x <> '') AS ls FROM live WHERE page_number = 1 AND trim(text) <> '') b
 JOIN {_PAGES} p ON p.document_id = b.document_id AND p.page_number = 1)"""
_DATE = r"^(?:publication date|published|date)?\s*:?[ \t]*(\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}[./-]\d{1,2}[./-]\d{4})$"
_NO_TITLE = r"\b(?:bloomberg|reuters|analysts?|research|target price|price target|rating|telephone|phone|email|disclosures?|contents|page \d+|www\.|equity research|company research|first reaction note|first take|company update|this insert is part of|sector report)\b|\b(?:sector|price)\s*:|@"
_RATING = r"^(?:[A-Za-z0-9.&''’\-]+\s+){0,3}(?:buy|hold|sell|overweight|underweight|neutral|outperform|underperform)(?:\s*\([^)]{1,20}\))?$"
_DATES_SQL = f""", {_FRONT}, d AS (SELECT document_id, block_id, try_strptime(nullif(regexp_extract(line, '{_DATE}', 1, 'i'), ''), ['%d %B %Y', '%d %b %Y', '%Y-%m-%d', '%d/%m/%Y', '%d.%m.%Y', '%d-%m-%Y']) AS d FROM (SELECT document_id, block_id, unnest(ls) AS line FROM front WHERE y0 <= height * 0.25))
SELECT document_id, CASE WHEN count(DISTINCT d) = 1 THEN strftime(any_value(d), '%Y-%m-%d') END AS published, CASE WHEN count(DISTINCT d) = 1 THEN array_to_string(list_sort(list(DISTINCT block_id)), '|') END AS block_ids FROM d WHERE d IS NOT NULL GROUP BY document_id"""
_MADE = """(SELECT * REPLACE (CASE WHEN page_number = 1 AND block_order <= 1 AND text IS NOT NULL THEN text || chr(10) || CASE right(block_id, 1) WHEN '0' THEN 'Date:' || strftime(day, '%-d %B %Y') WHEN '1' THEN 'Published: ' || strftime(day, '%-d %b %Y') WHEN '2' THEN strftime(day, '%Y-%m-%d')
 WHEN '3' THEN strftime(day, '%-d/%-m/%Y') WHEN '4' THEN 'publication date ' || strftime(day, '%d.%m.%Y') WHEN '5' THEN strftime(day, '%-d-%-m-%Y') WHEN '6' THEN 'On ' || strftime(day, '%-d %B %Y') WHEN '7' THEN strftime(day, '%-d %B %Y') || ', rated Buy' WHEN '8' THEN strftime(day, '%Y-%m-%d') || chr(10) || '2024-01-01' ELSE '' END ELSE text END AS text)
 FROM (SELECT *, CASE WHEN page_number = 1 THEN make_date(2025, 1 + length(text) % 12, 1 + length(text) % 28) END AS day FROM live0))"""
_R = "(SELECT DISTINCT ON (revision_id) * FROM revisions ORDER BY revision_id)"
_REQ = f"""(SELECT document_id, revision_id, no, e, metric, fiscal_period, evidence[e].block_ids AS ids FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seq, revision_id) AS no FROM {_R}), LATERAL (SELECT unnest(range(1, len(evidence) + 1)) AS e))"""
_CITED = f"""(SELECT document_id, revision_id, count(DISTINCT (page_number, ids)) AS n_citations FROM (SELECT document_id, revision_id, e, page_number, list(block_id ORDER BY i) AS ids FROM (SELECT x.*, b.page_number, bool_and(b.block_id IS NOT NULL) OVER (PARTITION BY x.revision_id, x.e) AS whole FROM
 (SELECT document_id, revision_id, e, min(i) AS i, block_id FROM (SELECT document_id, revision_id, e, unnest(ids) AS block_id, unnest(range(1, len(ids) + 1)) AS i FROM {_REQ}) GROUP BY 1, 2, 3, 5) x LEFT JOIN (SELECT DISTINCT ON (document_id, block_id) document_id, block_id, page_number FROM blocks) b USING (document_id, block_id)) WHERE whole GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)"""
_POLES = r"list_filter([CASE WHEN regexp_matches({0}, '(?i)\b(?:lower(?:ed|s)?|reduce[sd]?|cut(?:s|ting)?|weigh(?:ed|s)?|hurt(?:s|ing)?|declin(?:e[sd]?|ing))\b') THEN 'n' END, CASE WHEN regexp_matches({0}, '(?i)\b(?:raise[sd]?|increase[sd]?|lift(?:ed|s)?|support(?:ed|s)?|boost(?:ed|s)?|improv(?:e[sd]?|ing))\b') THEN 'p' END], lambda x: x IS NOT NULL)"
_NEUTRAL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\b(?:raise[sd]?|increase[sd]?|lift(?:ed|s)?|support(?:ed|s)?|boost(?:ed|s)?|improv(?:e[sd]?|ing))\b', ' effect ', 'g'), '\b(?:lower(?:ed|s)?|reduce[sd]?|cut(?:s|ting)?|weigh(?:ed|s)?|hurt(?:s|ing)?|declin(?:e[sd]?|ing))\b', ' effect ', 'g'), '\s+', ' ', 'g'))"


def oracle_sql() -> dict:
    from quireloom.plans.documents_plan import oracle_sql as documents_sql

    keys = ",".join(f'"{k}":1' for k in ["rationale_clarity", "drivers", "why_now", "report_context", "context_evidence_block_ids", "management_contact", "management_evidence_block_ids", "people_met", "one_line_takeaway", "jargon_definitions", "important_first_read_items", "warnings"])
    ids = "list_filter({0}, lambda x, j: list_position({0}, x) = j)"
    return {
        "report_title": f"""WITH live AS {_LIVE}, {_FRONT}, p AS (SELECT *, unnest(range(1, len(ls) + 1)) AS st FROM front WHERE y0 <= height * 0.48 AND place <= 40), q AS (SELECT *, unnest(range(1, least(3, len(ls) - st + 1) + 1)) AS n FROM p),
l AS (SELECT document_id, block_id, place, y0, height, lh, n, array_to_string(ls[st:st + n - 1], ' ') AS line FROM q WHERE n = 1 OR len(list_filter(ls[st:st + n - 1], lambda x: len(regexp_extract_all(x, '[A-Za-z0-9]+')) < 2)) = 0),
w AS (SELECT *, len(regexp_extract_all(line, '[A-Za-z][A-Za-z0-9&''\\-/]*')) AS k FROM l),
s AS (SELECT *, greatest(0.0::DOUBLE, 70.0::DOUBLE - y0 / greatest(height, 1.0::DOUBLE) * 100.0::DOUBLE) + least(lh, 28.0::DOUBLE) * 2.0::DOUBLE + CASE WHEN k BETWEEN 4 AND 16 THEN 12.0::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(line, '[:\\-–—]') THEN 4.0::DOUBLE ELSE 0 END + 6.0::DOUBLE * (n - 1) AS score FROM w
 WHERE k BETWEEN 3 AND 24 AND length(line) BETWEEN 12 AND 220 AND NOT regexp_matches(line, '(?i){_NO_TITLE}') AND NOT regexp_matches(line, '(?i){_RATING}') AND length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) / length(line) >= 0.55 AND NOT regexp_matches(line, '^[A-Z]{{1,6}}(?:\\s+[A-Z]{{2}})?$'))
SELECT document_id, line AS title, round(score, 6) AS title_score, block_id FROM s QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY score DESC, place, line DESC, block_id DESC) = 1""",
        "publication_date": f"WITH live AS {_LIVE}{_DATES_SQL}",
        "made_dates": f"WITH live0 AS {_LIVE}, live AS {_MADE}{_DATES_SQL}",
        "analyst_order": "SELECT document_id, analyst_row_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY CASE selection_status WHEN 'covering' THEN 0 WHEN 'lead' THEN 1 WHEN 'relevant' THEN 2 ELSE 3 END, lower(coalesce(name, '')), coalesce(email, ''), analyst_row_id) AS INTEGER) AS place FROM (SELECT DISTINCT ON (analyst_row_id) * FROM analysts ORDER BY analyst_row_id)",
        "revision_requests": f"SELECT document_id, 'revision:' || no || ':evidence:' || e AS claim_key, replace(metric, '_', ' ') || ' ' || coalesce(fiscal_period, 'current') || ' revision evidence' AS label, coalesce(array_to_string(ids, '|'), CASE WHEN ids IS NOT NULL THEN '' END) AS block_ids, metric AS highlight_metric, fiscal_period AS highlight_period FROM {_REQ}",
        "rationale_requests": """WITH d AS (SELECT document_id, evidence_block_ids AS ids, row_number() OVER (PARTITION BY document_id ORDER BY ordinal, driver_id) AS no FROM (SELECT DISTINCT ON (driver_id) * FROM drivers ORDER BY driver_id)),
c AS (SELECT document_id, kind, evidence_block_ids AS ids, row_number() OVER (PARTITION BY document_id, kind ORDER BY ordinal, claim_id) AS no FROM (SELECT DISTINCT ON (claim_id) * FROM claims ORDER BY claim_id)),
u AS (SELECT document_id, ids, 'Rationale driver ' || no AS label, 'rationale:driver:' || no AS claim_key FROM d UNION ALL SELECT document_id, ids, 'First-read item ' || no, 'rationale:first_read:' || no FROM c WHERE kind = 'first_read' UNION ALL SELECT document_id, ids, 'Why now', 'rationale:why_now' FROM c WHERE kind = 'why_now' AND no = 1
 UNION ALL SELECT document_id, ids, 'One-line takeaway', 'rationale:takeaway' FROM c WHERE kind = 'one_line_takeaway' AND no = 1) SELECT document_id, claim_key, label, array_to_string(ids, '|') AS block_ids FROM u WHERE len(ids) > 0""",
        "revision_citations": f"SELECT document_id, revision_id, CAST(n_citations AS INTEGER) AS n_citations FROM {_CITED}",
        "brief_rows_cited": f"SELECT document_id, least(count(*), 8) AS n_rows, greatest(0, count(*) - 8) AS n_omitted FROM {_R} WHERE revision_id IN (SELECT revision_id FROM {_CITED}) GROUP BY 1",
        "semantic_keys": f"""WITH j AS (SELECT DISTINCT claim_id, CASE claim_id % 4 WHEN 0 THEN '{{{keys}}}' WHEN 1 THEN '{{{keys.rsplit(",", 1)[0]}}}' WHEN 2 THEN '{{{keys},"more":1}}' ELSE text END AS t FROM claims)
SELECT claim_id, coalesce(CASE WHEN json_valid(t) THEN list_sort(json_keys(t)) = list_sort(json_keys('{{{keys}}}')) END, false) AS exact FROM j""",
        "sibling_items": f"""WITH ok AS ({documents_sql()["claim_support"]}), c AS (SELECT DISTINCT ON (claim_id) * FROM claims ORDER BY claim_id),
b AS (SELECT DISTINCT document_id, block_id FROM blocks), v AS (SELECT c.claim_id, c.document_id, ordinal, trim(c.text) AS said, list_filter({ids.format("c.evidence_block_ids")}, lambda i: list_contains(k.known, i)) AS ids FROM c JOIN ok ON ok.claim_id = c.claim_id AND ok.valid JOIN (SELECT document_id, list(block_id) AS known FROM b GROUP BY 1) k ON k.document_id = c.document_id WHERE kind = 'first_read'),
x AS (SELECT claim_id, document_id, ordinal, ids, no, pre || said AS text FROM v, (VALUES (0, ''), (1, ''), (2, 'We raised it: '), (3, 'We cut it: '), (4, 'We raised and cut it: '), (5, 'We lowered it: ')) f(no, pre)),
y AS (SELECT *, {_POLES.format("text")} AS p, {_NEUTRAL} AS neutral, lower(trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g'))) AS same FROM x),
z AS (SELECT *, list(p) OVER (PARTITION BY document_id, ids, neutral ORDER BY ordinal, claim_id, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps FROM y),
q AS (SELECT *, coalesce(len(p) > 0 AND len(list_filter(ps, lambda q: len(q) > 0)) > 0 AND len(list_filter(ps, lambda q: len(q) = 2)) = 0 AND NOT list_has_any(p, list_filter(ps, lambda q: len(q) > 0)[1]), false) AS against FROM z)
SELECT claim_id, no, CASE WHEN bool_or(NOT against) OVER (PARTITION BY document_id, same, ids ORDER BY ordinal, claim_id, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'duplicate' WHEN against THEN 'contradiction' END AS sibling FROM q""",
        "driver_validation": f"""WITH l AS ({documents_sql()["driver_links"]}), it AS ({documents_sql()["driver_items"]}), bk AS (SELECT document_id, list(DISTINCT block_id) AS known FROM blocks GROUP BY 1),
c AS (SELECT DISTINCT ON (driver_id) * FROM drivers ORDER BY driver_id), v AS (SELECT c.driver_id, c.document_id, ordinal, driver AS text, list_filter(coalesce({ids.format("c.evidence_block_ids")}[1:100], []), lambda x: list_contains(known, x)) AS ids, l.link, l.supported, it.metrics, it.periods FROM c JOIN l USING (driver_id) JOIN it ON it.driver_id = c.driver_id LEFT JOIN bk ON bk.document_id = c.document_id),
o AS (SELECT *, CASE WHEN NOT supported OR len(ids) = 0 THEN 'unsupported_driver_removed' WHEN link IS NULL THEN 'unsupported_causal_driver_removed' END AS first FROM v),
y AS (SELECT *, {_POLES.format("text")} AS p, {_NEUTRAL} AS neutral, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS same FROM o WHERE first IS NULL),
z AS (SELECT *, list(p) OVER (PARTITION BY document_id, metrics, periods, ids, neutral ORDER BY ordinal, driver_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps FROM y),
q AS (SELECT *, coalesce(len(p) > 0 AND len(list_filter(ps, lambda q: len(q) > 0)) > 0 AND len(list_filter(ps, lambda q: len(q) = 2)) = 0 AND NOT list_has_any(p, list_filter(ps, lambda q: len(q) > 0)[1]), false) AS against FROM z),
k AS (SELECT driver_id, CASE WHEN bool_or(NOT against) OVER (PARTITION BY document_id, same, metrics, periods, ids ORDER BY ordinal, driver_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'duplicate_driver_removed' WHEN against THEN 'contradictory_driver_removed' END AS sib FROM q),
f AS (SELECT o.*, coalesce(first, sib) AS problem FROM o LEFT JOIN k USING (driver_id))
SELECT driver_id, problem, CASE WHEN problem IS NULL THEN link END AS link, CASE WHEN problem IS NULL THEN CASE WHEN link = 'explicit' AND metrics <> '' AND periods <> '' THEN 'high' WHEN link = 'explicit' OR metrics <> '' OR periods <> '' THEN 'medium' ELSE 'low' END END AS confidence, metrics, periods FROM f""",
        "warning_filter": f"""WITH w AS (SELECT revision_id, list_filter(list_concat(coalesce(warnings, []), [direction, unit, upper(direction), 'zero_old_value_no_relative_revision', extraction_method, CASE WHEN revision_id % 2 = 0 THEN 'consensus_unit_mismatch' END, direction]), lambda x: x IS NOT NULL) AS w FROM {_R}),
u AS (SELECT revision_id, {ids.format("w")} AS w FROM w) SELECT revision_id, coalesce(array_to_string(list_filter(w, lambda x: regexp_matches(x, '^[a-z][a-z0-9_]{{0,79}}$')), '|'), '') AS codes, coalesce(array_to_string(list_filter(w, lambda x: x IN ('old_new_unit_mismatch', 'consensus_unit_mismatch', 'zero_old_value_no_relative_revision', 'stated_calculated_revision_mismatch', 'stated_calculated_percentage_point_mismatch', 'conflicting_candidates_same_metric_period')), '|'), '') AS material FROM u""",
        "safe_sources": r"""WITH p AS (SELECT DISTINCT unnest([source_filename, 'a/b/' || source_filename, '../' || source_filename, '/a/' || source_filename, 'a//' || source_filename, 'a/./' || source_filename, 'a\' || source_filename, upper(source_filename)]) AS path FROM blocks UNION SELECT path FROM documents)
SELECT path, coalesce(lower(path) LIKE '%.pdf' AND NOT contains(path, '\') AND NOT regexp_matches('/' || path || '/', '/(\.{1,2})?/'), false) AS safe FROM p""",
        "box_checks": f"""WITH b AS (SELECT document_id, block_id, CASE block_order % 6 WHEN 1 THEN -0.4 WHEN 2 THEN -0.6 WHEN 3 THEN bbox.x1 WHEN 4 THEN 'nan'::DOUBLE ELSE bbox.x0 END AS x0, bbox.y0 AS y0, CASE block_order % 6 WHEN 5 THEN width + 0.5 ELSE bbox.x1 END AS x1, bbox.y1 AS y1, width, height FROM {_LIVE} JOIN {_PAGES} USING (document_id, page_number)),
c AS (SELECT *, coalesce(NOT isnan(x0) AND x0 < x1 AND y0 < y1 AND x0 >= -0.5 AND y0 >= -0.5 AND x1 <= width + 0.5 AND y1 <= height + 0.5, false) AS ok FROM b)
SELECT document_id, block_id, CASE WHEN NOT ok THEN 'invalid_bounding_box' END AS code, CASE WHEN ok THEN round(greatest(x0, 0), 3) END AS x0, CASE WHEN ok THEN round(greatest(y0, 0), 3) END AS y0, CASE WHEN ok THEN round(least(x1, width), 3) END AS x1, CASE WHEN ok THEN round(least(y1, height), 3) END AS y1 FROM c""",
        "doubled_blocks": "SELECT document_id, block_id, count(DISTINCT (coalesce(text, chr(0)), page_number, bbox, ingested_at)) AS n_contents FROM blocks GROUP BY 1, 2 HAVING n_contents > 1",
        "citation_by_document": f"SELECT document_id, count(*) AS n_citations FROM ({documents_sql()['citation_dedup']}) GROUP BY 1",
    }
