"""Queries of the retrieval layer over blocks (pages, file names) and queries (requests)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.functions import text as X
from quireloom.operators import retrieval as R
from quireloom.session import cut, table
from quireloom.sources.reports import live_blocks, page_lines

TICKER = r"(?:Bloomberg|BLOOMBERG|Ticker|TICKER):?\s+([A-Z]{2,5} [A-Z]{2})\b"


Input = Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]


def recorded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The blocks and the requests as they are."""
    return table(spark, d, "blocks"), table(spark, d, "queries")


def made(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The blocks with all reports of a year on its first day, and a request for each ticker that a first page prints.

    The recorded requests hardly ever meet a report; these meet groups of reports
    of one source. By the last digit of its digest, a report's request is for a
    ticker of no report (0), malformed (1), of another year (2) or without a
    source (3), and the report has its first page second (4), no text (5), one
    ticker with others (6 to 9) or the ticker deep in a page only (a, b).
    """
    b = _made_blocks(spark, d)
    return b.drop("x", "t"), _made_requests(live_blocks(b))


def _made_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of made, with the last digit of the digest (x) and the ticker that a first page prints (t)."""
    name, x = F.col("source_filename"), F.regexp_extract("source_filename", r"([0-9a-f])\.pdf$", 1)
    day = F.concat(F.substring(name, 1, 4), F.lit("0101"), F.expr("substring(source_filename, 9)"))
    b = table(spark, d, "blocks").withColumn("source_filename", F.when(name.rlike(r"^\d{8}_"), day).otherwise(name))
    t = F.when(F.col("page_number") == 1, F.regexp_extract("text", TICKER, 1)).otherwise("")
    b = b.withColumns({"x": x, "t": t})
    x = F.col("x")
    deep = F.concat(F.repeat(F.lit("filler\n"), F.lit(30)), F.lit("Peer "), F.col("t"), F.lit(" moved"))
    text = F.when(x == "5", F.lit(None)).when((F.col("t") != "") & x.between("6", "9"), F.replace("text", "t", F.lit("TIE US"))).when((F.col("t") != "") & x.isin("a", "b"), deep).otherwise(F.col("text"))
    return b.withColumns({"text": text, "page_number": F.when((x == "4") & (F.col("page_number") <= 2), 3 - F.col("page_number")).otherwise(F.col("page_number"))})


def _made_requests(live: DataFrame) -> DataFrame:
    """The requests of made, from its live blocks."""
    name, x = F.col("source_filename"), F.col("x")
    seen = live.where(F.col("t") != "").select("source_filename", "t", "x").distinct()
    ticker = F.when(x == "0", "XQX US").when(x == "1", "AB").when(x.between("6", "9"), "TIE US").otherwise(F.col("t"))
    date = F.concat(F.when(x == "2", "1999").otherwise(F.substring(name, 1, 4)), F.lit("-01-01"))
    broker = F.when(x == "3", "--").otherwise(F.regexp_extract("source_filename", r"^[^_]*_(.+)_[^_]*$", 1))
    return seen.select(F.concat_ws("|", name, "t").alias("query_id"), ticker.alias("ticker"), date.alias("query_date"), broker.alias("broker"))


def _parts(spark: SparkSession, d: str, given: Input = recorded):  # noqa: ANN202
    b, q = given(spark, d)
    blocks = live_blocks(b)
    catalog = R.catalog_of(blocks, "source_filename")
    q = R.normalized_queries(q)
    return blocks, catalog, q, R.shortlist(q, catalog)


def _evidence(spark: SparkSession, d: str):  # noqa: ANN202
    blocks, _, q, short = _parts(spark, d)
    lines = page_lines(blocks, pages=2).join(short.select("filename").distinct(), "filename", "left_semi")
    return q, short, R.ticker_evidence(short, R.labelled_lines(lines.select("filename", "page_number", "line_number", "line")))


def _candidates(spark: SparkSession, d: str):  # noqa: ANN202
    q, short, ev = _evidence(spark, d)
    return q, R.candidates(short, ev, _unread(table(spark, d, "blocks")))


def _unread(blocks: DataFrame) -> DataFrame:
    """A report one of whose first pages has only null texts can't be read there."""
    pages = blocks.where(F.col("page_number") <= 2).groupBy(F.col("source_filename").alias("filename"), "page_number").agg(F.count("text").alias("n"))
    return pages.where("n = 0")


def _asked(spark: SparkSession, d: str):  # noqa: ANN202
    """The made requests, the catalog and the evidence of what is asked.

    The live blocks are written once for the three. They are dealt by document,
    then by file, so that each text is shuffled twice and next to its neighbours.
    """
    b = _made_blocks(spark, d).repartition("document_id")
    b = b.withColumn("text", F.when(F.col("page_number") <= 2, F.col("text")))
    live = cut(live_blocks(b).select("document_id", "block_id", "source_filename", "page_number", "block_order", "text", "x", "t"))
    q, catalog = cut(R.normalized_queries(_made_requests(live))), cut(R.catalog_of(live, "source_filename"))
    lines = page_lines(live.repartition("source_filename"), pages=2).select("filename", "page_number", "line_number", "line")
    return q, catalog, cut(R.asked_evidence(q, catalog, R.labelled_lines(lines)))


def catalog_filename_parse(spark: SparkSession, d: str) -> DataFrame:
    return R.catalog_of(table(spark, d, "blocks"), "source_filename")


def catalog_shortlist_join(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d)[3]


def broker_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").select("broker").distinct().select("broker", X.normalize_broker(F.col("broker")).alias("broker_key"))


def ticker_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").select("ticker").distinct().select("ticker", X.normalize_ticker(F.col("ticker")).alias("ticker_key"))


def query_date_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").select("query_date").distinct().select("query_date", X.english_date(F.col("query_date")).alias("date_key"))


def line_explode_clean(spark: SparkSession, d: str) -> DataFrame:
    x = page_lines(live_blocks(table(spark, d, "blocks")))
    return x.select("filename", "page_number", "line_number", X.clean_line(F.col("line")).alias("line"))


def ticker_evidence_score(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d)[2]


def candidate_rank_margin(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(_candidates(spark, d)[1]).select("query_id", "filename", F.col("s2").alias("score"), "rank", "lead", "confidence")


def retrieval_status(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve(*_candidates(spark, d))


def made_shortlist(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d, made)[3]


def made_evidence(spark: SparkSession, d: str) -> DataFrame:
    q, _, ev = _asked(spark, d)
    return R.of_each(ev, q).select("query_id", "filename", "page_number", "line_number", "kind", "score")


def made_rank_margin(spark: SparkSession, d: str) -> DataFrame:
    q, catalog, ev = _asked(spark, d)
    return R.ranked_of_each(q, R.readable(catalog, _unread(_made_blocks(spark, d))), ev)


def made_status(spark: SparkSession, d: str) -> DataFrame:
    q, catalog, ev = _asked(spark, d)
    return R.resolve_asked(q, R.readable(catalog, _unread(_made_blocks(spark, d))), ev)


def page_range_prune(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the pages that '1-2,{last}' names, per document; a reversed range names none."""
    b = live_blocks(table(spark, d, "blocks")).select("document_id", "page_number", "block_id")
    n = b.groupBy("document_id").agg(F.max("page_number").alias("n"))
    spec = F.when(F.col("n") % 5 == 0, F.lit("2-1")).otherwise(F.concat(F.lit("1-2,"), F.col("n").cast("string")))
    pages = n.select("document_id", F.explode(X.page_range(spec, F.col("n"))).alias("page_number"))
    return b.join(pages, ["document_id", "page_number"], "left_semi")


def document_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where(F.col("text").isNotNull())
    return t.select("doc_id", X.document_id(F.col("text")).alias("document_id"), F.octet_length("text").cast("bigint").alias("size"))


def block_id_hash(spark: SparkSession, d: str) -> DataFrame:
    b = live_blocks(table(spark, d, "blocks")).where(F.col("text").isNotNull() & F.col("bbox").isNotNull())
    return b.select("document_id", "block_id", X.block_identity(F.col("document_id"), F.col("page_number"), F.col("block_order"), F.col("block_order"), F.col("bbox"), F.col("text")).alias("own_id"))


def redacted_lines(spark: SparkSession, d: str) -> DataFrame:
    """Texts and file names of blocks with marks instead of addresses, paths and file names."""
    b = live_blocks(table(spark, d, "blocks")).where(F.col("text").isNotNull())
    return b.select("document_id", "block_id", X.redact(F.col("text")).alias("text"), X.redact(F.col("source_filename")).alias("source_filename"))


def queries() -> dict:
    fs = [catalog_filename_parse, catalog_shortlist_join, broker_normalize, ticker_normalize, query_date_normalize, line_explode_clean, ticker_evidence_score, candidate_rank_margin, retrieval_status, made_shortlist, made_evidence, made_rank_margin, made_status, page_range_prune, document_fingerprint, block_id_hash, redacted_lines]
    return {f.__name__: f for f in fs}


_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "KÅ"
_PLAIN = ("".join(chr(0x21 + i) for i in range(94)) + "KA").replace("'", "''")
def _fold(x: str) -> str:
    return f"strip_accents(translate(nfc_normalize({x}), '{_WIDE}', '{_PLAIN}'))"


def _key(x: str) -> str:
    return f"regexp_replace(replace(lower({_fold(x)}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _ticker(x: str) -> str:
    tokens = f"trim(regexp_replace(upper({_fold(x)}), '[^A-Z0-9]+', ' ', 'g'))"
    return f"(CASE WHEN regexp_matches({tokens}, '^[A-Z0-9]+ [A-Z]{{2}}$') THEN regexp_replace({tokens}, ' GY$', ' GR') END)"


def _date(x: str) -> str:
    t = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"""(CASE WHEN regexp_matches({x}, '^[0-9]{{8}}$') THEN strftime(try_strptime({x}, '%Y%m%d'), '%Y%m%d') WHEN regexp_matches({x}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN strftime(try_strptime({x}, '%Y-%m-%d'), '%Y%m%d')
 ELSE strftime(coalesce(try_strptime({t}, '%d %b %Y'), try_strptime({t}, '%d %B %Y')), '%Y%m%d') END)"""


_P = "(?i)^([0-9]{8})_(.+)_([0-9a-f]{32})\\.pdf$"
_LIVE = "(SELECT DISTINCT ON (document_id, block_id) * FROM blocks WHERE deleted_at IS NULL ORDER BY document_id, block_id)"
def _cat(t: str) -> str:
    return f"(SELECT DISTINCT source_filename AS filename, regexp_extract(source_filename, '{_P}', 1) AS file_date, regexp_extract(source_filename, '{_P}', 2) AS file_broker, lower(regexp_extract(source_filename, '{_P}', 3)) AS digest FROM {t} b WHERE regexp_matches(source_filename, '{_P}'))"


_Q = f"(SELECT DISTINCT query_id, {_ticker('ticker')} AS ticker_key, {_date('query_date')} AS date_key, nullif({_key('broker')}, '') AS broker_key FROM queries)"
_SHORT = f"(SELECT query_id, ticker_key, filename FROM {_Q} q JOIN {_cat(_LIVE)} c ON c.file_date = q.date_key AND {_key('c.file_broker')} = q.broker_key WHERE ticker_key IS NOT NULL)"
_LINES = f"""(SELECT filename, page_number, unnest(range(1, len(ls) + 1)) AS line_number, unnest(ls) AS line FROM (SELECT filename, page_number, string_split(string_agg(t, chr(10) ORDER BY block_order, block_id), chr(10)) AS ls FROM
 (SELECT source_filename AS filename, document_id, page_number, block_order, block_id, regexp_replace(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), '\\n$', '') AS t FROM {_LIVE} WHERE text <> '') GROUP BY filename, document_id, page_number))"""
_EVIDENCE = f"""(WITH s AS {_SHORT}, n AS (SELECT filename, page_number, line_number, trim(regexp_replace(line, '[\\s\\p{{Z}}]+', ' ', 'g')) AS line FROM {_LINES} WHERE page_number <= 2),
 l AS (SELECT *, upper(line) AS u FROM n WHERE line <> ''),
 f AS (SELECT *, ' ' || regexp_replace(trim(regexp_replace(upper({_fold('line')}), '[^A-Z0-9]+', ' ', 'g')), '\\bGY\\b', 'GR', 'g') || ' ' AS toks, len(list_distinct(regexp_extract_all(u, '[A-Z]+'))) AS nw,
  length(line) <= 140 AND (starts_with(u, 'REUTERS ') OR starts_with(u, 'EXCHANGE ')) AS h FROM l),
 m AS (SELECT *, length(line) <= 140 AND (starts_with(u, 'BLOOMBERG') OR (h AND nw <= 8 AND list_contains(regexp_extract_all(u, '[A-Z]+'), 'BLOOMBERG'))) AS b, length(line) <= 140 AND (starts_with(u, 'TICKER') OR (h AND nw <= 8 AND list_contains(regexp_extract_all(u, '[A-Z]+'), 'TICKER'))) AS t FROM f),
 w AS (SELECT *, bool_or(b) OVER p AS nb, bool_or(t) OVER p AS nt, len(regexp_extract_all(u, '[A-Z0-9]+')) AS np FROM m WINDOW p AS (PARTITION BY filename, page_number ORDER BY line_number ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
 j AS (SELECT * FROM s JOIN w USING (filename) WHERE contains(toks, ' ' || ticker_key || ' ') OR (regexp_matches(u, '[,/|():]') AND list_contains(string_split_regex(upper({_fold('line')}), '[^A-Z0-9]+'), replace(ticker_key, ' ', ''))))
 SELECT query_id, filename, page_number, CAST(line_number AS INTEGER) AS line_number,
  CASE WHEN nb THEN 'explicit_bloomberg_field' WHEN nt THEN 'explicit_ticker_field' WHEN page_number = 1 AND (line_number <= 25 OR (length(line) <= 120 AND regexp_matches(line, '[,/|()]') AND np BETWEEN 3 AND 6)) THEN 'header_or_title' WHEN page_number = 1 AND line_number <= 45 THEN 'possible_header'
   WHEN page_number = 1 THEN 'first_page_body' WHEN line_number <= 30 THEN 'later_page_header' ELSE 'later_page_body' END AS kind,
  CASE WHEN nb THEN if(page_number = 1, 120, 95) WHEN nt THEN if(page_number = 1, 105, 85) WHEN page_number = 1 AND (line_number <= 25 OR (length(line) <= 120 AND regexp_matches(line, '[,/|()]') AND np BETWEEN 3 AND 6)) THEN 85 WHEN page_number = 1 AND line_number <= 45 THEN 55
   WHEN page_number = 1 THEN 25 WHEN line_number <= 30 THEN 45 ELSE 15 END AS score FROM j)"""
_CAND = f"""(SELECT s.query_id, s.filename, coalesce(max(CASE WHEN page_number = 1 THEN score END), 0) AS s1, coalesce(max(score), 0) AS s2, coalesce(any_value(e1), false) AS e1, coalesce(any_value(e2), false) AS e2 FROM {_SHORT} s LEFT JOIN {_EVIDENCE} e ON e.query_id = s.query_id AND e.filename = s.filename
 LEFT JOIN (SELECT filename, bool_or(page_number = 1) AS e1, true AS e2 FROM (SELECT source_filename AS filename, page_number FROM blocks WHERE page_number <= 2 GROUP BY ALL HAVING count(text) = 0) GROUP BY 1) r ON r.filename = s.filename GROUP BY 1, 2)"""
_RANK = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, e2, lower(filename), filename) AS rank, s2 - coalesce(lead(s2) OVER (PARTITION BY query_id ORDER BY s2 DESC, e2, lower(filename), filename), 0) AS lead FROM {_CAND}"


_MADE = rf"""WITH made_raw AS (SELECT * REPLACE (CASE WHEN regexp_matches(source_filename, '^[0-9]{{8}}_') THEN left(source_filename, 4) || '0101' || substr(source_filename, 9) ELSE source_filename END AS source_filename),
 regexp_extract(source_filename, '([0-9a-f])\.pdf$', 1) AS x, CASE WHEN page_number = 1 THEN coalesce(regexp_extract(text, '{TICKER}', 1), '') ELSE '' END AS t FROM blocks),
made_blocks AS (SELECT * EXCLUDE (x, t) REPLACE (CASE WHEN x = '5' THEN NULL WHEN t <> '' AND x BETWEEN '6' AND '9' THEN replace(text, t, 'TIE US') WHEN t <> '' AND x IN ('a', 'b') THEN repeat('filler' || chr(10), 30) || 'Peer ' || t || ' moved' ELSE text END AS text,
 CASE WHEN x = '4' AND page_number <= 2 THEN 3 - page_number ELSE page_number END AS page_number) FROM made_raw),
made_seen AS (SELECT DISTINCT source_filename AS f, t, x FROM (SELECT DISTINCT ON (document_id, block_id) * FROM made_raw WHERE deleted_at IS NULL ORDER BY document_id, block_id) WHERE t <> ''),
made_queries AS (SELECT f || '|' || t AS query_id, CASE WHEN x = '0' THEN 'XQX US' WHEN x = '1' THEN 'AB' WHEN x BETWEEN '6' AND '9' THEN 'TIE US' ELSE t END AS ticker, CASE x WHEN '2' THEN '1999' ELSE left(f, 4) END || '-01-01' AS query_date, CASE x WHEN '3' THEN '--' ELSE regexp_extract(f, '^[^_]*_(.+)_[^_]*$', 1) END AS broker FROM made_seen)
SELECT * FROM ("""


def oracle_sql() -> dict:
    own = recorded_sql()
    made_of = {"made_shortlist": "catalog_shortlist_join", "made_evidence": "ticker_evidence_score", "made_rank_margin": "candidate_rank_margin", "made_status": "retrieval_status"}
    return own | {k: _MADE + own[v].replace("FROM queries", "FROM made_queries").replace("FROM blocks", "FROM made_blocks") + ")" for k, v in made_of.items()}


def recorded_sql() -> dict:
    return {
        "catalog_filename_parse": f"SELECT filename, file_date, file_broker, {_key('file_broker')} AS broker_key, digest FROM {_cat('blocks')}",
        "catalog_shortlist_join": f"SELECT * FROM {_SHORT}",
        "broker_normalize": f"SELECT DISTINCT broker, {_key('broker')} AS broker_key FROM queries",
        "ticker_normalize": f"SELECT DISTINCT ticker, {_ticker('ticker')} AS ticker_key FROM queries",
        "query_date_normalize": f"SELECT DISTINCT query_date, {_date('query_date')} AS date_key FROM queries",
        "line_explode_clean": f"SELECT filename, page_number, CAST(line_number AS INTEGER) AS line_number, trim(trim(regexp_replace(line, '[\\s\\p{{Z}}]+', ' ', 'g')), ' |') AS line FROM {_LINES}",
        "ticker_evidence_score": f"SELECT * FROM {_EVIDENCE}",
        "candidate_rank_margin": f"SELECT query_id, filename, s2 AS score, CAST(rank AS INTEGER) AS rank, lead, CASE WHEN s2 >= 105 THEN 'high_explicit' WHEN s2 >= 80 THEN 'strong' WHEN s2 > 0 THEN 'weak' ELSE 'none' END AS confidence FROM ({_RANK})",
        "retrieval_status": f"""WITH c AS {_CAND}, g AS (SELECT query_id, list(s1 ORDER BY s1 DESC) AS p1, list(s2 ORDER BY s2 DESC) AS p2, bool_or(e1) AS e1, bool_or(e2) AS e2, max_by(filename, s1) AS f1, max_by(filename, s2) AS f2, count(*) AS n FROM c GROUP BY 1),
x AS (SELECT q.query_id, CASE WHEN ticker_key IS NULL OR date_key IS NULL OR broker_key IS NULL THEN 'bad_ticker_date_or_broker' WHEN n IS NULL THEN 'no_report_of_date_and_broker' WHEN p1[1] >= 80 AND p1[1] - coalesce(p1[2], 0) >= 20 AND NOT e1 THEN 'page_1_match'
 WHEN p2[1] >= 80 AND p2[1] - coalesce(p2[2], 0) >= 20 AND NOT e2 THEN 'page_2_match' WHEN e2 THEN 'unreadable_candidate' WHEN p2[1] = 0 THEN 'ticker_not_in_reports' WHEN coalesce(p2[2], 0) > 0 AND p2[1] - p2[2] < 20 THEN 'tied_candidates' ELSE 'weak_evidence' END AS reason, f1, f2 FROM {_Q} q LEFT JOIN g USING (query_id))
SELECT query_id, CASE WHEN reason LIKE 'bad%' THEN 'invalid_query' WHEN reason IN ('no_report_of_date_and_broker', 'ticker_not_in_reports') THEN 'not_found' WHEN reason LIKE 'page%' THEN 'found' ELSE 'ambiguous' END AS status, reason, CASE reason WHEN 'page_1_match' THEN f1 WHEN 'page_2_match' THEN f2 END AS filename FROM x""",
        "page_range_prune": f"WITH b AS {_LIVE}, n AS (SELECT document_id, max(page_number) AS n FROM b GROUP BY 1) SELECT document_id, page_number, block_id FROM b JOIN n USING (document_id) WHERE n % 5 <> 0 AND n >= 2 AND (page_number <= 2 OR page_number = n)",
        "document_fingerprint": "SELECT doc_id, 'sha256:' || sha256(text) AS document_id, strlen(text) AS size FROM documents WHERE text IS NOT NULL",
        "block_id_hash": f"""SELECT document_id, block_id, printf('p%04d-b%04d-', page_number, block_order) || left(sha256(concat_ws(chr(31), document_id, page_number, block_order, block_order, printf('%.3f,%.3f,%.3f,%.3f', bbox.x0, bbox.y0, bbox.x1, bbox.y1), text)), 16) AS own_id FROM {_LIVE} WHERE text IS NOT NULL AND bbox IS NOT NULL""",
        "redacted_lines": f"SELECT document_id, block_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '[EMAIL]', 'g'), '(?i)[^\\s\"''/\\\\]+\\.pdf\\b', '[FILE]', 'g') AS text, regexp_replace(source_filename, '(?i)[^\\s\"''/\\\\]+\\.pdf\\b', '[FILE]', 'g') AS source_filename FROM {_LIVE} WHERE text IS NOT NULL",
    }
