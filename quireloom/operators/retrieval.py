"""Which report answers a (ticker, date, source) request; unresolved requests stay as rows with a reason.

catalog(filename), page_lines(filename, page_number, line_number, line) and
errors(filename, page_number) are tables; any number of requests is resolved in
one plan. Requests with a bad date, source or ticker come out as invalid_query.
A report that can't be read makes its request ambiguous, whatever the others say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireloom.functions import text as X
from quireloom.functions.columns import let, once
from quireloom.session import cut

STRONG, MARGIN = 80, 20  # fixed values: score of a strong match, least lead over the next
ASK = ["ticker_key", "date_key", "broker_key"]  # what a request asks
PACK = 256  # requests, and reports, in an array


def catalog_of(files: DataFrame, name: str = "filename") -> DataFrame:
    """filename, file_date, file_broker, broker_key, digest of the files whose name has the report form."""
    f = files.select(F.col(name).alias("filename")).distinct().withColumn("p", X.parse_filename(X.file_name(F.col("filename"))))
    return f.where(F.col("p").isNotNull()).select("filename", F.col("p.date").alias("file_date"), F.col("p.broker").alias("file_broker"), X.normalize_broker(F.col("p.broker")).alias("broker_key"), F.lower("p.digest").alias("digest"))


def normalized_queries(queries: DataFrame) -> DataFrame:
    """query_id, ticker_key, date_key, broker_key; null keys mark a bad request."""
    q = queries.select("query_id", "ticker", "query_date", "broker").distinct()
    return q.select("query_id", X.normalize_ticker(F.col("ticker")).alias("ticker_key"), X.english_date(F.col("query_date")).alias("date_key"), F.nullif(X.normalize_broker(F.col("broker")), F.lit("")).alias("broker_key"))


def shortlist(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, ticker_key, filename): only names are read, no content."""
    c = catalog.withColumnRenamed("file_date", "date_key")
    return queries.where(F.col("ticker_key").isNotNull()).join(c, ["date_key", "broker_key"]).select("query_id", "ticker_key", "filename")


def line_tickers(tokens: Column, upper: Column) -> Column:
    """The tickers in a line: two tokens side by side, or both run together in a line that looks like a list of identifiers."""
    pair = F.transform(tokens, lambda t, i: F.when(F.length(F.get(tokens, i + 1)) == 2, F.concat_ws(" ", t, F.get(tokens, i + 1))))
    whole = F.when(upper.rlike("[,/|():]"), F.transform(F.split(upper, "[^A-Z0-9]+"), lambda t: F.regexp_replace(t, "(..)$", " $1"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(pair, whole), lambda t: t.rlike("^[A-Z0-9]+ [A-Z]{2}$")))


def is_label(line: Column, label: str) -> Column:
    """A field label starts the line, or stands among the few words of an identifier heading."""
    u = F.upper(X.collapse(line))
    words = F.array_distinct(F.regexp_extract_all(u, F.lit("([A-Z]+)"), 1))
    heading = (u.startswith("REUTERS ") | u.startswith("EXCHANGE ")) & F.array_contains(words, label) & (F.size(words) <= 8)
    return (F.length(u) <= 140) & (u.startswith(label) | heading)


def paired_identifier(line: Column) -> Column:
    n = F.size(F.regexp_extract_all(F.upper(line), F.lit("([A-Z0-9]+)"), 1))
    return (F.length(line) <= 120) & line.rlike("[,/|()]") & n.between(3, 6)


def labelled_lines(page_lines: DataFrame) -> DataFrame:
    """Lines that aren't blank, with tokens and whether a label stands on them or on one of the two lines before."""
    w = Window.partitionBy("filename", "page_number").orderBy("line_number")
    x = page_lines.where(F.trim("line") != "").withColumn("line", X.collapse(F.col("line")))
    x = x.withColumns({"bloomberg": is_label(F.col("line"), "BLOOMBERG"), "ticker_label": is_label(F.col("line"), "TICKER")})
    near = w.rowsBetween(-2, 0)
    x = x.withColumns({"near_bloomberg": F.max("bloomberg").over(near), "near_ticker": F.max("ticker_label").over(near)})
    return once(once(x, "tokens", X.ticker_tokens(F.col("line"))), "upper", F.upper(X.nfkd("line")))


def evidence_kind(page: Column, line_no: Column, line: Column, bloomberg: Column, ticker: Column) -> Column:
    """struct<kind, score> of a line that holds the ticker; the first rule that fits."""
    first = page == 1
    # Kinds of evidence and their scores on the first and on later pages.
    ladder = [
        (bloomberg, "explicit_bloomberg_field", 120, 95), (ticker, "explicit_ticker_field", 105, 85), (first & ((line_no <= 25) | paired_identifier(line)), "header_or_title", 85, 85),
        (first & (line_no <= 45), "possible_header", 55, 55), (first, "first_page_body", 25, 25), (line_no <= 30, "later_page_header", 45, 45), (F.lit(True), "later_page_body", 15, 15),
    ]
    kind, score = F.lit(None).cast("string"), F.lit(0)
    for cond, name, a, b in reversed(ladder):
        kind, score = F.when(cond, name).otherwise(kind), F.when(cond, F.when(first, a).otherwise(b)).otherwise(score)
    return F.struct(kind.alias("kind"), score.alias("score"))


def confidence(score: Column) -> Column:
    return F.when(score >= 105, "high_explicit").when(score >= STRONG, "strong").when(score > 0, "weak").otherwise("none")


def ticker_evidence(short: DataFrame, lines: DataFrame) -> DataFrame:
    """(query_id, filename, page_number, line_number, kind, score) of the shortlisted reports' first two pages."""
    return _evidence(lines).join(short, ["filename", "ticker_key"]).select("query_id", "filename", "page_number", "line_number", "kind", "score")


def _evidence(lines: DataFrame) -> DataFrame:
    """(ticker_key, filename, page_number, line_number, kind, score) of all tickers in the first two pages."""
    k = evidence_kind(F.col("page_number"), F.col("line_number"), F.col("line"), F.col("near_bloomberg"), F.col("near_ticker"))
    x = lines.where(F.col("page_number") <= 2).withColumn("ticker_key", F.explode(line_tickers(F.col("tokens"), F.col("upper"))))
    return x.select("ticker_key", "filename", "page_number", "line_number", k.alias("k")).select("ticker_key", "filename", "page_number", "line_number", "k.kind", "k.score")


def asked_evidence(queries: DataFrame, catalog: DataFrame, lines: DataFrame) -> DataFrame:
    """ASK and (filename, page_number, line_number, kind, score): ticker_evidence once for all requests that ask the same.

    A report is met by as many requests as its source has reports of the day, but
    its lines hold a few tickers only: this grows with the lines.
    """
    c = catalog.select("filename", F.col("file_date").alias("date_key"), "broker_key")
    asks = cut(queries.select(*ASK).distinct())
    e = _evidence(lines).join(cut(asks.select("ticker_key").distinct()), "ticker_key", "left_semi")  # most pairs of words are no ticker of a request
    return e.join(c, "filename").join(asks, ASK).select(*ASK, "filename", "page_number", "line_number", "kind", "score")


def packed(queries: DataFrame) -> DataFrame:
    """ASK, part, query_ids: the requests that ask the same, by PACK in an array."""
    w = Window.partitionBy(*ASK).orderBy("query_id")
    q = queries.where(F.col("ticker_key").isNotNull() & F.col("date_key").isNotNull() & F.col("broker_key").isNotNull())
    q = q.select("query_id", *ASK, F.floor((F.row_number().over(w) - 1) / PACK).cast("int").alias("part"))
    return q.groupBy(*ASK, "part").agg(F.collect_list("query_id").alias("query_ids"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys in the session's number of tasks: its rows are few and short, but many come of each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def of_each(asked: DataFrame, queries: DataFrame) -> DataFrame:
    """asked, rows with ASK, for each request: query_id instead of ASK. A common ticker's rows are joined by parts of its requests."""
    p = packed(queries)
    n = p.groupBy(*ASK).agg(F.max("part").alias("n"))
    a = asked.join(n, ASK).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n")))).drop("n")
    return spread(a, *ASK, "part").join(p, [*ASK, "part"]).withColumn("query_id", F.explode("query_ids")).drop(*ASK, "part", "query_ids")


def candidates(short: DataFrame, evidence: DataFrame, errors: DataFrame) -> DataFrame:
    """Per request and report: score after page 1 and after page 2, the best evidence, and whether reading failed."""
    best = evidence.groupBy("query_id", "filename").agg(F.max(F.when(F.col("page_number") == 1, F.col("score"))).alias("s1"), F.max("score").alias("s2"), F.min_by("kind", F.struct(-F.col("score"), "page_number", "line_number")).alias("kind"))
    c = short.join(best, ["query_id", "filename"], "left").join(_failed(errors), "filename", "left")
    z = lambda c, d: F.coalesce(c, F.lit(d))
    return c.select("query_id", "filename", z("s1", 0).alias("s1"), z("s2", 0).alias("s2"), z("e1", False).alias("e1"), z("e2", False).alias("e2"), "kind")


def _failed(errors: DataFrame) -> DataFrame:
    """filename, e1, e2: reading failed on page 1, and on page 1 or 2."""
    return errors.groupBy("filename").agg(F.max(F.col("page_number") == 1).alias("e1"), F.lit(True).alias("e2"))


def ranked(c: DataFrame) -> DataFrame:
    """Candidates with their rank and the lead over the next one."""
    w = Window.partitionBy("query_id").orderBy(F.desc("s2"), "e2", F.lower("filename"), "filename")
    return c.withColumns({"rank": F.row_number().over(w), "lead": F.col("s2") - F.coalesce(F.lead("s2").over(w), F.lit(0)), "confidence": confidence(F.col("s2"))})


def readable(catalog: DataFrame, errors: DataFrame) -> DataFrame:
    """The reports (date_key, broker_key, filename) with e1, e2 and their place, from 0, among those of their source and day without evidence."""
    w = Window.partitionBy("date_key", "broker_key").orderBy("e2", F.lower("filename"), "filename")
    c = catalog.select(F.col("file_date").alias("date_key"), "broker_key", "filename").join(_failed(errors), "filename", "left")
    c = c.withColumns({k: F.coalesce(k, F.lit(False)) for k in ("e1", "e2")})
    return cut(c.withColumn("pos", F.row_number().over(w) - 1))


def ranked_of_each(queries: DataFrame, reports: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, filename, score, rank, lead, confidence): ranked, for all reports that readable has and all requests.

    Each request is ranked against each report of its source and day, so the
    result grows with the product. Up to the last step there are only requests
    that ask the same together, with PACK reports together: the marks are the
    reports with evidence, the others keep their order behind them.
    """
    s = evidence.groupBy(*ASK, "filename").agg(F.max("score").alias("score")).join(reports.select("filename", "pos"), "filename")
    w = Window.partitionBy(*ASK).orderBy(F.desc("score"), "pos")
    s = s.withColumns({"rank": F.row_number().over(w), "lead": F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0))})
    mark = F.struct((F.col("pos") % PACK).alias("at"), "score", "rank", "lead")
    marks = s.groupBy(*ASK, F.floor(F.col("pos") / PACK).cast("int").alias("slice")).agg(F.sort_array(F.collect_list(mark)).alias("marks"))
    files = reports.groupBy("date_key", "broker_key", F.floor(F.col("pos") / PACK).cast("int").alias("slice")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "filename"))), lambda x: x["filename"]).alias("files"))
    slices = files.groupBy("date_key", "broker_key").agg(F.collect_list("slice").alias("slices"))

    asks = queries.select(*ASK).distinct().join(slices, ["date_key", "broker_key"]).select(*ASK, F.explode("slices").alias("slice"))
    a = asks.join(marks, [*ASK, "slice"], "left").withColumn("marks", F.coalesce("marks", F.array().cast(marks.schema["marks"].dataType)))
    every = Window.partitionBy(*ASK)
    # How far behind its place a report without evidence is ranked, if it stands before all marks of its slice.
    a = a.withColumn("behind", F.sum(F.size("marks")).over(every) - F.coalesce(F.sum(F.size("marks")).over(every.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    a = spread(a.join(packed(queries), ASK), "date_key", "broker_key", "slice").join(files, ["date_key", "broker_key", "slice"])

    row = lambda f, score, rank, lead: F.struct(f.alias("filename"), score.cast("int").alias("score"), rank.cast("int").alias("rank"), lead.cast("int").alias("lead"))
    seen = F.transform("marks", lambda m: row(F.get("files", m["at"]), m["score"], m["rank"], m["lead"]))

    def unseen(i: Column) -> Column:
        """The rows between two marks."""
        lo, hi = F.coalesce(F.get("marks", i - 1)["at"] + 1, F.lit(0)), F.coalesce(F.get("marks", i)["at"], F.size("files"))
        return let(F.struct(lo.alias("lo"), hi.alias("hi"), i.alias("i")), lambda g: F.transform(F.slice("files", g["lo"] + 1, g["hi"] - g["lo"]), lambda f, j: row(f, F.lit(0), F.col("slice") * PACK + g["lo"] + j + 1 + F.col("behind") - g["i"], F.lit(0))))

    rows = F.concat(seen, F.flatten(F.transform(F.sequence(F.lit(0), F.size("marks")), unseen)))
    out = a.select("query_ids", F.explode(rows).alias("r")).select(F.explode("query_ids").alias("query_id"), "r.filename", "r.score", "r.rank", "r.lead")
    return out.withColumn("confidence", confidence(F.col("score")))


def resolve(queries: DataFrame, c: DataFrame) -> DataFrame:
    """(query_id, status, reason, filename): one row per request.

    Page 1 decides if its best is strong and leads safely; page 2 is asked only
    else. Nothing weaker is ever chosen.
    """
    top = lambda s: F.sort_array(F.collect_list(s), False)
    g = c.groupBy("query_id").agg(top(F.col("s1")).alias("p1"), top(F.col("s2")).alias("p2"), F.max("e1").alias("e1"), F.max("e2").alias("e2"), F.max_by("filename", F.struct("s1", F.lit(1))).alias("f1"), F.max_by("filename", "s2").alias("f2"), F.count("*").alias("n"))
    safe = lambda p: (p[0] >= STRONG) & (p[0] - F.coalesce(F.get(p, F.lit(1)), F.lit(0)) >= MARGIN)
    d = queries.join(g, "query_id", "left")
    ok1, ok2 = safe(F.col("p1")) & ~F.col("e1"), safe(F.col("p2")) & ~F.col("e2")
    second = F.coalesce(F.get("p2", F.lit(1)), F.lit(0))
    tied = (second > 0) & (F.col("p2")[0] - second < MARGIN)
    bad = F.col("ticker_key").isNull() | F.col("date_key").isNull() | F.col("broker_key").isNull()
    # Statuses and reasons.
    rules = [(bad, "invalid_query", "bad_ticker_date_or_broker"), (F.col("n").isNull(), "not_found", "no_report_of_date_and_broker"), (ok1, "found", "page_1_match"), (ok2, "found", "page_2_match"), (F.col("e2"), "ambiguous", "unreadable_candidate"), (F.col("p2")[0] == 0, "not_found", "ticker_not_in_reports"), (tied, "ambiguous", "tied_candidates"), (F.lit(True), "ambiguous", "weak_evidence")]
    status, reason = F.lit(None), F.lit(None)
    for cond, s, r in reversed(rules):
        status, reason = F.when(F.coalesce(cond, F.lit(False)), s).otherwise(status), F.when(F.coalesce(cond, F.lit(False)), r).otherwise(reason)
    d = d.select("query_id", status.alias("status"), reason.alias("reason"), "f1", "f2")
    return d.select("query_id", "status", "reason", F.when(F.col("reason") == "page_1_match", F.col("f1")).when(F.col("reason") == "page_2_match", F.col("f2")).alias("filename"))


def resolve_asked(queries: DataFrame, reports: DataFrame, evidence: DataFrame) -> DataFrame:
    """resolve once for all requests that ask the same; a query_id must ask one thing only.

    The reports of a source and day without evidence stand as one: they count
    only in whether there is one and whether one can't be read.
    """
    named = lambda df: df.withColumn("ask", F.to_json(F.struct(*ASK)))
    best = evidence.groupBy(*ASK, "filename").agg(F.max(F.when(F.col("page_number") == 1, F.col("score"))).alias("s1"), F.max("score").alias("s2"))
    z = F.lit(0)
    best = named(best).select(F.col("ask").alias("query_id"), "filename", F.coalesce("s1", z).alias("s1"), "s2", F.lit(False).alias("e1"), F.lit(False).alias("e2"))
    q = named(queries)
    asks = q.select(F.col("ask").alias("query_id"), *ASK).distinct()
    rest = reports.groupBy("date_key", "broker_key").agg(F.max("e1").alias("e1"), F.max("e2").alias("e2"))
    rest = asks.where(F.col("ticker_key").isNotNull()).join(rest, ["date_key", "broker_key"]).select("query_id", F.lit(None).cast("string").alias("filename"), z.alias("s1"), z.alias("s2"), "e1", "e2")
    r = resolve(asks, best.unionByName(rest)).withColumnRenamed("query_id", "ask")
    return q.select("query_id", "ask").join(r, "ask").drop("ask")
