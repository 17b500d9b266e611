"""Retrieval, passages, grounding, citations, contacts and layouts on small fixtures."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quireloom.functions import text as X
from quireloom.operators import citations as C
from quireloom.operators import contacts as K
from quireloom.operators import grounding as G
from quireloom.operators import passages as P
from quireloom.operators import retrieval as R
from quireloom.operators import summary as S

HEX = ["%032x" % i for i in range(9)]


def one(spark, col):
    return spark.range(1).select(col.alias("x")).collect()[0].x


@pytest.mark.parametrize(("value", "want"), [("abc gy", "ABC GR"), ("ABC", None), ("ABC LN Equity", None), ("ABC 12", None), ("ＡＢＣ ＬＮ", "ABC LN"), ("", None), (None, None)])
def test_ticker(spark, value, want):
    assert one(spark, X.normalize_ticker(F.lit(value).cast("string"))) == want


@pytest.mark.parametrize(("value", "want"), [("20260102", "20260102"), ("2026-01-02", "20260102"), ("2026/01/02", None), ("20261340", None), ("2 Jan 2026", "20260102"), ("2 January 2026", "20260102"), ("", None)])
def test_date(spark, value, want):
    assert one(spark, X.english_date(F.lit(value))) == want


@pytest.mark.parametrize(("spec", "n", "want"), [("1-3,5", 6, [1, 2, 3, 5]), ("2", 2, [2]), ("0-2", 2, None), ("3", 2, None), ("2-1", 2, None), ("1,,2", 2, None), (None, 2, [1, 2])])
def test_page_range(spark, spec, n, want):
    assert one(spark, X.page_range(F.lit(spec).cast("string"), F.lit(n))) == want


def resolve(spark, files, queries, errors=()):
    """files: name -> pages of text."""
    names = {f: f"20260102_{b}_{HEX[i]}.pdf" for i, (f, (b, _)) in enumerate(files.items())}
    cat = R.catalog_of(spark.createDataFrame([(x,) for x in names.values()] + [("no report.txt",)], "filename string"))
    lines = [(names[f], p, n, t) for f, (_, pages) in files.items() for p, text in enumerate(pages, 1) for n, t in enumerate(text.split("\n"), 1)]
    q = R.normalized_queries(spark.createDataFrame(queries, "query_id long, ticker string, query_date string, broker string"))
    short = R.shortlist(q, cat)
    ev = R.ticker_evidence(short, R.labelled_lines(spark.createDataFrame(lines, "filename string, page_number int, line_number int, line string")))
    err = spark.createDataFrame([(names[f], p) for f, p in errors], "filename string, page_number int")
    return {r.query_id: (r.status, r.reason) for r in R.resolve(q, R.candidates(short, ev, err)).collect()}, {(r.query_id, r.kind) for r in ev.collect()}


def test_retrieval(spark):
    files = {"a": ("Vale", ["Company\nBloomberg: ABC LN\nCommentary"]), "b": ("Vale", ["x\n" * 50 + "Peer ABC LN performed well"]), "c": ("Orb", ["Company\nSOIFP|SOIT.PA"]), "d": ("Mill", ["MARGIN improved"]), "e": ("Tarn", ["x\n" * 29 + "According to Bloomberg data, peer ABC LN moved"]),
             "f": ("Dual", ["Ticker DEF GY"]), "g": ("Dual", ["Ticker: DEF GR"]), "h": ("Late", ["nothing here", "Bloomberg: XYZ FP"]), "i": ("Bad", ["Bloomberg: ABC LN"])}
    q = [(1, "ABC LN", "20260102", "V.A.L.E"), (2, "SOI FP", "2026-01-02", "Orb"), (3, "MAR IN", "20260102", "Mill"), (4, "ABC LN", "20260102", "Tarn"), (5, "DEF GY", "20260102", "Dual"), (6, "XYZ FP", "2 Jan 2026", "Late"), (7, "ABC LN", "20260103", "Vale"), (8, "ABC", "20260102", "Vale"), (9, "ABC LN", "20260102", "Bad"), (10, None, None, None), (1, "ABC LN", "20260102", "V.A.L.E")]
    got, kinds = resolve(spark, files, q, [("i", 1)])
    assert got == {1: ("found", "page_1_match"), 2: ("found", "page_1_match"), 3: ("not_found", "ticker_not_in_reports"), 4: ("ambiguous", "weak_evidence"), 5: ("ambiguous", "tied_candidates"), 6: ("found", "page_2_match"), 7: ("not_found", "no_report_of_date_and_broker"), 8: ("invalid_query", "bad_ticker_date_or_broker"),
                   9: ("ambiguous", "unreadable_candidate"), 10: ("invalid_query", "bad_ticker_date_or_broker")}
    assert (1, "explicit_bloomberg_field") in kinds and (2, "header_or_title") in kinds and (4, "possible_header") in kinds and (1, "first_page_body") in kinds


BLOCKS = "document_id string, page_number int, block_order int, block_id string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>"


def blocks(spark, *rows):
    return spark.createDataFrame([("d", p, i, f"b{i}", t, (0.0, float(i), 1.0, i + 1.0)) for i, (p, t) in enumerate(rows)], BLOCKS)


def test_passages(spark):
    b = blocks(spark, (1, "Title of it"), (1, "We raised EBIT due to prices, see page 2"), (1, "x" * 80), (2, "Results review of the quarter"), (2, "after the results we note"), (2, None), (2, "  "), (3, "far away"))
    rev = spark.createDataFrame([("d", "ebit", ["b1", "b1", "zz"])], "document_id string, metric string, block_ids array<string>")
    s = {r.block_id: (r.score, r.reasons) for r in P.scores(b, rev).collect()}
    assert s["b1"][0] == 12 + 100 + 2 * 18 + 90 + 20 + 20 and s["b1"][1][:2] == ["opening_context", "revision_evidence"]
    assert s["b3"][0] == 18 + 1000 + 20 + 35 and s["b4"][0] == 18 + 120 + 20 + 35 and s["b0"][0] == 12 + 45 and "b7" not in s
    got = [(r.block_id, len(r.text)) for r in P.select_passages(b, P.scores(b, rev), 3, 100).orderBy("rank").collect()]
    assert got == [("b3", 29), ("b1", 40), ("b4", 25)]
    cut = P.select_passages(b, P.scores(b, rev), 3, 10).collect()
    assert [(r.text, r.reasons[-1]) for r in cut] == [("Results re", "truncated_for_model_input")]


def test_candidates_are_evidence(spark, tmp_path):
    from quireloom.operators import revisions as R
    from quireloom.plans import documents_plan as D

    texts = [(1, "Title of it"), (1, "Notes"), (2, "one"), (2, "two"), (2, "Estimate changes"), (2, "three"), (3, "four"), (3, "ebit line"), (3, "old and new values"), (5, "ebit line"), (5, "five"), (5, "six")]
    b = blocks(spark, *texts).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    b = b.unionByName(b.withColumn("document_id", F.lit("no revisions")))
    b.write.parquet(f"{tmp_path}/blocks.parquet")
    spark.createDataFrame([("r", "d", "ebit", [(["b11", "zz"],)])], "revision_id string, document_id string, metric string, evidence array<struct<block_ids:array<string>>>").write.parquet(f"{tmp_path}/revisions.parquet")
    want = {}
    for doc in ("d", "no revisions"):
        cand = {r.block_id for r in R.candidate_blocks(b.where(F.col("document_id") == doc)).collect()}
        assert cand == {"b4", "b8"}
        ids = {int(x[1:]) for x in cand | ({"b11"} if doc == "d" else set())}
        for i, (page, t) in enumerate(texts):
            near = sum(texts[k][0] == page for k in ids if 0 < abs(k - i) <= 2)
            metric = doc == "d" and "ebit" in t and any(abs(texts[k][0] - page) <= 1 for k in ids)
            n = 12 * (page == 1) + 100 * (i in ids) + 45 * near + 20 * metric
            if n:
                want[doc, f"b{i}"] = n
    assert {(r.document_id, r.block_id): r.score for r in D.passage_score(spark, str(tmp_path)).collect()} == want
    assert {(r.document_id, r.block_id) for r in D.passage_budget(spark, str(tmp_path)).collect()} == set(want)


@pytest.mark.parametrize(("claim", "evidence", "want"), [
    ("Revenue raised 10%", "We raised revenue by 10%", True), ("Revenue raised 12%", "We raised revenue by 10%", False), ("Costs cut", "We raised costs", False), ("entirely different words here", "We raised costs", False), ("", "x", False), (None, "x", False), ("1,5 margin", "margin of 1.5", True),
])
def test_supported(spark, claim, evidence, want):
    assert one(spark, G.supported(F.lit(claim).cast("string"), F.lit(evidence))) is want


def test_causes(spark):
    link = lambda e, s: one(spark, G.causal_link(F.lit("Higher prices lift revenue"), F.lit(e), F.lit(s)))
    assert link("Revenue rose due to prices we lift.", "explicit") == "explicit" and link("Revenue rose due to prices we lift.", "inferred") == "inferred" and link("Other. Prices may support revenue, lift it.", "explicit") == "inferred" and link("Revenue rose.", "explicit") is None
    assert one(spark, G.role_supported(F.lit("Chief Financial Officer"), F.lit("the financial head"))) and not one(spark, G.role_supported(F.lit("Chief Officer"), F.lit("someone")))


def test_claims(spark):
    c = spark.createDataFrame([(1, "d", "Title of it", ["b0", "b0", "zz"]), (2, "d", "Title", None), (3, "d", "other thing", ["b0"]), (4, "x", "Title of it", ["b0"]), (5, "d", None, ["b0"])], "id long, document_id string, text string, evidence_block_ids array<string>")
    got = {r.id: (r.valid, r.problems) for r in G.validate_claims(c, ["id"], blocks(spark, (1, "Title of it")), "text").collect()}
    assert got == {1: (True, ["invented_or_unselected_block_id_removed"]), 2: (False, ["unsupported_claim_removed"]), 3: (False, ["unsupported_claim_removed"]), 4: (False, ["invented_or_unselected_block_id_removed", "unsupported_claim_removed"]), 5: (False, ["malformed_grounded_claim_removed"])}


def test_citations(spark):
    b = blocks(spark, (1, "a"), (1, "b"), (2, "c"))
    q = spark.createDataFrame([(1, "d", ["b0", "b1", "b0"], "L", "k1"), (2, "d", ["b1", "b0"], "L", "k2"), (3, "d", ["b0", "b1"], "other", "k3"), (4, "d", ["b0", "zz"], "L", None), (5, "d", ["b0", "b2"], "L", "k5"), (6, "d", None, "L", None), (7, "d", ["b0"], " ", None)], "request_id long, document_id string, evidence_block_ids array<string>, label string, claim_key string")
    r = C.resolve_requests(q, b)
    why = {x.request_id: x.reason for x in r.select("request_id", "reason").distinct().collect()}
    assert why == {1: None, 2: None, 3: None, 4: "unknown_evidence_block", 5: None, 6: "invalid_request_metadata", 7: "invalid_request_metadata"}
    built = {(x.request_id, x.page_number): x for x in C.build(r).collect()}
    assert built[1, 1].citation_id == built[3, 1].citation_id != built[2, 1].citation_id and built[5, 1].split and not built[1, 1].split and built[1, 1].block_ids == ["b0", "b1"]
    assert len(C.distinct_citations(C.build(r)).collect()) == 4 and {x.claim_key for x in C.bindings(C.build(r)).collect()} == {"k1", "k2", "k3", "k5"}
    moved = b.withColumn("bbox", F.when(F.col("block_id") == "b2", F.struct(*[F.lit(9.0).alias(k) for k in ("x0", "y0", "x1", "y1")])).otherwise(F.col("bbox"))).where("block_id <> 'b1'")
    assert sorted(x.status for x in C.stale(C.build(r), moved).collect()) == ["changed", "missing_block", "missing_block", "valid"]


def test_citations_of_other_highlights_differ(spark):
    import hashlib
    import json

    b = blocks(spark, (1, "a"), (1, "b"))
    rows = [(1, "d", ["b0", "b1"], "L", "k1", "ebit", "FY2026E"), (2, "d", ["b0", "b1"], "L", "k2", "ebit", None), (3, "d", ["b0", "b1"], "M", "k3", "ebit", "FY2026E"), (4, "d", ["b0", "b1"], "L", "k4", None, None)]
    q = spark.createDataFrame(rows, "request_id long, document_id string, evidence_block_ids array<string>, label string, claim_key string, highlight_metric string, highlight_period string")
    built = C.build(C.resolve_requests(q, b))
    want = lambda m, p: "cit-" + hashlib.sha256(json.dumps({"schema": 1, "document_id": "d", "page_number": 1, "evidence_block_ids": ["b0", "b1"], "highlight_metric": m, "highlight_period": p}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:24]
    assert {(r.claim_key, r.citation_id) for r in C.bindings(built).collect()} == {(r[4], want(r[5], r[6])) for r in rows}
    assert sorted(r.request_id for r in C.distinct_citations(built).collect()) == [1, 2, 4] and {r.status for r in C.stale(built, b).collect()} == {"valid"}


def test_highlights(spark):
    w = [("d", 1, "b0", ln, k, t, (10.0 * k, 10.0 * ln, 10.0 * k + 8, 10.0 * ln + 8)) for ln, line in enumerate(["EBIT rose much", "Sales FY2026E 5", "end"]) for k, t in enumerate(line.split())]
    words = spark.createDataFrame(w, "document_id string, page_number int, block_id string, line_number int, word_number int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    q = spark.createDataFrame([(1, "d", "b0", "ebit", None), (2, "d", "b0", None, "FY2026E"), (3, "d", "b0", None, None), (4, "d", "b0", "eps", None), (5, "d", "zz", "eps", None)], "request_id long, document_id string, block_id string, metric string, period string")
    got = {r.request_id: ([tuple(b) for b in r.boxes], r.fallback) for r in C.highlight_boxes(q, words).collect()}
    assert got[1] == ([(0.0, 0.0, 28.0, 8.0)], False) and got[2] == ([(0.0, 10.0, 28.0, 18.0)], False) and len(got[3][0]) == 3 and not got[3][1] and got[4][1] and 5 not in got


def test_contacts_and_titles(spark):
    b = blocks(spark, (1, "A benign credit cycle for all of us"), (1, "Published 5 January 2026"), (1, "Anna Vorelli\nDirector, Foods\n+44 20 7946 0123\na.vorelli@quarn.example\nBruno Karst\nb.karst@quarn.example"), (1, None))
    got = {r.name: (r.email, r.phone) for r in K.contacts(b).collect()}
    assert got == {"Anna Vorelli": ("a.vorelli@quarn.example", "+44 20 7946 0123"), "Bruno Karst": ("b.karst@quarn.example", None)}
    pages = spark.createDataFrame([("d", 1, 1000.0)], "document_id string, page_number int, height double")
    assert [(r.document_id, r.published) for r in K.publication_dates(b, pages).collect()] == [("d", "2026-01-05")] and K.titles(b.where("block_id < 'b2'"), pages).collect()[0].title.startswith("A benign")
    two = blocks(spark, (1, "5 January 2026 or 2026-01-06"))
    assert K.publication_dates(two, pages).collect() == []


def test_bars(spark):
    r = spark.createDataFrame([(1, Decimal("50"), Decimal("-100"), None, "EURm"), (2, Decimal("1"), Decimal("1"), None, "EURm"), (3, Decimal("1"), Decimal("2"), None, None)], "revision_id long, old_value decimal(20,6), new_value decimal(20,6), consensus_value decimal(20,6), unit string")
    got = {(x.revision_id, x.label): x.line for x in S.bars(r).collect()}
    assert got == {(1, "Old"): "Old        " + " " * 10 + "│█████       50", (1, "New"): "New        ██████████│" + " " * 10 + "  -100"}


@pytest.mark.parametrize(("v", "want"), [("1234.5", "1,234"), ("12.50", "12.5"), ("1.255", "1.25"), ("0.5", "0.5"), ("0", "0"), ("0.00123", "0.0012"), ("100", "100"), ("20", "20")])
def test_number_text(spark, v, want):
    assert one(spark, S.number_text(F.lit(Decimal(v)))) in (want, want.replace("1.25", "1.26"))


def test_jargon_people_items(spark):
    j = lambda t, d, e: one(spark, G.jargon_supported(F.lit(t), F.lit(d), F.lit(e)))
    assert j("EPS", "earnings per share", "our EPS rose") and not j("EPS", "earnings", "our EPS rose") and not j("EPS", "earnings per share", "none")
    assert j("NPS", "net promoter score", "NPS means the net promoter score") and not j("NPS", "net promoter score", "NPS rose")
    p = lambda n, e: one(spark, G.person_supported(F.lit(n), F.lit(e)))
    assert p("Jane Roe", "We met with management, including Jane Roe.") and not p("Jane Roe", "Jane Roe wrote.") and not p("", "We met with management")
    df = spark.createDataFrame([(["ebit_margin", "eps", "eps", "sales"], "The EBIT margin and EPS", ["ebit_margin", "eps"])], "i array<string>, e string, a array<string>")
    assert df.select(G.supported_items(F.col("i"), F.col("e"), F.col("a")).alias("x")).collect()[0].x == ["ebit_margin", "eps"]
