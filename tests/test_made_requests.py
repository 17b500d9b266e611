"""Many requests for many reports of one source and day: SQL's rows, without joining each request with each report."""

import datetime

import pytest

import __spark_entry__ as E
from quireloom.operators import retrieval as R
from tests.harness import compare

REPORTS = 96


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """A directory with blocks of 96 reports of one source, 3 of another and one of no form."""
    rows, at = [], datetime.datetime(2026, 1, 1)
    for i in range(REPORTS + 4):
        source = "Vale" if i < REPORTS else "Ørb & Co"
        name = f"2026{i % 12 + 1:02d}{i % 28 + 1:02d}_{source}_{i:031x}{'0123456789abcdef'[i % 16]}.pdf" if i < REPORTS + 3 else "no report.txt"
        ticker = f"{chr(65 + i % 7)}{chr(65 + i % 5)}X LN"
        pages = [(1, 0, f"Company\nBloomberg: {ticker}\n{ticker.replace(' ', '')}|Q"), (1, 1, f"as of today, {ticker} rose" if i % 3 else None), (2, 2, None if i % 5 == 0 else f"Ticker: {ticker} of it"), (3, 3, "further")]
        rows += [(f"d{i}", name, p, f"d{i}-b{n}", n, t, at, at if i == 40 and n == 1 else None) for p, n, t in pages for _ in range(1 + (i % 9 == 0))]
    d = str(tmp_path_factory.mktemp("crowd"))
    spark.createDataFrame(rows, "document_id string, source_filename string, page_number int, block_id string, block_order int, text string, ingested_at timestamp, deleted_at timestamp").coalesce(2).write.parquet(f"{d}/blocks.parquet")
    return d


def joined(df) -> int:
    """The most rows that a join of df's plan puts out."""
    df.collect()
    most, open_ = 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        p = open_.pop()
        kind = p.getClass().getSimpleName()
        if "Join" in kind:
            most = max(most, p.metrics().apply("numOutputRows").value())
        inner = p.executedPlan() if kind == "AdaptiveSparkPlanExec" else p.plan() if kind.endswith("QueryStageExec") else None
        open_ += [inner] if inner is not None else [p.children().apply(i) for i in range(p.children().size())]
    return most


@pytest.mark.parametrize("name", ["made_evidence", "made_rank_margin", "made_status"])
def test_crowd(spark, crowd, monkeypatch, name):
    monkeypatch.setattr(R, "PACK", 5, raising=False)
    got, want, extra, missing = compare(spark, E.queries()[name], E.oracle_sql()[name], crowd)
    assert got and not extra and not missing, (got, want, extra, missing)
    assert joined(E.queries()[name](spark, crowd)) < REPORTS * REPORTS / 4
