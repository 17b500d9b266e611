import pytest
from pyspark.sql import functions as F

from quireloom.operators import checks as H
from quireloom.operators import citations as C
from quireloom.operators import contacts as K

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_exact_keys(spark):
    full = "{" + ",".join(f'"{k}": null' for k in H.SEMANTIC_KEYS) + "}"
    rows = [(1, full), (2, full.replace('"drivers"', '"driver"')), (3, "[]"), (4, None), (5, "{"), (6, full[:-1] + ',"x":1}')]
    got = {r.i: r.ok for r in spark.createDataFrame(rows, "i int, t string").select("i", H.exact_keys(F.col("t")).alias("ok")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def folded(texts):
    """The rule told in the plain way: the state of a scope is the union of the directions of its accepted rows."""
    state, seen, out = {}, set(), []
    for scope, t in texts:
        p = {k for k, ws in (("p", ("raised",)), ("n", ("cut",))) if any(w in t.split() for w in ws)}
        if (scope, t) in seen:
            out.append("duplicate")
            continue
        before = state.setdefault(scope, set())
        if p and before and not p & before:
            out.append("contradiction")
            continue
        seen.add((scope, t))
        before |= p
        out.append(None)
    return out


def test_siblings_against_the_fold(spark):
    import random

    r = random.Random(4)
    texts = [(r.choice("abc"), " ".join(r.choice(["raised", "cut", "x"]) for _ in range(r.randint(1, 2)))) for _ in range(60)]
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(texts)], "i int, s string, t string")
    got = {x.i: x.sibling for x in H.sibling_problems(df, [], ["i"], [F.col("s"), F.col("t")], [F.col("s")], F.col("t")).collect()}
    assert got == dict(enumerate(folded(texts)))


@pytest.mark.parametrize(("path", "want"), [("a/b.pdf", True), ("b.PDF", True), ("../b.pdf", False), ("/b.pdf", False), ("a//b.pdf", False), ("a/./b.pdf", False), ("a\\b.pdf", False), ("b.txt", False), ("", False), (None, False)])
def test_safe_source(spark, path, want):
    assert spark.range(1).select(H.safe_source(F.lit(path).cast("string")).alias("x")).collect()[0].x is want


@pytest.mark.parametrize(("box", "want"), [((0.0, 0.0, 5.0, 5.0), (0, 0, 5, 5)), ((-0.4, 0.0, 10.4, 5.0), (0, 0, 10, 5)), ((-0.6, 0.0, 5.0, 5.0), None), ((5.0, 0.0, 5.0, 5.0), None), ((float("nan"), 0.0, 5.0, 5.0), None), ((0.0, 0.0, float("inf"), 5.0), None), (None, None)])
def test_boxes(spark, box, want):
    r = spark.createDataFrame([(box,)], f"b {BOX}").select(H.box_check(F.col("b"), F.lit(10.0), F.lit(20.0)).alias("c")).collect()[0].c
    assert (r.code, tuple(r.box) if r.box else None) == (None if want else "invalid_bounding_box", want)


def front(spark, *texts, y=10.0):
    blocks = spark.createDataFrame([("d", 1, f"b{i}", i, t, (0.0, y, 9.0, y + 12)) for i, t in enumerate(texts)], f"document_id string, page_number int, block_id string, block_order int, text string, bbox {BOX}")
    return blocks, spark.createDataFrame([("d", 1, 100.0)], "document_id string, page_number int, height double")


@pytest.mark.parametrize(("text", "want"), [("Date: 5 January 2026", "2026-01-05"), ("published 05 jan 2026", "2026-01-05"), ("2026-01-05", "2026-01-05"), ("5/1/2026", "2026-01-05"), ("5.1.2026", "2026-01-05"), ("5-1-2026", "2026-01-05"), ("on 5 January 2026", None), ("5 Foo 2026", None), ("31/2/2026", None)])
def test_dates(spark, text, want):
    got = K.publication_dates(*front(spark, text, None, "")).collect()
    assert [r.published for r in got] == ([want] if want else [])


def test_two_dates_are_none_and_low_ones_do_not_count(spark):
    assert [r.published for r in K.publication_dates(*front(spark, "2026-01-05", "2026-01-06")).collect()] == [None]
    assert K.publication_dates(*front(spark, "2026-01-05", y=26.0)).count() == 0


def test_title_joins_lines_and_leaves_out_fields(spark):
    got = K.titles(*front(spark, "Bloomberg: ABC LN", "A better year\nfor the whole trade: more to come", "Buy", None)).collect()
    assert [(r.title, r.block_id) for r in got] == [("A better year for the whole trade: more to come", "b1")]
    assert K.titles(*front(spark, "A better year for all of them", y=49.0)).count() == 0


def test_lookup(spark):
    c = spark.createDataFrame([("cit-" + "0" * 24,)], "citation_id string")
    assert C.lookup(c, "cit-" + "0" * 24).count() == 1 and C.lookup(c, "cit-" + "1" * 24).count() == 0
    with pytest.raises(ValueError):
        C.lookup(c, "cit-x")


def test_drivers(spark):
    blocks = spark.createDataFrame([("d", "b1", "Revenue rose in FY2026E due to higher prices for paper."), ("d", "b2", "We cut the target price because bond yields climbed."), ("d", "b3", None)], "document_id string, block_id string, text string")
    revisions = spark.createDataFrame([("d", "revenue", "FY2026E"), ("d", "target_price", None)], "document_id string, metric string, fiscal_period string")
    row = lambda i, t, link, cat, ids, ms=("revenue",), ps=("FY2026E",): ("d", i, i, t, link, cat, list(ms), list(ps), ids)
    rows = [
        row(1, "Higher prices for paper lift revenue", "explicit", "pricing", ["b1"]), row(2, "Revenue rose due to higher prices for paper", "explicit", "pricing", ["b1"]), row(3, "revenue  rose due to higher prices for paper", "explicit", "other", ["b1"]),
        row(4, "Bond yields climbed", "explicit", "valuation only", ["b2"], ["target_price"], []), row(5, "Higher prices for paper", "explicit", "valuation only", ["b1"]), row(6, "Dragons ate the harvest", "explicit", "no such", ["b1"]), row(7, "Higher prices for paper", "inferred", "no such", ["b1", "zz"]),
        row(8, "x", "explicit", None, None, [], []), row(9, None, "explicit", None, ["b3"]),
    ]
    schema = "document_id string, driver_id int, ordinal int, driver string, causal_link string, category string, impacted_metrics array<string>, fiscal_periods array<string>, evidence_block_ids array<string>"
    got = {r.driver_id: (r.problem, r.link, r.category, r.confidence) for r in H.validated_drivers(spark.createDataFrame(rows, schema), revisions, blocks).collect()}
    gone = "unsupported_driver_removed"
    assert got[2] == (None, "explicit", "pricing", "high") and got[3][0] == "duplicate_driver_removed" and got[4][0] is None and got[5][0] == "valuation_only_driver_not_linked_to_target_price"
    assert {got[i][0] for i in (1, 6, 8, 9)} == {gone} and got[7] == (None, "inferred", None, "medium"), got
