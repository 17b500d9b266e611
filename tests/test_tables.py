from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quireloom.operators import layout as L
from quireloom.operators import revisions as R
from quireloom.operators import tables as T

WORDS = "document_id string, page_number int, block_id string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>"


def page(spark, rows, doc="d"):
    """rows: (y, [(x, text)]); every text is split into words 30 points apart."""
    out = []
    for i, (y, cells) in enumerate(rows):
        for x, text in cells:
            for k, w in enumerate(text.split()):
                a = x + 30.0 * k
                out.append((doc, 1, f"b{i}", w, (a, float(y) + 0.4 * k, a + 24.0, y + 10.0)))
    return L.pages(spark.createDataFrame(out, WORDS))


def rows_of(df):
    return R.finalize(df.select(*R.ROW)).collect()


def test_lines(spark):
    p = page(spark, [(50, [(40, "a b"), (200, "c")]), (58, [(40, "d")])]).collect()[0]
    assert [(x.text, x.n) for x in p.lines] == [("a b c", 0), ("d", 1)]


def test_running_mean(spark):
    """Against a plain loop, as words further down may still belong to a line whose mean has moved."""
    import random

    r = random.Random(2)
    ys = sorted(round(r.uniform(0, 60), 2) for _ in range(60))
    df = spark.createDataFrame([("d", 1, "b", "w", (float(i), y, i + 0.5, y + 5)) for i, y in enumerate(ys)], WORDS)
    got = [len(x.ws) for x in L.pages(df).collect()[0].lines]
    want, cur = [], []
    for y in ys:
        if cur and abs(sum(cur) / len(cur) - y) > 2.5:
            want.append(len(cur))
            cur = []
        cur.append(y)
    assert got == [*want, len(cur)]


def test_aligned(spark):
    p = page(spark, [(20, [(40, "Estimate revisions")]), (50, [(40, "Metric"), (250, "Previous"), (350, "Current"), (450, "Consensus"), (550, "Change")]), (70, [(40, "Adjusted EPS FY2026E"), (220, "EUR 2.00"), (320, "EUR 2.20"), (420, "EUR 2.10"), (550, "+10%")])])
    r = rows_of(T.aligned_tables(p))
    assert len(r) == 1 and (r[0].metric, r[0].qualifiers, r[0].period, r[0].unit) == ("eps", ["adjusted"], "FY2026E", "EUR/share")
    assert (r[0].old_value, r[0].new_value, r[0].consensus_value, r[0].stated_pct) == (Decimal("2"), Decimal("2.2"), Decimal("2.1"), Decimal("10"))


def test_matrix(spark):
    p = page(spark, [(100, [(40, "Forecast changes")]), (120, [(250, "FY2027E"), (350, "FY2028E")]), (140, [(40, "Revenue"), (250, "+3%"), (350, "-2%")])])
    r = {x.period: x for x in rows_of(T.matrix_tables(p))}
    assert r["FY2027E"].stated_pct == 3 and r["FY2028E"].stated_pct == -2 and r["FY2027E"].old_value is None and "matrix_supplies_change_without_old_new_values" in r["FY2027E"].warnings


def test_grouped(spark):
    p = page(spark, [(50, [(250, "New"), (450, "Old"), (650, "Change")]), (70, [(200, "2026E"), (280, "2027E"), (400, "2026E"), (480, "2027E"), (600, "2026E"), (680, "2027E")]), (90, [(40, "EBIT"), (200, "110m"), (280, "120m"), (400, "100m"), (480, "125m"), (600, "10%"), (680, "-4%")])])
    r = {x.period: x for x in rows_of(T.grouped_tables(p))}
    assert (r["2026E"].old_value, r["2026E"].new_value, r["2026E"].stated_pct, r["2026E"].calc_pct) == (100, 110, 10, 10) and (r["2027E"].old_value, r["2027E"].new_value) == (125, 120)
    assert rows_of(T.aligned_tables(p)) == []


def test_consensus(spark):
    p = page(spark, [(30, [(40, "EUR"), (80, "m")]), (50, [(250, "2026E"), (350, "2027E")]), (70, [(20, "Consensus EBIT"), (250, "210.5"), (350, "225")])])
    r = {x.period: x for x in T.consensus_rows(p).collect()}
    assert r["2026E"].value == Decimal("210.5") and r["2027E"].unit == "EURm" and r["2026E"].metric == "ebit"


@pytest.mark.parametrize(("boxes", "want"), [([(0, 0, 5, 5), (8, 1, 9, 6)], [(0, 0, 9, 6)]), ([(0, 0, 5, 5), (10, 0, 12, 5)], [(0, 0, 5, 5), (10, 0, 12, 5)]), ([(0, 0, 5, 5), (6, 9, 8, 12)], [(0, 0, 5, 5), (6, 9, 8, 12)])])
def test_merge(spark, boxes, want):
    df = spark.createDataFrame([([tuple(map(float, b)) for b in boxes],)], "b array<struct<x0:double,y0:double,x1:double,y1:double>>")
    assert [tuple(x) for x in df.select(L.merge_boxes(F.col("b")).alias("m")).collect()[0].m] == want


def test_revisions_of_text_and_tables(spark, tmp_path):
    from quireloom.plans import documents_plan as D

    rows = [(100, [(40, "Estimate"), (70, "changes")]), (120, [(200, "Old"), (300, "New")]), (140, [(40, "EBIT"), (70, "FY26E"), (200, "100"), (300, "110")])]
    words = [(doc, 1, b, t, (float(x), float(y), x + 24.0, y + 10.0)) for doc, b in (("table", "t0"), ("both", "t1")) for y, cells in rows for x, t in cells]
    w = spark.createDataFrame([(i, *x, 0, i) for i, x in enumerate(words)], f"word_id long, {WORDS}, line_number int, word_number int")
    w.write.parquet(f"{tmp_path}/words.parquet")
    texts = [("table", "t0", "Estimate changes"), ("both", "t1", "Estimate changes"), ("both", "p1", "We raise our EBIT FY26E estimate from 100 to 110"), ("text", "p2", "We raise our EBIT FY26E estimate from 100 to 110"), ("open", "p3", "Estimate changes"), ("none", "p4", "Weather")]
    b = spark.createDataFrame([(d, 1, i, k, t, (0.0, 0.0, 9.0, 9.0)) for i, (d, k, t) in enumerate(texts)], "document_id string, page_number int, block_order int, block_id string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    b.withColumn("deleted_at", F.lit(None).cast("timestamp")).write.parquet(f"{tmp_path}/blocks.parquet")
    got = {r.document_id: (r.status, r.n_revisions) for r in D.revision_statuses(spark, str(tmp_path)).collect()}
    assert got == {"table": ("revisions_found", 1), "both": ("revisions_found", 1), "text": ("revisions_found", 1), "open": ("candidates_unresolved", 0), "none": ("no_revisions", 0)}
    kept = {r.document_id: r.method for r in D.document_revisions(spark, str(tmp_path)).collect()}
    assert kept == {"table": "table_old_new", "both": "table_old_new", "text": "prose_old_new", "open": None, "none": None}
