import pytest
from pyspark.sql import functions as F

from quireloom.sources import reports as S
from quireloom.streaming import catalog as C

HEX = "0123456789abcdef0123456789abcdef"


def test_files(spark, tmp_path):
    (tmp_path / f"20250102_Vale_{HEX}.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "other.PDF").write_bytes(b"no signature")
    (tmp_path / "notes.txt").write_text("x")
    assert {r.filename for r in S.list_reports(spark, str(tmp_path)).collect()} == {f"20250102_Vale_{HEX}.pdf", "other.PDF"}
    assert {r.filename: r.readable for r in S.fingerprints(spark, str(tmp_path)).collect()} == {f"20250102_Vale_{HEX}.pdf": True, "other.PDF": False}
    plan = S.list_reports(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1].split("\n")[0]
    raw = spark.read.format("binaryFile").load(str(tmp_path / "*.[pP]*")).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    got = {r.filename: (r.page_number, r.text, r.error) for r in S.decode_reports(raw, lambda b: [b.decode()]).collect()}
    assert got[f"20250102_Vale_{HEX}.pdf"][1] == "%PDF-1.7 x" and got["other.PDF"][2].startswith("ValueError")


def test_index(spark, tmp_path):
    a = spark.createDataFrame([("k1", 1), ("k2", 2)], "key string, v int")
    b = S.upsert_index(a, spark.createDataFrame([("k2", 9), ("k3", 3)], "key string, v int"), "key")
    assert {tuple(r) for r in b.collect()} == {("k1", 1), ("k2", 9), ("k3", 3)}
    S.save_index(b, str(tmp_path / "i"))
    assert {tuple(r) for r in S.load_index(spark, str(tmp_path / "i"), "key string, v int").collect()} == {("k1", 1), ("k2", 9), ("k3", 3)}
    a.withColumn("schema_version", F.lit(2)).write.json(str(tmp_path / "j"))
    with pytest.raises(Exception, match="schema version"):
        S.load_index(spark, str(tmp_path / "j"), "key string, v int").collect()


def test_semantic_input(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("[1]",), ("{bad",), (None,)], "raw string")
    r = S.semantic_input(df, "raw", "a int").collect()
    assert [x.problem for x in r] == [None, "not_an_object", "malformed", "unreadable"] and r[0].value.a == 1


def test_page_lines(spark):
    b = spark.createDataFrame([("f", "d", 1, 1, "b2", "c\r\nd\n"), ("f", "d", 1, 0, "b1", "a\n\nb"), ("f", "d", 2, 0, "b3", None)], "source_filename string, document_id string, page_number int, block_order int, block_id string, text string")
    assert [(r.line_number, r.line) for r in S.page_lines(b).orderBy("line_number").collect()] == [(1, "a"), (2, ""), (3, "b"), (4, "c"), (5, "d")]


def test_stream(spark, tmp_path):
    schema = "document_id string, block_id string, source_filename string, ingested_at timestamp"
    land = str(tmp_path / "land")
    rows = [("d1", "b1", f"20250102_Vale_{HEX}.pdf", "2025-01-02 10:00:00"), ("d1", "b1", f"20250102_Vale_{HEX}.pdf", "2025-01-02 10:00:00"), ("d2", "b1", f"20250103_VALE_{HEX}.pdf", "2025-01-02 10:30:00"), ("d3", "b1", "x.pdf", "2025-01-02 12:00:00")]
    spark.createDataFrame(rows, "document_id string, block_id string, source_filename string, t string").select("document_id", "block_id", "source_filename", F.to_timestamp("t").alias("ingested_at")).write.parquet(land)
    seen = []
    for k in range(2):
        C.keep_catalog(C.landing_blocks(spark, land, schema), str(tmp_path / "cat"), str(tmp_path / f"ck{k}"), lambda c: seen.append(c.count())).awaitTermination()
    assert seen == [2, 2]
    q = C.arrivals(C.landing_blocks(spark, land, schema)).writeStream.format("memory").queryName("arr").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck9")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.source, r.n_blocks) for r in spark.sql("SELECT * FROM arr").collect()} == {("vale", 2), (None, 1)}
