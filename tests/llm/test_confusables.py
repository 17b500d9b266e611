import pytest

from quireloom.llm import confusables as C


@pytest.mark.parametrize(("text", "want"), [
    ("ａｂｃ\u3000１", "abc 1"), ("e\u0301te\u0301", "été"), ("ﬁnal", "final"), ("a\u200bb\u00adc", "abc"), ("(рынок).", "(рынок)."), ("(αγορά).", "(αγορά)."), ("½ ‰ … ™", "½ ‰ … ™"), ("Kelvin", "Kelvin"),
    ("fixed\u202fcosts", "fixed costs"), ("", ""), ("利益", "利益"), ("Ærø", "Ærø"), ("рынок оf", "рынок оf"),
])
def test_form(text, want):
    assert C.plain(text) == (want, None)


@pytest.mark.parametrize(("text", "want"), [
    ("оf", [("оf", "of", "of")]), ("іѕ", [("іѕ", "is", None)]), ("nаі\u0308vе,", [("nаїvе,", "naïve,", "naïve")]), ("inνest", [("inνest", "invest", "invest")]), ("νννst αb", None),
    ("НКZV DС", [("НКZV", "HKZV", "hkzv"), (" ", " ", None), ("DС", "DC", "dc")]), ("Т νe", [("Т", "Т", None), (" ", " ", None), ("νe", "νe", None)]),
])
def test_tokens(text, want):
    got = C.plain(text)[1]
    assert (got and [x for x in got]) == (want if want is None or any(a != b for a, b, _ in want) else None)


def test_mixed_tokens_need_the_corpus(spark):
    odd = spark.createDataFrame([(1, "inνest", "x"), (2, "qqνqq", "x"), (3, "αγ", "x"), (4, "оf", "x"), (5, "оff,", "x"), (6, "іѕ", "x"), (7, "оf оff", "x")], "id long, text string, word string")
    words = spark.createDataFrame([("Invest, (of)\nрынок",), (None,), ("",)], "text string")
    got = {r.text: r.plain for r in C.repaired(odd, words).collect()}
    assert got == {"inνest": "invest", "qqνqq": "qqνqq", "αγ": "αγ", "оf": "of", "оff,": "оff,", "іѕ": "is", "оf оff": "of оff"}


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "a\xa0b"), (1, "a\xa0b"), (2, None), (3, ""), (4, "plain"), (5, "ｘ" * 100_000)], "word_id long, text string").write.parquet(f"{tmp_path}/words.parquet")
    spark.createDataFrame([(1, "АВ LN")], "query_id long, ticker string").write.parquet(f"{tmp_path}/queries.parquet")
    spark.createDataFrame([(None,)], "text string").write.parquet(f"{tmp_path}/blocks.parquet")
    got = {(r.record_table, r.record_id): r.plain_text for r in C.p5_found(spark, str(tmp_path)).collect()}
    assert got == {("words", 1): "a b", ("words", 5): "x" * 100_000, ("queries", 1): "AB LN"}


def test_empty(spark, tmp_path):
    for t, schema in {"words": "word_id long, text string", "queries": "query_id long, ticker string", "blocks": "text string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    assert C.p5_found(spark, str(tmp_path)).count() == 0
