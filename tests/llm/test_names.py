import pytest
from pyspark.sql import functions as F

from quireloom.llm import names as N


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_against_brute_force():
    import random

    r = random.Random(1)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(0, 9)))
    a, b = [word() for _ in range(300)], [word() for _ in range(300)]
    assert list(N.lcs_length(a, b)) == [lcs(x, y) for x, y in zip(a, b)]


@pytest.mark.parametrize(("cell", "want"), [
    ("Dr Jean-Luc Sarevöbe, CFA", ("jeanluc", "sarevobe", "", False)), ("SARE Anna", ("anna", "sare", "", False)), ("Sare, A. B.", ("a", "sare", "", True)),
    ("A Sare", ("a", "sare", "", True)), ("Sare A. - +44 20 1", ("a", "sare", "", True)), ("ML Sare", ("m", "sare", "", True)), ("Anna Sare (x@y.example)", ("anna", "sare", "", False)),
])
def test_people(cell, want):
    assert N.parse_person(cell) == want


def test_links(spark, tmp_path):
    people = [(1, "Anna Vorelli", "a.vorelli@x.example"), (2, "VORELLI Anna", None), (3, "Anna Vorellli", "a.vorelli@x.example"), (4, "A. Vorelli", None), (5, "Bruno Vorelli", "b.vorelli@x.example"),
              (6, None, None), (7, "", None), (8, "---", None), (1, "Anna Vorelli", "a.vorelli@x.example"), (9, "Anna Vorelki", "a.vorelki@x.example")]
    houses = [(1, "Quillen Marsh Securities"), (2, "QM Sec."), (3, "Marsh Quillen Securities plc"), (4, "QuillenMarshSecurities"), (5, "Quillen Mrash"), (6, "Dorrit Bank"), (7, None)]
    spark.createDataFrame([(i, n, e, "x") for i, n, e in people], "analyst_row_id long, name string, email string, form string").write.parquet(f"{tmp_path}/analysts.parquet")
    spark.createDataFrame(houses, "query_id long, broker string").write.parquet(f"{tmp_path}/queries.parquet")
    got = {tuple(r) for r in N.p3_found(spark, str(tmp_path)).collect()}
    a = ["A. Vorelli", "Anna Vorelli", "Anna Vorellli", "VORELLI Anna"]
    b = sorted(h for _, h in houses[:5])
    assert got == {(k, x, y) for k, s in (("analyst", a), ("broker", b)) for x in s for y in s if x < y}


def test_common_suffixes_keep_one_letter_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "COMMON", 1)
    rows = [(f"f{i}", "analyst", "anna", w, "", False) for i, w in enumerate(["vorelli", "vorellli", "vorekli", "morelli", "dunbar"])]
    k = N.block_keys(spark.createDataFrame(rows, "form string, kind string, given string, family string, type string, short boolean"))
    a, b = k.toDF("a", "key"), k.toDF("b", "key")
    got = {(r.a, r.b) for r in a.join(b, "key").where("a < b").collect()}
    assert {("f0", "f1"), ("f0", "f2"), ("f0", "f3")} <= got and not any("f4" in x for x in got)


FORMS = "form string, kind string, given string, family string, type string, short boolean, n long, emails array<string>"


def forms_of(people, houses):
    x = [("analyst", N.parse_person(c), e) for c, e in people] + [("broker", N.parse_house(c), []) for c in houses]
    return [(f"{k}{i}", k, *p, 1 + i % 3, e) for i, (k, p, e) in enumerate(x)]


def missed(spark, rows):
    """Pairs that _relate links, of all pairs, and those of them that are never compared."""
    f = spark.createDataFrame(rows, FORMS)
    side = lambda x: f.select(*[F.col(c).alias(c if c == "kind" and x == "a" else f"{c}_{x}") for c in f.columns])
    links = side("a").join(side("b"), F.col("kind") == F.col("kind_b")).where("form_a < form_b").drop("kind_b").mapInPandas(N._relate, N._REL)
    want, got = ({tuple(sorted((r.child, r.parent))) for r in x.collect()} for x in (links, N.related(f)))
    return want, want - got


def test_beyond_common_all_links_are_compared(spark, monkeypatch):
    monkeypatch.setattr(N, "COMMON", 1)
    people = [(c, []) for c in ("Bob Vorelli", "Robert Vorelli", "Bill Vorelli", "William Vorellli", "Tony Vorelli", "Anthony Vorelki", "Peggy Vorelli", "Margaret Vorelli", "Nargaret Vorelli", "Argaret Vorelli", "Ola Vorelli", "Aleksandra Vorelli", "R. Vorelli", "Vorelli", "Vorellli", "M Vorrelli")]
    people += [("Anna Vorelli", ["v@x"]), ("Vorelli", ["v@x"]), ("Zoe Vorelli", ["v@x"]), ("Vorelki", ["v@x"]), ("A. Vorelli", ["a@x"])]
    houses = ["Quillen Marsh Securities", "Quillen Marsh", "Quillen Mrash Bank", "Quillen", "Quilln Bank", "Quil. Bank", "QM", "MQ Sec", "Marsh Capital Markets", "Marsh Bank", "Quillen Marsh Bank"]
    want, lost = missed(spark, forms_of(people, houses))
    assert len(want) > 50 and not lost, (len(want), len(lost), sorted(lost))


def test_short_names_are_compared_in_small_blocks(spark):
    spelt = lambda w: {w, *(w[:i] + w[i + 1:] for i in range(len(w))), *(w[:i] + "y" + w[i + 1:] for i in range(len(w))), *(w[:i] + w[i + 1] + w[i] + w[i + 2:] for i in range(len(w) - 1)), w[1:] + w[0]}
    families = sorted(set().union(*map(spelt, ("smith", "martin", "kohl", "vorelli"))))
    want, lost = missed(spark, forms_of([(f"Anna {w.title()}", []) for w in families], ["ABC", "Corvin Brindle Aldous", *[f"{w.title()} Bank" for w in families]]))
    assert len(want) > 400 and not lost, (len(want), len(lost), sorted(lost)[:9])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "analyst_row_id long, name string, email string").write.parquet(f"{tmp_path}/analysts.parquet")
    spark.createDataFrame([], "query_id long, broker string").write.parquet(f"{tmp_path}/queries.parquet")
    assert N.p3_found(spark, str(tmp_path)).count() == 0
