import itertools

import numpy as np
import pytest

from quireloom.llm import pii as P
from quireloom.llm.pii_examples import labelled_table


@pytest.fixture(scope="module")
def model():
    return P.model()


def scored(model, **kw):
    """Per kind (right, found, wanted) on held-out templates."""
    n = {k: [0, 0, 0] for k in P.KINDS}
    table = labelled_table(1500, seed=99, held=True, **kw)
    for (t, gold), got in zip(table, P.details([t for t, _ in table], model)):
        g, x = {(a, b, k) for a, b, k in gold}, {(a, b, k) for a, b, k in got}
        for k in n:
            want, have = {y for y in g if y[2] == k}, {y for y in x if y[2] == k}
            n[k] = [n[k][0] + sum(any(a < d and c < b for c, d, _ in want) for a, b, _ in have), n[k][1] + len(have), n[k][2] + len(want)]
    return n


def test_held_out_templates(model):
    n = scored(model)
    assert all(r / found > 0.9 and r / want > 0.9 for r, found, want in n.values()), n


def test_names_that_no_list_has(model):
    n = scored(model, new_names=True)
    assert all(r / found > 0.9 and r / want > (0.7 if k == "name" else 0.9) for k, (r, found, want) in n.items()), n


@pytest.mark.parametrize(("text", "want"), [
    ("Ayumi Tanaka presented the plan to the board.", {("name", "Ayumi Tanaka")}), ("We thank Grzegorz Brzeczyszczykiewicz for the data.", {("name", "Grzegorz Brzeczyszczykiewicz")}),
    ("Nguyen Van An called from 221B Baker Street.", {("name", "Nguyen Van An"), ("address", "221B Baker Street")}), ("He moved to 17 Rue de la Paix, Paris last week.", {("address", "17 Rue de la Paix")}),
])
def test_sentences_of_no_template(model, text, want):
    assert {(k, text[a:b]) for a, b, k in P.details([text], model)[0]} == want


def test_weights_are_those_of_training():
    """A short training gives a tagger of the same make; the shipped file has its features."""
    m = P.train(labelled_table(300), rounds=15)
    assert {k: v.ndim for k, v in m.w.items()} == {k: v.ndim for k, v in P.model().w.items()}
    assert set(m.feats["chunk"].ids) & set(P.model().feats["chunk"].ids)


def test_same_lines_are_tagged_once(model):
    text = "Contact Anna Vorelli on +44 20 7946 0123"
    model.forget()
    a = P.details([text, text + "\n", "x\n" + text], model)
    assert [len(x) for x in a] == [2, 2, 2] and len(model.found) == 5, model.found


def test_viterbi_against_brute_force():
    r = np.random.default_rng(1)
    em, trans = r.normal(size=(3, 4, P.N)), r.normal(size=(P.N, P.N))
    ok = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], bool)
    got = P.viterbi(em, ok, trans)
    for i in range(3):
        n = ok[i].sum()
        best = max(itertools.product(range(P.N), repeat=int(n)), key=lambda y: sum(em[i, j, y[j]] for j in range(n)) + sum(trans[y[j - 1], y[j]] for j in range(1, n)))
        assert tuple(got[i, :n]) == best


@pytest.mark.parametrize(("text", "part", "kind", "want"), [
    ("Contact Dr Ann Bell, CFA on", "Dr Ann Bell, CFA", "name", "Ann Bell"), ("at 1-3 Oak St. in May", "1-3 Oak St", "address", "1-3 Oak St."), ("at 12B Oak Rd.", "12B Oak Rd.", "address", "12B Oak Rd"),
    ("a.b [at] c [dot] example;", "a.b [at] c", "email", "a.b [at] c [dot] example"), ("call (212) 555-0101.", "212) 555-0101", "phone", "(212) 555-0101"), ("no number", "number", "phone", None), ("x 12 y", "12", "phone", None),
])
def test_exact_ends(text, part, kind, want):
    a = text.index(part)
    s = P.settle(text, a, a + len(part), kind)
    assert (s and text[s[0] : s[1]]) == want


def test_edges(spark, model, monkeypatch):
    monkeypatch.setattr(P, "model", lambda: model)
    rows = [("1", "Contact Ms Anna Vorelli on +44 20 7946 0123", 1), ("2", None, 1), ("3", "", 1), ("4", " \n ", 1), ("5", "Volume growth confirms the plan.\n" * 3000 + "Model requests: a.vorelli@quarn.example", 1)]
    got = {(r.key, r.kind, r.found_text) for r in P.find_details(spark.createDataFrame(rows, "key string, text string, kind int"), "key", "text").collect()}
    assert {("1", "name", "Anna Vorelli"), ("1", "phone", "+44 20 7946 0123"), ("5", "email", "a.vorelli@quarn.example")} == got


def test_queries(spark, model, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "model", lambda: model)
    b = [("b1", "Questions on this report: research@quarn.example", "20250101_Quarn_00.pdf"), ("b1", "Questions on this report: research@quarn.example", "20250101_Quarn_00.pdf"), ("b2", None, None), ("b 3", "With Anna Vorelli", None), ("b4", "With Anna Vorelli", "20250101_Anna-Vorelli_00.pdf")]
    spark.createDataFrame(b, "block_id string, text string, source_filename string").write.parquet(f"{tmp_path}/blocks.parquet")
    spark.createDataFrame([(7, "Anna Vorelli", "a.vorelli (at) quarn.example", "Tel. +44 20 7946 0123"), (8, None, None, None)], "analyst_row_id long, name string, email string, phone string").write.parquet(f"{tmp_path}/analysts.parquet")
    got = {tuple(r) for r in P.p6_found(spark, str(tmp_path)).collect()}
    assert got == {("blocks", "b1", "email", "research@quarn.example"), ("blocks", "b 3", "name", "Anna Vorelli"), ("analysts", "7", "email", "a.vorelli (at) quarn.example"), ("analysts", "7", "phone", "+44 20 7946 0123")}
    clean = {r.block_id: r.text for r in P.p6_clean(spark, str(tmp_path)).collect()}
    assert clean == {"b1": "Questions on this report: [EMAIL]", "b 3": "With [NAME]", "b4": "With [NAME]"}
