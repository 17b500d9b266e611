import random

from quireloom.llm import spam as S

KEY = "cheap lamp deal lamp best lamp cheap price lamp " * 12
SPAM = {
    1: KEY, 2: "# Welcome\n\nOur timer is read once by the page.\n\n" + KEY, 3: "".join(f"- [cheap lamp deal {w}](https://x{i}.example/a)\n" for i, w in enumerate("abcdefghij")),
    4: "\n".join(f"https://x{i}.example/lamp/{i}" for i in range(20)), 5: " ".join(f"#cheap-lamp-deal{c} #bestlampprice{c}" for c in "abcdefgh"), 6: "/* " + KEY[:200] + "*/\n/* " + KEY[:200] + "*/\nint x = 1;\n",
    7: "<html><head><meta name=\"keywords\" content=\"cheap lamp deal, lamp best lamp\"></head><body>" + "".join(f'<a href="https://x{i}.example">cheap lamp deal</a> | ' for i in range(12)) + "</body></html>",
}
FINE = {
    11: "def load(x):\n    return x + 1\n" * 20, 12: "id,when,amount\n" + "".join(f"{i},2025-01-0{i % 9 + 1},lamp\n" for i in range(40)),
    13: "# Links\n\n" + "".join(f"- [guide {i}](https://x{i}.example) explains how the parser is built and why it is needed.\n" for i in range(12)),
    14: "<html><body><a href='/a'>Home</a> <a href='/b'>News</a><p>" + "The index is read once and the order of the rows is kept. " * 12 + "</p></body></html>",
    15: "Permission is granted to any person to use the work, and the notice must be kept in all copies of it. " * 5, 16: "", 17: None, 18: "  \n ", 19: "1 2 3 4 5",
    20: "#include <lamp.h>\n#include <deal.h>\n#define LAMP 1\n", 21: '{\n  "name": "lamp",\n  "version": "1.0.0",\n  "keywords": ["lamp", "deal"],\n  "scripts": {"build": "make"}\n}\n',
}


def test_pages(spark, tmp_path):
    rows = [(i, t, f"s{i % 4}", "x") for i, t in {**SPAM, **FINE}.items()]
    spark.createDataFrame(rows + rows[:2] + [(30, "word " * 200_000, None, "x")], "doc_id long, text string, source string, shingles string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in S.p9_found(spark, str(tmp_path)).collect()} == set(SPAM) | {30}


def test_hosts_are_counted_once(spark):
    words = [f"{a}{c}" for c in "bcdfghjk" for a in ("lamo", "rite", "pask")]
    docs = spark.createDataFrame([(i, " ".join(words[i:] + words[:i]), f"s{i % 2}") for i in range(6)] + [(9, " ".join(w[::-1] for w in words), "s9"), (10, " ".join(w[::-1] for w in words), "s9")], "doc_id long, text string, source string")
    e = {r.doc_id: r.stitched for r in S.evidence(docs).collect()}
    assert all(e[i] > 0.9 for i in range(6)) and e[9] == e[10] == 0, e


def test_stitched_share_against_brute_force(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice("lamp deal best cheap offer price kettle blue".split() + [f"own{chr(97 + i)}", f"rare{chr(97 + i)}"]) for _ in range(r.randint(16, 50))), f"s{i % 5}") for i in range(20)]
    hosts, want = {}, {}
    ph = {i: S.phrases(t.split()) for i, t, _ in docs}
    for i, _, s in docs:
        for x in ph[i]:
            hosts.setdefault(x, set()).add(s)
    for i, t, _ in docs:
        cover = {j + k for j, x in enumerate(ph[i]) if len(hosts[x]) >= S.HOSTS or ph[i].count(x) >= 2 for k in range(S.SHINGLE)}
        want[i] = len(cover) / len(t.split())
    got = {r.doc_id: r.stitched for r in S.evidence(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_rows_hang_on_phrases(spark, tmp_path, monkeypatch):
    rows = [(i, t, f"s{i % 4}") for i, t in {**SPAM, **FINE}.items()]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(S, "STITCHED", 1.1)  # as if no phrase were replicated
    assert {r.doc_id for r in S.p9_found(spark, str(tmp_path)).collect()} == {3, 4, 5, 7}  # lists of links and tags


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert S.p9_found(spark, str(tmp_path)).count() == 0
