import random

import numpy as np
from pyspark.sql import functions as F

from quireloom.llm import boilerplate as B


def brute(rows):
    import re
    key = lambda s: re.sub(r"[\W_]", "", re.match(r"[^_]*_(.+)_[^_]*$", s)[1]).lower()
    docs, seen, lines = {}, {}, set()
    for bid, did, src, text in rows:
        docs.setdefault(key(src), set()).add(did)
        for i, x in enumerate((text or "").split("\n"), 1):
            if c := B.canonical(x):
                seen.setdefault((key(src), c), set()).add(did)
                lines.add((bid, i, key(src), c))
    return {(b, i) for b, i, s, c in lines if len(seen[s, c]) >= 3 and len(seen[s, c]) * 10 >= 3 * len(docs[s])}


def rows():
    r = random.Random(5)
    notices = [f"This notice number {i} of the {w} house may not be sold on" for i, w in enumerate(["old", "new", "grey"])] + ["ok", "page 3 of 9"]
    out = []
    for k in range(40):
        src = f"20250101_{r.choice(['Alpha Co', 'ALPHA-CO', 'beta'])}_{k:032x}.pdf"
        ls = [r.choice([x, x.upper(), "  " + x.replace(" ", "\t"), x.replace("3", "17")]) for x in notices if r.random() < 0.4] + [f"own text {chr(97 + k % 26)}{k}" * r.randint(1, 9), "", "  "]
        r.shuffle(ls)
        out.append((f"b{k}", f"d{k}", src, "\n".join(ls)))
        if k % 9 == 0:
            out.append(out[-1])
    return out + [("n", "dn", "20250101_beta_0.pdf", None), ("e", "de", "20250101_beta_1.pdf", ""), ("long", "dl", "20250101_beta_2.pdf", "word " * 50_000)]


def run(spark, tmp_path, data):
    spark.createDataFrame([(*x, "extra") for x in data], "block_id string, document_id string, source_filename string, text string, source string").write.mode("overwrite").parquet(f"{tmp_path}/blocks.parquet")
    return {tuple(x) for x in B.p4_found(spark, str(tmp_path)).collect()}


def test_against_brute_force(spark, tmp_path):
    want = brute(rows())
    assert want and run(spark, tmp_path, rows()) == want


def test_rows_come_from_chunks(spark, tmp_path, monkeypatch):
    real = B.excessive
    monkeypatch.setattr(B, "excessive", lambda items, key, sizes: real(items, key, sizes).where(F.col("chunk") % 2 == 0) if key == "chunk" else real(items, key, sizes))
    some = run(spark, tmp_path, rows())
    monkeypatch.setattr(B, "excessive", lambda items, key, sizes: real(items, key, sizes).limit(0) if key == "chunk" else real(items, key, sizes))
    assert some < brute(rows()) and run(spark, tmp_path, rows()) == set()


def chunked(*texts):
    """Per line of the texts its set of chunk hashes."""
    data, begins, starts, ends = b"", [], [], []
    for t in texts:
        begins.append(len(data))
        for i, line in enumerate(t):
            data += b" " if i else b""
            starts.append(len(data))
            data += line
            ends.append(len(data))
    of, h = B.chunks(np.frombuffer(data, np.uint8), *map(np.array, (begins, starts, ends)))
    return [set(h[of == i].tolist()) for i in range(len(starts))]


def test_a_line_has_the_same_chunks_wherever_it_stands():
    r = random.Random(2)
    word = lambda n: bytes(r.choice(b"abcdefgh ") for _ in range(n))
    for n in (1, 2, 5, 9, 17, 40, 90, 400):
        for _ in range(20):
            line = word(n)
            got = chunked([word(r.randint(1, 50)), line, word(9)], [line], [word(30), line])
            assert got[1] & got[3] & got[5], (n, line)


def test_chunks_run_over_line_ends_and_find_moved_passages():
    r = random.Random(3)
    text = bytes(r.choice(b"abcdefgh ") for _ in range(600))
    a, b = chunked([text[:300], text[301:]], [b"another start " + text[:90], text[91:200], text[201:]])[:2], chunked([b"another start " + text[:90], text[91:200], text[201:]])
    assert a[0] & a[1] and len(set().union(*b) & set().union(*chunked([text]))) > 20


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == set()
