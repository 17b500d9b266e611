import random
from collections import Counter

from quireloom.llm import packing as P


def brute(sizes, cap):
    """The same rule by trying every level."""
    fill, out = [], []
    for s in sizes:
        lv = Counter(f for f in fill if f < cap)
        best = None
        for level in [0, *sorted({f for f in fill if f + s <= cap})]:
            after = lv.copy()
            if level:
                after[level] -= 1
            if level + s < cap:
                after[level + s] += 1
            key = (sum(v * v for v in after.values()), -level)
            best = min(best, (key, level)) if best else (key, level)
        level = best[1]
        if level:
            i = max(i for i, f in enumerate(fill) if f == level)
            fill[i] += s
        else:
            i = len(fill)
            fill.append(s)
        out.append(level)
    return fill


def test_levels_against_brute_force():
    r = random.Random(3)
    for _ in range(40):
        cap = r.choice([5, 8, 13])
        sizes = [r.randint(1, cap) for _ in range(40)]
        got = Counter()
        for s, c in zip(sizes, P.pack(sizes, cap)):
            got[c] += s
        assert max(got.values()) <= cap and sorted(got.values()) == sorted(brute(sizes, cap))


def test_little_unused():
    r = random.Random(1)
    sizes = [min(2048, int(r.lognormvariate(5.5, 1)) + 1) for _ in range(5000)]
    n = len(set(P.pack(sizes)))
    assert n <= 1.06 * sum(sizes) / 2048


def test_documents(spark, tmp_path):
    docs = [(i, "word " * (i * 37 % 900)) for i in range(60)] + [(60, "word " * 5000), (61, None), (62, ""), (60, "word " * 5000)]
    spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, size int").write.parquet(f"{tmp_path}/documents.parquet")
    for group in (P.GROUP, 9):
        rows = P.packed_documents(spark, str(tmp_path), group=group).collect()
        fill, by = Counter(), {}
        for r in rows:
            by.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
            if r.container_id:
                fill[r.container_id] += r.n_tokens
        assert max(fill.values()) <= P.CAPACITY and set(by) == set(range(63))
        assert all(len(v) == 1 for k, v in by.items() if k != 60) and len(by[60]) == 3
        assert all(r.container_id is None for r in rows if not r.n_tokens) and not any(r.container_id is None for r in rows if r.n_tokens)
    assert len(fill) <= 1.35 * sum(fill.values()) / P.CAPACITY + 1


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.packed_documents(spark, str(tmp_path)).count() == 0
