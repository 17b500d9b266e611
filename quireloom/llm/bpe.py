"""Encoding with a public byte-level BPE vocabulary (problem 7).

Pre-tokenisation without regex, over whole batches of texts at once: every code
point is mapped to a class, and the splitter is a finite automaton whose
transition functions are composed by an associative scan (first within lanes of
STRIDE characters, all lanes together, then over the lanes), which gives the
state at every character and with it the boundaries. The slices, with their
byte offsets, are looked up in a cache of merged pieces; what isn't there is
merged once by rank. Ids and byte offsets decode to the text exactly.

Null and empty texts have the empty list; strings of special tokens are
ordinary text; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_50k.tiktoken"
STRIDE = 64
CACHE = 400_000  # pieces kept a worker; a full cache starts anew
BATCH_CHARS = 1_000_000

# Classes of characters. An apostrophe is told apart by what follows it.
SPACE, BLANK, LETTER, DIGIT, OTHER, APOS1, APOS2, END = range(8)
# States: what the piece that the last character belongs to can still take.
S_NONE, S_SPACE, S_BLANK, S_LETTER, S_DIGIT, S_OTHER, S_TWO, S_ONE = range(8)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import os

    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of every code point: L*, N*, white space, the rest."""
    t = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            t[i] = LETTER
        elif c == "N":
            t[i] = DIGIT
    # Code points with the property White_Space; all but the space end a piece of letters.
    for i in [9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        t[i] = BLANK
    t[32] = SPACE
    return t


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a piece) by state and class.

    A run of white space gives its last character to a piece of its own, which
    takes letters, digits or others only if it is a space; where it starts is
    marked in a second step, see boundaries.
    """
    nxt, cut = np.zeros((8, 8), np.uint8), np.zeros((8, 8), bool)
    plain = {SPACE: S_SPACE, BLANK: S_BLANK, LETTER: S_LETTER, DIGIT: S_DIGIT, OTHER: S_OTHER, APOS1: S_ONE, APOS2: S_TWO, END: S_NONE}
    inside = {S_LETTER: {LETTER}, S_DIGIT: {DIGIT}, S_OTHER: {OTHER, APOS1, APOS2}, S_SPACE: {SPACE, BLANK, LETTER, DIGIT, OTHER, APOS1, APOS2}, S_BLANK: {SPACE, BLANK}}
    for s in range(8):
        for c in range(8):
            nxt[s, c], cut[s, c] = plain[c], True
            if s == S_TWO and c == LETTER:
                nxt[s, c], cut[s, c] = S_ONE, False
            elif s == S_ONE and c == LETTER:
                nxt[s, c], cut[s, c] = S_NONE, False
            elif c in inside.get(s, ()):
                cut[s, c] = False
                if c in (APOS1, APOS2):
                    nxt[s, c] = S_OTHER
    return nxt, cut


def states_before(cls: np.ndarray) -> np.ndarray:
    """The state before each character, by a scan over composed transition functions."""
    nxt, _ = automaton()
    n = len(cls)
    lanes = -(-n // STRIDE)
    c = np.full(lanes * STRIDE, END, np.uint8)
    c[:n] = cls
    c = c.reshape(lanes, STRIDE).T  # one column a lane
    total = np.tile(np.arange(8, dtype=np.uint8)[:, None], (1, lanes))
    for row in c:  # the function of each whole lane
        total = nxt[total, row]
    step = 1
    while step < lanes:  # inclusive scan over lanes: compose with the function step lanes before
        earlier, later = total[:, :-step], total[:, step:]
        total = np.concatenate([total[:, :step], np.take_along_axis(later, earlier.astype(np.intp), 0)], 1)
        step *= 2
    state = np.full(lanes, S_NONE, np.uint8)
    state[1:] = total[S_NONE, :-1]
    out = np.empty((STRIDE, lanes), np.uint8)
    for i, row in enumerate(c):
        out[i] = state
        state = nxt[state, row]
    return out.T.reshape(-1)[:n]


def boundaries(cp: np.ndarray) -> np.ndarray:
    """Whether each code point starts a piece. Texts are separated by the code point 0x110000 (see pieces)."""
    table = class_table()
    sep = cp == 0x110000
    cls = table[np.where(sep, 0, cp)]
    cls[sep] = END
    apos = np.flatnonzero(cp == 39)
    if len(apos):
        after = np.concatenate([cp, [0x110000, 0x110000]])
        a, b = after[apos + 1], after[apos + 2]
        # The endings that an apostrophe splits off.
        one = np.isin(a, [ord(x) for x in "sdmt"])
        two = ((a == ord("l")) & (b == ord("l"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("r")) & (b == ord("e")))
        cls[apos] = np.where(one, APOS1, np.where(two, APOS2, OTHER))
    before = states_before(cls)
    _, cut = automaton()
    start = cut[before, cls]
    # White space before something else: the last one starts a piece, and unless it is a space, what follows does too.
    ws = (cls == SPACE) | (cls == BLANK)
    last = ws.copy()
    last[:-1] &= ~ws[1:] & (cls[1:] != END)
    last[-1:] = False
    start |= last
    after_blank = np.flatnonzero(last & (cls == BLANK)) + 1
    start[after_blank] = True
    return start | sep


def merge(piece: bytes, rank: dict[bytes, int]) -> tuple[int, ...]:
    """Byte pairs merged by rank, lowest first; a heap keeps long pieces near n log n."""
    if (r := rank.get(piece)) is not None:
        return (r,)
    import heapq

    n = len(piece)
    end, nxt, prev, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != e:
            continue
        end[i], alive[j], nxt[i] = e, False, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
            if (r := rank.get(piece[i : end[nxt[j]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[j]]))
        if prev[i] >= 0 and (r := rank.get(piece[prev[i] : e])) is not None:
            heapq.heappush(heap, (r, prev[i], e))
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i : end[i]]])
        i = nxt[i]
    return tuple(out)


class Encoder:
    """Encodes batches of texts; keeps merged pieces between batches."""

    def __init__(self, path: str) -> None:
        self.rank, self.cache = ranks(path), {}

    def pieces(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(all bytes, byte offsets of the pieces with the end, first piece of each text with the end)."""
        whole = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        raw = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        seps = ends + np.arange(len(texts))
        cp = np.insert(raw, ends, 0x110000)  # a mark after each text
        keep = np.ones(len(cp), bool)
        keep[seps] = False
        start = boundaries(cp)
        start[np.concatenate([[0], seps[:-1] + 1])] = True
        start = start[keep]
        width = 1 + (raw >= 0x80).astype(np.int64) + (raw >= 0x800) + (raw >= 0x10000)
        offset = np.concatenate([[0], np.cumsum(width)])
        at = np.flatnonzero(start)
        first = np.searchsorted(at, np.concatenate([[0], ends]), "left")
        return whole.encode("utf-8", "surrogatepass"), np.concatenate([offset[at], offset[-1:]]), first

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        data, at, first = self.pieces(texts)
        cache, rank = self.cache, self.rank
        if len(cache) > CACHE:
            cache.clear()
        out: list[int] = []
        counts = np.empty(len(at), np.int64)
        bounds = at.tolist()
        a = bounds[0] if bounds else 0
        ids, n_at = out, counts
        for i, b in enumerate(bounds[1:]):
            p = data[a:b]
            got = cache.get(p)
            if got is None:
                got = merge(p, rank)
                if b - a <= 64:
                    cache[p] = got
            ids += got
            n_at[i] = len(got)
            a = b
        total = np.concatenate([[0], np.cumsum(counts[: len(at) - 1])])
        cuts = total[np.minimum(first, len(at) - 1)]
        arr = np.array(out, np.int32)
        return [arr[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def offsets(self, text: str) -> list[tuple[int, int, tuple[int, ...]]]:
        """(first byte, end, ids) of each piece of one text."""
        data, at, _ = self.pieces([text])
        b = at.tolist()
        return [(x, y, merge(data[x:y], self.rank)) for x, y in zip(b[:-1], b[1:], strict=True)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(2)
def _pieces_by_id(path: str) -> dict[int, bytes]:
    return {i: b for b, i in ranks(path).items()}


def decode(ids: list[int], path: str | None = None) -> str:
    by = _pieces_by_id(path or vocabulary_path())
    return b"".join(by[i] for i in ids).decode("utf-8", "surrogatepass")


def in_batches(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[list[str]]:
    now, n = [], 0
    for t in texts:
        if now and n + len(t) > limit:
            yield now
            now, n = [], 0
        now.append(t)
        n += len(t)
    if now:
        yield now


def encode_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, lengths_only: bool = False) -> DataFrame:
    """(doc_id, ids) of each row, or (doc_id, n_tokens). No shuffle; a worker holds one batch of rows."""
    kind = T.IntegerType() if lengths_only else T.ArrayType(T.IntegerType())
    name = "n_tokens" if lengths_only else "ids"
    schema = T.StructType([docs.schema[id_col], T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path(vocabulary))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                got = [x for group in in_batches(texts) for x in enc.encode(group)]
                if lengths_only:
                    col = pa.array([len(x) for x in got], pa.int32())
                else:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
                    col = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got) if got else np.empty(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), col], names=[id_col, name])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """See TESTDATA.md."""
    return encode_table(spark.read.parquet(f"{d}/documents.parquet"))
