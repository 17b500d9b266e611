"""Personal details inside free text (problem 6).

A linear-chain conditional random field tags the tokens of a line. Its features
are shapes, endings and words of the tokens around, shapes of the
blank-separated chunks around, pairs of neighbouring shapes, and what the line
and its neighbours look like. It is trained from the small labelled table of
pii_examples (by the exact gradient from forward-backward passes, Adam, the same
result each time), once: the weights lie beside this module. Lines are decoded
by Viterbi, many at once in numpy; a line that a worker has seen before between
like lines is looked up.

Decoded spans get an exact check of their form, which also settles their ends:
an e-mail address must be one, a phone number needs its digits, a name goes
without titles, and so on; a span that fails is dropped.

Null and empty texts give no row; texts of any length are read whole; repeated
rows count once.
"""

from __future__ import annotations

import io
import pkgutil
import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.llm.pii_examples import KINDS, labelled_table

LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
N = len(LABELS)
TOKEN = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+|\d+|[^\w\s]|_")
_CHUNK = re.compile(r"\S+")
Line = tuple[str, str, str]  # the features of the line before, the line, the features of the line after
Span = tuple[int, int, str]
TOKEN_AT, CHUNK_AT, LINE_AT, PAIR_AT = (-3, -2, -1, 0, 1, 2, 3), (-2, -1, 0, 1, 2), (-1, 0, 1), (-2, -1, 0, 1)
LONG = 4000  # tokens; longer lines are decoded one by one
RARE = 5  # occurrences that a feature of a token needs
SEEN = 60_000  # lines and pieces of lines that a worker keeps


def shape(w: str) -> str:
    if w.isdigit():
        return f"9{min(len(w), 9)}"
    if w[0].isalpha():
        n = "1" if len(w) == 1 else "2" if len(w) < 4 else "5"
        return ("X" if w.isupper() and len(w) > 1 else "Xx" if w[0].isupper() else "x") + n
    return w if w.isascii() or w in "©–|" else "?"


def token_features(w: str) -> list[str]:
    low = w.lower()
    f = [f"s={shape(w)}", f"w={low}"]
    if w[0].isalpha() and len(w) > 2:
        f += [f"e={low[-2:]}", f"e={low[-3:]}", f"e={low[-4:]}"]
    return f


def chunk_shape(c: str) -> str:
    s = re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", c)
    return "c=" + re.sub(r"(.)\1+", r"\1", re.sub(r"\d", "9", s))[:14]


@lru_cache(100_000)
def line_features(line: str) -> str:
    digits = sum(ch.isdigit() for ch in line)
    at = "@" in line or re.search(r"[\[(]at[\])]", line) is not None
    first = re.match(r"\W*(\w+)", line)
    capital = all(w[0].isupper() for w in re.findall(r"[^\W\d_]+", line)[:6]) if first else False
    return f"l={min(len(line.split()), 6)}{'@' if at else ''}{'#' if digits > 6 else '9' if digits else ''}{'C' if capital else ''}"


def lines_of(text: str) -> list[Line]:
    """The lines of a text with what those around them look like."""
    lines = text.split("\n")
    f = ["", *map(line_features, lines), ""]
    return [(f[i], x, f[i + 2]) for i, x in enumerate(lines)]


class Lookup:
    """Ids of features; unknown ones have id 0 once it is closed."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {"": 0}
        self.closed = False

    def __call__(self, f: str) -> int:
        i = self.ids.get(f)
        if i is None:
            i = 0 if self.closed else len(self.ids)
            if not self.closed:
                self.ids[f] = i
        return i


class Encoded:
    """Lines as flat id arrays: token types, chunk types, line types and shapes, with the offsets of the lines."""

    def __init__(self, lines: list[Line], m: Model) -> None:  # noqa: F821
        tok, begin, end, chunk, size, at, counts, chunks, kinds = [], [], [], [], [], [], [], [], []
        pieces = m.pieces
        for before, line, after in lines:
            n = k = 0
            for x in _CHUNK.finditer(line):
                w = x[0]
                piece = pieces.get(w)
                if piece is None:
                    found = [(m.type_id("token", t[0]), t.start(), t.end()) for t in TOKEN.finditer(w)]
                    piece = pieces[w] = (m.type_id("chunk", w), *[[f[i] for f in found] for i in range(3)])
                c, ids, b, e = piece
                chunk.append(c)
                tok += ids
                begin += b
                end += e
                size.append(len(ids))
                at.append(x.start())
                n += len(ids)
                k += 1
            counts.append(n)
            chunks.append(k)
            kinds.append((m.type_id("line", before), m.type_id("line", line_features(line)), m.type_id("line", after)))
        self.tok, self.chunk = np.array(tok, np.int32), np.array(chunk, np.int32)
        size, at = np.array(size, np.int64), np.array(at, np.int64)
        self.chunk_at = np.repeat(np.arange(len(size)), size)  # the chunk of each token
        self.line_of_chunk = np.repeat(np.arange(len(lines)), chunks)
        self.begin, self.end = np.array(begin, np.int64) + at[self.chunk_at], np.array(end, np.int64) + at[self.chunk_at]
        self.counts = np.array(counts, np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.counts)])
        self.line_of = np.repeat(np.arange(len(lines)), self.counts)
        self.line = np.array(kinds, np.int32).reshape(-1, 3)[self.line_of]
        glued = np.zeros(len(self.tok), bool)
        glued[1:] = self.chunk_at[1:] == self.chunk_at[:-1]
        self.shape = m.shape_of[self.tok] * 2 + glued

    def shifted(self, ids: np.ndarray, by: int) -> np.ndarray:
        """ids of the token by places on; 0 beyond the line."""
        out = np.zeros_like(ids)
        n = len(ids)
        if abs(by) < n:
            if by >= 0:
                out[: n - by] = np.where(self.line_of[by:] == self.line_of[: n - by], ids[by:], 0)
            else:
                out[-by:] = np.where(self.line_of[:by] == self.line_of[-by:], ids[:by], 0)
        return out

    def shifted_chunk(self, by: int) -> np.ndarray:
        """The chunk by chunks on; 0 beyond the line."""
        if not len(self.chunk):
            return self.chunk[self.chunk_at]
        to = self.chunk_at + by
        at = np.clip(to, 0, len(self.chunk) - 1)
        return np.where((to == at) & (self.line_of_chunk[at] == self.line_of), self.chunk[at], 0)


class Model:
    """Weights, and the types, pieces and lines seen so far; each is worked out once."""

    def __init__(self) -> None:
        self.feats = {k: Lookup() for k in ("token", "chunk", "line")}
        self.shapes = Lookup()
        self.forget()

    def forget(self) -> None:
        """Drops what was seen (not the features), so that memory stays bounded over many texts."""
        self.types: dict[str, dict[str, int]] = {k: {"": 0} for k in self.feats}
        self.rows: dict[str, list[list[int]]] = {k: [[]] for k in self.feats}
        self._shape: list[int] = [0]
        self.pieces: dict[str, tuple] = {}
        self.found: dict[Line, list[Span]] = {}
        self.scores: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {"feats": self.feats, "shapes": self.shapes, "w": self.w}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    @property
    def shape_of(self) -> np.ndarray:
        return np.array(self._shape, np.int32)

    def type_id(self, kind: str, x: str) -> int:
        got = self.types[kind].get(x)
        if got is None:
            got = self.types[kind][x] = len(self.types[kind])
            f = token_features(x) if kind == "token" else [chunk_shape(x) if kind == "chunk" else x]
            self.rows[kind].append([i for i in map(self.feats[kind], f) if i])
            if kind == "token":
                self._shape.append(self.shapes(shape(x)))
        return got

    def init(self) -> None:
        for f in [*self.feats.values(), self.shapes]:
            f.closed = True
        s = 2 * len(self.shapes.ids)
        self.w = {
            "token": np.zeros((len(TOKEN_AT), len(self.feats["token"].ids), N)), "chunk": np.zeros((len(CHUNK_AT), len(self.feats["chunk"].ids), N)),
            "line": np.zeros((len(LINE_AT), len(self.feats["line"].ids), N)), "pair": np.zeros((len(PAIR_AT), s * s, N)), "trans": np.zeros((N, N)), "bias": np.zeros((1, N)),
        }

    def save(self, path: str) -> None:
        words = {f"feats_{k}": np.array(list(f.ids)) for k, f in [*self.feats.items(), ("shapes", self.shapes)]}
        np.savez_compressed(path, **words, **{f"w_{k}": v.astype(np.float16) for k, v in self.w.items()})

    @classmethod
    def load(cls, file: object) -> Model:
        m, z = cls(), np.load(file)
        for k, f in [*m.feats.items(), ("shapes", m.shapes)]:
            f.ids, f.closed = {str(x): i for i, x in enumerate(z[f"feats_{k}"])}, True
        m.w = {k.removeprefix("w_"): z[k].astype(np.float32) for k in z.files if k.startswith("w_")}
        return m

    def parts(self, e: Encoded) -> list[tuple[str, int, np.ndarray]]:
        s = 2 * len(self.shapes.ids)
        shapes = {o: e.shifted(e.shape, o) for o in range(min(PAIR_AT), max(PAIR_AT) + 2)}
        return [
            *[("token", i, e.shifted(e.tok, o)) for i, o in enumerate(TOKEN_AT)], *[("chunk", i, e.shifted_chunk(o)) for i, o in enumerate(CHUNK_AT)],
            *[("line", i, e.line[:, i]) for i in range(3)], *[("pair", i, shapes[o] * s + shapes[o + 1]) for i, o in enumerate(PAIR_AT)],
        ]

    def type_scores(self, kind: str, i: int, frozen: bool) -> np.ndarray:
        """Scores of all types seen at one place; kept and extended if the weights are frozen."""
        rows = self.rows[kind]
        old = self.scores.get(f"{kind}{i}") if frozen else None
        begin = len(old) if old is not None else 0
        new = np.zeros((len(rows) - begin, N), self.w[kind].dtype)
        flat = np.array([x for r in rows[begin:] for x in r], np.int64)
        of = np.repeat(np.arange(len(rows) - begin), [len(r) for r in rows[begin:]])
        if len(flat):
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            new[of[first]] = np.add.reduceat(self.w[kind][i][flat], first, axis=0)
        out = new if old is None else np.concatenate([old, new]) if len(new) else old
        if frozen:
            self.scores[f"{kind}{i}"] = out
        return out

    def emissions(self, parts: list[tuple[str, int, np.ndarray]], frozen: bool = False) -> np.ndarray:
        e = np.repeat(self.w["bias"], len(parts[0][2]), 0)
        for kind, i, ids in parts:
            e += (self.w["pair"][i] if kind == "pair" else self.type_scores(kind, i, frozen))[ids]
        return e


def _padded(e: Encoded, flat: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values [line, place, ...], which places hold a token)."""
    n = e.counts[texts]
    place = np.arange(n.max(initial=0))
    ok = place < n[:, None]
    return flat[np.where(ok, e.start[texts][:, None] + place, 0)], ok


def train(table: list | None = None, rounds: int = 90, rate: float = 0.12, decay: float = 2e-4) -> Model:
    """Maximum likelihood with a small penalty; all lines in each round."""
    table = table if table is not None else labelled_table()
    m = Model()
    units = [lines_of(t) for t, _ in table]
    seen = Counter(f for us in units for _, line, _ in us for x in TOKEN.findall(line) for f in token_features(x))
    for f, n in seen.items():  # what stands in a few places only isn't learnt by heart
        if n >= RARE:
            m.feats["token"](f)
    m.feats["token"].closed = True
    e = Encoded([u for us in units for u in us], m)
    m.init()
    y = np.zeros(len(e.tok), np.int64)
    i = 0
    for us, (_, spans) in zip(units, table, strict=True):
        begin = 0
        for _, line, _ in us:
            at = slice(e.start[i], e.start[i + 1])
            s = e.begin[at] + begin
            for a, b, k in spans:
                inside = (s >= a) & (s < b)
                y[at][inside] = LABELS.index(f"I-{k}")
                if inside.any():
                    y[e.start[i] + np.argmax(inside)] = LABELS.index(f"B-{k}")
            begin += len(line) + 1
            i += 1
    parts = m.parts(e)
    every = np.argsort(-e.counts, kind="stable")
    every = every[e.counts[every] > 0]  # longest first: at each place the texts that have it are the first ones
    idx, ok = _padded(e, np.arange(len(e.tok)), every)
    alive = ok.sum(0)
    gold_t = np.zeros((N, N))
    same = e.line_of[1:] == e.line_of[:-1]
    np.add.at(gold_t, (y[:-1][same], y[1:][same]), 1)
    onehot = np.eye(N)[y]
    incidence = {k: (np.array([x for r in m.rows[k] for x in r], np.int64), np.repeat(np.arange(len(m.rows[k])), [len(r) for r in m.rows[k]])) for k in m.rows}
    mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.w.items()}
    for step in range(1, rounds + 1):
        em = m.emissions(parts)
        p = np.exp(em - em.max(1, keepdims=True))[idx]
        t = np.exp(m.w["trans"])
        length = idx.shape[1]
        alpha, scale = [], []
        for i in range(length):
            n = alive[i]
            a = p[:n, i] if i == 0 else (alpha[-1][:n] @ t) * p[:n, i]
            z = a.sum(1)
            alpha.append(a / z[:, None])
            scale.append(z)
        grad_t = -gold_t
        post = np.zeros((len(e.tok), N))
        beta = np.ones((alive[-1], N))
        for i in range(length - 1, -1, -1):
            n = alive[i]
            if len(beta) < n:  # texts that end here
                beta = np.concatenate([beta, np.ones((n - len(beta), N))])
            g = alpha[i] * beta
            post[idx[:n, i]] = g / g.sum(1, keepdims=True)
            if i:
                b = p[:n, i] * beta / scale[i][:, None]
                grad_t = grad_t + t * (alpha[i - 1][:n].T @ b)
                beta = b @ t.T
        d = post - onehot
        grads = {k: np.zeros_like(v) for k, v in m.w.items()}
        grads["trans"], grads["bias"] = grad_t, d.sum(0, keepdims=True)
        for kind, i, ids in parts:
            size = grads["pair"].shape[1] if kind == "pair" else len(m.rows[kind])
            per = np.stack([np.bincount(ids, d[:, c], size) for c in range(N)], 1)
            if kind == "pair":
                grads["pair"][i] = per
            else:
                f, of = incidence[kind]
                grads[kind][i] = np.stack([np.bincount(f, per[of, c], grads[kind].shape[1]) for c in range(N)], 1)
        for k, w in m.w.items():
            g = grads[k] / len(every) + decay * w
            m1, m2 = mom[k]
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            w -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    m.forget()
    m.w = {k: v.astype(np.float32) for k, v in m.w.items()}
    return m


def viterbi(em: np.ndarray, ok: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best labels [text, place] of padded emissions [text, place, label]."""
    b, length, _ = em.shape
    back = np.zeros((length, b, N), np.int8)
    s = em[:, 0].copy()
    for i in range(1, length):
        x = s[:, :, None] + trans
        best = x.argmax(1)
        new = np.take_along_axis(x, best[:, None, :], 1)[:, 0] + em[:, i]
        live = ok[:, i, None]
        back[i] = np.where(live, best, np.arange(N))
        s = np.where(live, new, s)
    out = np.zeros((b, length), np.int8)
    y = s.argmax(1)
    for i in range(length - 1, -1, -1):
        out[:, i] = y
        y = back[i, np.arange(b), y]
    return out


def decode(lines: list[Line], m: Model) -> list[list[Span]]:
    """(start, end, kind) of the decoded spans of each line."""
    e = Encoded(lines, m)
    out: list[list[Span]] = [[] for _ in lines]
    if not len(e.tok):
        return out
    em = m.emissions(m.parts(e), frozen=True)
    order = np.argsort(e.counts, kind="stable")
    order = order[e.counts[order] > 0]
    labels = np.zeros(len(e.tok), np.int8)
    at = 0
    while at < len(order):
        n = 1 if e.counts[order[at]] > LONG else 512
        group = order[at : at + n]
        group = group[e.counts[group] <= max(LONG, e.counts[group[0]])]
        idx, ok = _padded(e, np.arange(len(e.tok)), group)
        labels[idx[ok]] = viterbi(em[idx], ok, m.w["trans"])[ok]
        at += len(group)
    hit, prev = np.flatnonzero(labels), None
    for i in hit.tolist():
        kind, begins, t = KINDS[(labels[i] - 1) // 2], labels[i] % 2 == 1, int(e.line_of[i])
        if not begins and prev == (t, i - 1, kind):
            a, _, k = out[t][-1]
            out[t][-1] = (a, int(e.end[i]), k)
        else:
            out[t].append((int(e.begin[i]), int(e.end[i]), kind))
        prev = (t, i, kind)
    return out


_WORDS = r"[^\W\d_]"
FORMS = {
    "email": re.compile(r"[A-Za-z0-9][\w.+\-]*(?:[ \t]*@[ \t]*|[ \t]*[\[(][ \t]*(?:at|AT)[ \t]*[\])][ \t]*)[A-Za-z0-9\-]+(?:(?:\.|[ \t]*[\[(][ \t]*(?:dot|DOT)[ \t]*[\])][ \t]*)[A-Za-z0-9\-]*[A-Za-z0-9])+"),
    "phone": re.compile(r"(?<![\w.])(?:\+|\()?\d(?:[ \t().\-/]{0,2}\d){6,15}(?!\w)"),
    "id_number": re.compile(r"(?<!\w)(?:[A-Z]{1,2}[ \t-]?)?\d(?:[ \t/-]?\d){4,13}(?:[ \t]?[A-Z])?(?!\w)"),
    "address": re.compile(rf"(?<!\w)(?:\d+(?:-\d+)?[A-Za-z]?[ \t]+(?:{_WORDS}[\w'’-]*\.?[ \t]*){{1,4}}|(?:{_WORDS}[\w'’-]*\.?[ \t]+){{0,3}}{_WORDS}[\w'’-]*,?[ \t]+\d+(?:-\d+)?[a-zA-Z]?(?!\w))"),
    "name": re.compile(rf"(?:{_WORDS}[\w\u0300-\u036f'’-]*\.?)(?:,?[ \t]+{_WORDS}[\w\u0300-\u036f'’-]*\.?){{1,4}}"),
}
_TITLE = re.compile(r"^(?:(?:Mr|Mrs|Ms|Dr|Prof|Miss|Sir)\.?[ \t]+)+|(?:,?[ \t]+(?:CFA|PhD|MBA|FRM|CPA))+$", re.I)
# Short forms of street words whose full stop belongs to them.
_DOTTED = re.compile(r"(?:St|Rd|Ave|Str|Sq|Ln|Blvd|Pl)\.$")


def settle(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The exact ends of a decoded span, or None if the span hasn't the form of its kind."""
    form = FORMS[kind]
    begin = text.rfind("\n", 0, a) + 1
    end = text.find("\n", b)
    end = len(text) if end < 0 else end
    if kind in ("email", "phone", "id_number"):
        best = None
        for x in form.finditer(text, begin, end):
            over = min(b, x.end()) - max(a, x.start())
            if over > 0 and (best is None or over > best[0]):
                best = (over, x.start(), x.end())
        if best is None:
            return None
        _, s, t = best
        if kind == "phone" and text[s] == "(" and text.count("(", s, t) != text.count(")", s, t):
            s += 1
        if kind == "phone" and (not 7 <= sum(c.isdigit() for c in text[s:t]) <= 15 or re.fullmatch(r"\d+\.\d+", text[s:t])):
            return None
        return s, t
    s = text[a:b]
    lead = len(s) - len(s.lstrip(" \t\r,.;:|-("))
    a, s = a + lead, s[lead:]
    if kind == "name":
        if cut := _TITLE.match(s):
            a, s = a + cut.end(), s[cut.end() :]
        if cut := _TITLE.search(s):
            s = s[: cut.start()]
        s = s.rstrip(" \t\r,;:|-()")
        if s.endswith(".") and not re.search(r"(?:^|[\s.])[^\W\d_]\.$", s):
            s = s[:-1]
        return (a, a + len(s)) if form.fullmatch(s) else None
    s = s.rstrip(" \t\r,;:|-()")
    s = s.rstrip(".")
    after = a + len(s)
    # The stop of a short form is part of it, unless it is the only one at the line's end: then it ends the sentence.
    if text[after : after + 1] == "." and after + 1 < end and text[after + 1] not in "\r\n" and _DOTTED.search(s + "."):
        s += "."
    return (a, a + len(s)) if any(c.isdigit() for c in s) and form.fullmatch(s) else None


WEIGHTS = "pii_weights.npz"


@lru_cache(1)
def model() -> Model:
    """The tagger with the weights that `python -m quireloom.llm.pii` wrote."""
    return Model.load(io.BytesIO(pkgutil.get_data("quireloom.llm", WEIGHTS)))


def details(texts: list[str], m: Model) -> list[list[Span]]:
    """The settled spans of each text, none inside another. A line seen before isn't tagged again."""
    if max(len(m.pieces), len(m.found)) > SEEN:
        m.forget()
    units = [lines_of(t) for t in texts]
    new = list(dict.fromkeys(u for us in units for u in us if u not in m.found))
    for u, spans in zip(new, decode(new, m), strict=True):
        got: list[Span] = []
        for a, b, k in spans:
            s = settle(u[1], a, b, k)
            if s and not any(s[0] < y and x < s[1] for x, y, _ in got):
                got.append((*s, k))
        m.found[u] = sorted(got)
    out = []
    for us in units:
        begin, spans = 0, []
        for u in us:
            spans += [(begin + a, begin + b, k) for a, b, k in m.found[u]]
            begin += len(u[1]) + 1
        out.append(spans)
    return out


def find_details(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, kind, found_text) of each detail; start and end are code point offsets."""
    m = model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                texts = part[text].tolist()
                rows = [(k, s, e, kind, t[s:e]) for k, t, found in zip(part[key], texts, details(texts, m), strict=True) for s, e, kind in found]
                yield pd.DataFrame(rows, columns=["key", "start", "end", "kind", "found_text"])

    return df.where(F.length(text) > 0).select(key, text).mapInPandas(run, "key string, start int, end int, kind string, found_text string")


def _letters(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """See TESTDATA.md. A name that is the house which the block's file is of is no person's. Repeated rows are dropped from the result, so no text is shuffled."""
    blocks = spark.read.parquet(f"{d}/blocks.parquet").select("block_id", "source_filename", "text")
    house = _letters(F.regexp_extract("source_filename", r"^[^_]*_(.+)_[^_]*$", 1))
    blocks = blocks.select(F.concat(F.lit("blocks "), "block_id", F.lit(" "), F.coalesce(house, F.lit(""))).alias("key"), "text")
    a = spark.read.parquet(f"{d}/analysts.parquet").select(F.col("analyst_row_id").cast("string").alias("key"), F.explode(F.array("name", "email", "phone")).alias("text"))
    both = blocks.unionByName(a.select(F.concat(F.lit("analysts "), "key", F.lit(" ")).alias("key"), "text"))
    found = find_details(both.where(F.col("text").isNotNull() & F.col("key").isNotNull()), "key", "text")
    table, rest, house = F.substring_index("key", " ", 1), F.expr("substring(key, length(substring_index(key, ' ', 1)) + 2)"), F.substring_index("key", " ", -1)
    found = found.select(table.alias("record_table"), rest.alias("rest"), house.alias("house"), F.col("kind").alias("pii_kind"), "found_text")
    person = (F.col("pii_kind") == "name") & (_letters(F.col("found_text")) == F.col("house"))
    found = found.where(((F.col("record_table") == "blocks") & ~person) | F.col("pii_kind").isin("email", "phone"))
    return found.select("record_table", F.expr("left(rest, length(rest) - length(house) - 1)").alias("record_key"), "pii_kind", "found_text").distinct()


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """(block_id, text): each block's text with a placeholder such as [EMAIL] for each detail."""
    blocks = spark.read.parquet(f"{d}/blocks.parquet").select("block_id", "text").where(F.col("text").isNotNull()).distinct()
    m = model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, found in zip(b["text"], details(b["text"].tolist(), m), strict=True):
                for s, e, kind in reversed(found):
                    t = f"{t[:s]}[{kind.upper()}]{t[e:]}"
                out.append(t)
            yield b.assign(text=out)

    return blocks.mapInPandas(run, "block_id string, text string")


if __name__ == "__main__":  # python -m quireloom.llm.pii: trains from the labelled table and writes the weights
    train().save(sys.argv[1] if len(sys.argv) > 1 else __file__.rsplit("/", 1)[0] + "/" + WEIGHTS)
