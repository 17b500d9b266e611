"""Keyword-stuffed and link-list pages (problem 9).

Spam of this kind is stitched from phrases that stand elsewhere too: the same
few keywords, names of places and words of praise in ever new order. The words
of a page that stand in lists (anchor texts, tags and slugs, lines of words
without sentence or code structure) are exploded into phrase shingles of SHINGLE
words, and the distinct hosts (repositories) of each are counted over all
documents. Order within a shingle doesn't count, nor repetition, as stuffed
pages shuffle. A phrase is replicated if it stands on HOSTS hosts or more, or
again on its page. A page's stitched share is the part of its list words that
replicated phrases cover.

That alone can't tell spam: vendored code and notices are replicated more than
spam is. So it is joined with list density, the share of list words (and links)
in all words. Dense pages are spam if they are stitched; lists of bare links and
of glued tags hold no phrases, so dense ones are spam by what links and tags
make up.

Null, empty and wordless texts are no spam; very long texts are read whole;
repeated doc_ids count once. A null source counts as a source of its own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.session import cut

SHINGLE, HOSTS = 5, 2
DENSE, STITCHED, LINKED, TAGGED, LEAST_WORDS = 0.5, 0.5, 0.3, 0.5, 16

# Words that sentences of the common languages can't do without.
FUNCTION_WORDS = frozenset(
    "the a an of to is are was be been it its this that these those and or not for on by with from as at so when if which can must may no our we you your they their has have had will every each after before"
    " into only per than then there does do der die das und ist sind ein eine einer für mit von zu auf nicht wird den dem des im el la los las de en y que es un una por no se con al lo le les du et est une dans"
    " qui il di che non per sono una gli och att som är het een van niet".split()
)
_LINK = re.compile(r"https?://\S+|www\.\S+")
_ANCHOR = re.compile(r"<a\s[^>]{0,2000}>(.*?)</a>|!?\[([^\]\n]*)\]\([^)\s]*\)", re.S | re.I)
_MARKUP = re.compile(r"<(?:html|body|head|p|div|ul|li|td|br)\b", re.I)
_TAG = re.compile(r"(?<!\S)(?:#(?!include|define|ifdef|ifndef|endif|pragma|else|undef)|tag:)[^\W_]+(?:[-_][^\W_]+)*(?=[\s,|/]|$)|(?<![^\s,|/])[^\W_]+(?:[-_][^\W_]+){2,}(?=[\s,|/]|$)|(?<![^\s,|/])[^\W\d_]{14,}(?=[\s,|/]|$)")
_WORD = re.compile(r"[^\W\d_]+")
_COMMENT = re.compile(r"^\s*(?://+|/\*+|\*+(?!\S)|#+\s|--\s|;+|<!--|[-*>•]\s)\s*|\s*(?:\*/|-->)\s*$")
_ITEM = re.compile(r'^\s*["\']([^"\':{}\[\]]+)["\'],?\s*$')
_CODE = re.compile(r"[{};=<>\\$^*`]|\w\(|\)\s*$|:\s*$|\w\.\w+\(|^\s*[\w-]+:\s|^\s*#\w|^\s*(?:def|class|import|return|func|var|let|const|if|for|while|package|end)\b|[A-Za-z0-9+/]{32,}")


@lru_cache(200_000)
def line_words(raw: str) -> tuple[float, float, float, tuple[str, ...]]:
    """What a line adds to list_words; many lines stand in many documents."""
    total = listed = tagged = 0.0
    out: list[str] = []
    item = _ITEM.match(raw)
    line = item[1] if item else _COMMENT.sub("", _COMMENT.sub("", raw))
    links = _LINK.findall(line) if "://" in line or "www." in line else []
    rest = _LINK.sub(" ", line) if links else line
    tags = _TAG.findall(rest)
    if len(tags) >= 3 or tags and "#" in rest and 2 * len(tags) >= len(rest.split()):
        out.extend(w for t in tags for w in _WORD.findall(t.lower()))
        tagged = 2.0 * len(tags)
        listed += tagged
        total += tagged
        rest = _TAG.sub(" ", rest)
    ws = _WORD.findall(rest.lower())
    near_links = len(ws) <= 4 * len(links)
    total += len(ws) + 2 * len(links)
    if near_links:
        listed += 2 * len(links)
    if ws and links and near_links:
        listed += len(ws)
        out.extend(ws)
    elif ws and (len(ws) >= 4 or item and len(ws) >= 2):
        function = sum(w in FUNCTION_WORDS for w in ws) / len(ws)
        sentence = function >= 0.2 or function >= 0.1 and rest.rstrip().endswith((".", "!", "?"))
        if not sentence and not _CODE.search(rest) and 4 * sum(map(str.isdigit, rest)) <= len(rest):
            listed += len(ws)
            out.extend(ws)
    return total, listed, tagged, tuple(out)


def list_words(text: str) -> tuple[float, float, float, list[str]]:
    """(all words, words in lists, of them in tags, the list words in order); links and tags count as two words."""
    total, listed, tagged, out = 0.0, 0.0, 0.0, []

    def anchor(m: re.Match) -> str:
        nonlocal total, listed
        ws = _WORD.findall(re.sub(r"<[^>]*>", " ", m[1] or m[2] or "").lower())
        out.extend(ws)
        total += max(2, len(ws))
        listed += max(2, len(ws))
        return " \x01 "

    body = _ANCHOR.sub(anchor, text)
    if _MARKUP.search(body):
        body = re.sub(r'<meta[^>]*?content="([^"]*)"[^>]*>', r"\n\1\n", body, flags=re.I)
        body = re.sub(r"<(script|style)\b.*?</\1>", lambda m: "\n" + m[0].replace("<", "{") + "\n", body, flags=re.S | re.I)
        body = html.unescape(re.sub(r"<[^>]*>", "\n", body))
    for raw in body.split("\n"):
        t, n, g, ws = line_words(raw)
        total, listed, tagged = total + t, listed + n, tagged + g
        out.extend(ws)
    return total, listed, tagged, out


_SCHEMA = "doc_id long, source string, n_words double, n_listed double, n_tagged double, n_linked double, shingles array<long>"


def phrases(ws: list[str]) -> list[str]:
    """The phrase of each place of a list of words, of SHINGLE words from there on; plurals and order don't count."""
    stems = [w[:-1] if len(w) > 4 and w.endswith("s") else w for w in ws]
    return [" ".join(sorted(set(stems[i : i + SHINGLE]))) for i in range(len(stems) - SHINGLE + 1)]


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    number = lru_cache(100_000)(lambda s: xxhash.xxh3_64_intdigest(s.encode()) - (1 << 63))
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            total, listed, tagged, ws = list_words(r.text)
            if listed:
                rows.append((r.doc_id, r.source, total, listed, tagged, 2.0 * len(_LINK.findall(r.text)), [number(x) for x in phrases(ws)]))
        yield pd.DataFrame(rows, columns=["doc_id", "source", "n_words", "n_listed", "n_tagged", "n_linked", "shingles"])


def _cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The share of a page's list words that replicated phrases cover."""
    for b in batches:
        out = []
        for sh, known in zip(b.shingles, b.known, strict=True):
            ids, at, n = np.unique(np.asarray(sh, np.int64), return_inverse=True, return_counts=True)
            hit = ((n >= 2) | np.isin(ids, np.asarray(known, np.int64)))[at]
            edge = np.zeros(len(hit) + SHINGLE, np.int32)
            edge[: len(hit)] += hit
            edge[SHINGLE:] -= hit
            out.append(float((np.cumsum(edge)[:-1] > 0).mean()) if len(hit) else 0.0)
        yield b[["doc_id"]].assign(stitched=out)


def evidence(docs: DataFrame) -> DataFrame:
    """Per document with words in lists: the measures, density, and stitched for the dense ones (else null)."""
    d = docs.where(F.length(F.trim("text")) > 0).select("doc_id", F.coalesce("source", F.lit("?")).alias("source"), "text")
    m = cut(d.mapInPandas(_measure, _SCHEMA).dropDuplicates(["doc_id"]).withColumn("density", F.col("n_listed") / F.col("n_words")))
    dense = m.where((F.col("density") >= DENSE) & (F.col("n_listed") >= LEAST_WORDS))
    sh = m.select("source", F.explode(F.array_distinct("shingles")).alias("shingle")).distinct()
    many = sh.groupBy("shingle").agg(F.count("source").alias("hosts")).where(F.col("hosts") >= HOSTS).select("shingle")
    known = dense.select("doc_id", F.explode(F.array_distinct("shingles")).alias("shingle")).join(many, "shingle").groupBy("doc_id").agg(F.collect_list("shingle").alias("known"))
    none = F.array().cast("array<long>")
    share = dense.select("doc_id", "shingles").join(known, "doc_id", "left").withColumn("known", F.coalesce("known", none)).mapInPandas(_cover, "doc_id long, stitched double")
    return m.drop("shingles").join(share, "doc_id", "left")


def spam_pages(docs: DataFrame) -> DataFrame:
    """evidence with spam."""
    linked, tagged = F.col("n_linked") >= LINKED * F.col("n_words"), F.col("n_tagged") >= TAGGED * F.col("n_words")
    return evidence(docs).withColumn("spam", F.col("stitched").isNotNull() & ((F.col("stitched") >= STITCHED) | linked | tagged))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """See TESTDATA.md."""
    return spam_pages(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "text")).where("spam").select("doc_id").distinct()
