"""Lines repeated across one source's documents (problem 4).

A text is put in canonical form (blanks and line ends as one space, lower case,
runs of digits as one sign) and cut into content-defined chunks over its whole
length: a rolling hash of the last WINDOW bytes ends a chunk where its low bits
are zero, whatever stands before the window; line ends play no part in it. So a
passage yields the same chunks in every document, but for the two at its ends.
Per source the distinct documents of each chunk are counted; chunks in at least
MIN_DOCS documents and SHARE_TENTHS/10 of all documents of the source are
repeated excessively, and only lines that such a chunk overlaps can be cut.

The result is asked by line. A line that holds no chunk as a whole at the usual
density of chunk ends is chunked again with denser ends, of LEVELS the first
that gives it one; a line too short for any is a chunk of its own. Hence each
repeated line has a chunk that depends on the line's content alone and is as
frequent as the line, and none is lost. As an excessive chunk may overlap other
lines too, the documents of the lines marked are counted exactly at the end.

Null texts hold no line; blank lines never count; repeated rows and repeated
lines of one document count once. A null source name forms a source of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.session import cut

MIN_DOCS, SHARE_TENTHS = 3, 3
WINDOW, LEVELS = 4, (4, 3, 2, 1)  # zero bits of the hash at a chunk's end: 16, 8, 4, 2 bytes a chunk on average
_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64


def source_key(filename: Column) -> Column:
    """The middle part of {date}_{source}_{hex}.pdf, letters and digits only, lower case."""
    name = F.regexp_extract(filename, r"(?i)^[^_]*_(.+)_[^_]*$", 1)
    return F.lower(F.regexp_replace(F.when(name != "", name).otherwise(filename), r"[^\p{L}\p{N}]", ""))


def canonical(line: str) -> str:
    return re.sub(r"[0-9]+", "0", " ".join(line.split()).lower())


@lru_cache(1)
def _gear() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([i])) for i in range(256)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class RollingHash:
    """Hashes of any slices of data, from one running sum of byte values times powers of _BASE."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        power = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b)]))
        self.back = power(np.uint64(pow(_BASE, -1, 1 << 64)))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_gear()[data] * power(np.uint64(_BASE))[:n], dtype=np.uint64)])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64))


def chunks(data: np.ndarray, texts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, chunk hash) of every chunk that overlaps a line, of many texts at once.

    texts: where each text begins in data, ascending; starts, ends: its lines in
    order. A chunk runs from one end to the next inside a text.
    """
    n, h = len(data), RollingHash(data)
    line_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    at = np.arange(WINDOW, n + 1)
    hit = h(at - WINDOW, at)
    text_of = np.repeat(np.arange(len(texts)), np.diff(np.append(texts, n)))
    whole = text_of[at - 1] == text_of[at - WINDOW]
    inside = (starts[line_of[at - 1]] <= at - WINDOW) & (at <= ends[line_of[at - 1]])
    out, done = [], np.zeros(len(starts), bool)
    for k, bits in enumerate(LEVELS):
        end = whole & ((hit & np.uint64((1 << bits) - 1)) == 0)
        own = np.bincount(line_of[at[end & inside] - 1], minlength=len(starts))
        if k == 0:  # the chunks of the texts
            mark = np.zeros(n + 1, bool)
            mark[at[end]] = mark[texts] = mark[n] = True
            p = np.flatnonzero(mark)
            first, last = line_of[p[:-1]], line_of[np.maximum(p[1:] - 1, p[:-1])]
            spans = last - first + 1
            of = np.repeat(first, spans) + (np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans))
            out.append((of, np.repeat(h(p[:-1], p[1:]), spans)))
        else:
            mine = end & inside & ~done[line_of[at - 1]] & (own >= 2)[line_of[at - 1]]
            p = at[mine]
            same = line_of[p[:-1] - 1] == line_of[p[1:] - 1]
            out.append((line_of[p[:-1][same] - 1], h(p[:-1][same], p[1:][same])))
        done |= own >= 2
    short = np.flatnonzero(~done)
    out.append((short, h(starts[short], ends[short])))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


_LINES = "block_id string, document_id string, source long, line_no int, line_hash long, chunks array<long>"


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    signed = lambda b: xxhash.xxh3_64_intdigest(b) - (1 << 63)
    for b in batches:
        rows, parts, texts, starts, ends, at = [], [], [], [], [], 0
        for r in b.itertuples(index=False):
            fresh = True
            for no, line in enumerate(r.text.split("\n"), 1):
                c = canonical(line).encode()
                if not c:
                    continue
                if fresh:
                    texts.append(at)
                else:  # a line's end is a space as any other
                    parts.append(b" ")
                    at += 1
                fresh = False
                rows.append((r.block_id, r.document_id, r.source, no, signed(c)))
                parts.append(c)
                starts.append(at)
                at += len(c)
                ends.append(at)
        if not rows:
            continue
        of, h = chunks(np.frombuffer(b"".join(parts), np.uint8), np.array(texts), np.array(starts), np.array(ends))
        order = np.lexsort((h, of))
        of, h = of[order], h[order].view(np.int64)
        keep = np.concatenate([[True], (of[1:] != of[:-1]) | (h[1:] != h[:-1])])
        of, h = of[keep], h[keep]
        out = pd.DataFrame(rows, columns=["block_id", "document_id", "source", "line_no", "line_hash"])
        out["chunks"] = np.split(h, np.searchsorted(of, np.arange(1, len(rows))))
        yield out


def with_source(blocks: DataFrame) -> DataFrame:
    """blocks with source, a 64-bit number of the source's name."""
    return blocks.withColumn("source", F.xxhash64(source_key(F.coalesce("source_filename", F.lit("?")))))


def chunked_lines(blocks: DataFrame) -> DataFrame:
    """One row per line that isn't blank: block_id, document_id, source, line_no, line_hash, chunks."""
    return blocks.where(F.col("text").isNotNull()).select("block_id", "document_id", "source", "text").mapInPandas(_lines, _LINES)


def source_sizes(blocks: DataFrame) -> DataFrame:
    """(source, n_all): distinct documents of each source."""
    return blocks.select("source", "document_id").distinct().groupBy("source").agg(F.count("document_id").alias("n_all"))


def excessive(items: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """(source, key, n_docs): keys in at least MIN_DOCS and SHARE_TENTHS/10 of the documents of their source.

    Rows of items are counted first, with map-side combining: a key with too few
    rows has too few documents. Only the rest is counted by distinct documents.
    """
    enough = lambda n: (F.col(n) >= MIN_DOCS) & (F.col(n) * 10 >= F.col("n_all") * SHARE_TENTHS)
    # Written, so that its size is known: a small one is sent to the rows instead of sorting them.
    often = cut(items.groupBy("source", key).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= MIN_DOCS).join(sizes, "source").where(enough("n_rows")))
    docs = items.join(often, ["source", key]).select("source", key, "n_all", "document_id").distinct()
    return docs.groupBy("source", key, "n_all").agg(F.count("document_id").alias("n_docs")).where(enough("n_docs")).select("source", key, "n_docs")


def repeated_lines(blocks: DataFrame) -> DataFrame:
    """(block_id, document_id, line_no): the lines to be cut."""
    blocks = with_source(blocks)
    lines, sizes = cut(chunked_lines(blocks)), cut(source_sizes(blocks))
    # The chunks in 3/10 of a source's documents are at most 10/3 of the chunks of one document, however large the source.
    bad = cut(excessive(lines.select("source", "document_id", F.explode("chunks").alias("chunk")), "chunk", sizes))
    marked = cut(lines.select("source", "line_hash", F.explode("chunks").alias("chunk")).join(bad, ["source", "chunk"], "left_semi").select("source", "line_hash").distinct())
    marked = lines.select("block_id", "document_id", "source", "line_no", "line_hash").join(marked, ["source", "line_hash"], "left_semi")
    sure = cut(excessive(marked, "line_hash", sizes))
    return marked.join(sure, ["source", "line_hash"], "left_semi").select("block_id", "document_id", "line_no").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """See TESTDATA.md."""
    return repeated_lines(spark.read.parquet(f"{d}/blocks.parquet")).select("block_id", "line_no").distinct()


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, block_id, text): each block's text without its repeated lines; null texts stay null."""
    blocks = spark.read.parquet(f"{d}/blocks.parquet")
    gone = repeated_lines(blocks).groupBy("document_id", "block_id").agg(F.collect_set("line_no").alias("gone"))
    b = blocks.select("document_id", "block_id", "text").distinct().join(gone, ["document_id", "block_id"], "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i + 1))
    return b.select("document_id", "block_id", F.array_join(kept, "\n").alias("text"))
