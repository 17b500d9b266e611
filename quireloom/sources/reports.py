"""Report sources: file listing, layout tables, page text, and a JSON index that is upserted.

PDF bytes are read only where a decoder is given; the engine's input is the
layout (words, blocks). list_reports never reads content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireloom.functions import text as X


def list_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, path, length) of the PDF files of a folder, by name only."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return f.select(X.file_name(F.col("path")).alias("filename"), "path", "length")


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, length, document_id, readable): readable means that a PDF signature is in the first 1,024 bytes."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    head = F.decode(F.expr("substring(content, 1, 1024)"), "ISO-8859-1")
    return f.select(X.file_name(F.col("path")).alias("filename"), "length", X.document_id(F.col("content")).alias("document_id"), head.contains("%PDF-").alias("readable"))


def decode_reports(files: DataFrame, decoder: Callable[[bytes], list[str]]) -> DataFrame:
    """(filename, page_number, text, error) by a given decoder of content into page texts; a failure is a row, never a failed job."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, content in zip(b["filename"], b["content"], strict=True):
                try:
                    if b"%PDF-" not in content[:1024]:
                        raise ValueError("invalid signature")
                    out += [(name, i, t or "", None) for i, t in enumerate(decoder(content), 1)]
                except Exception as e:  # noqa: BLE001
                    out.append((name, 1, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["filename", "page_number", "text", "error"])

    return files.select("filename", "content").mapInPandas(run, "filename string, page_number int, text string, error string")


def live_blocks(blocks: DataFrame) -> DataFrame:
    """The blocks of a layout table without repeated rows and without deleted ones."""
    b = blocks.where(F.col("deleted_at").isNull()) if "deleted_at" in blocks.columns else blocks
    return b.dropDuplicates(["document_id", "block_id"])


def page_lines(blocks: DataFrame, pages: int | None = None) -> DataFrame:
    """(filename, document_id, page_number, line_number, line): the blocks of a page in order, one line each; a page is one group."""
    b = blocks.where(F.col("text").isNotNull())
    if pages:
        b = b.where(F.col("page_number") <= pages)
    p = b.groupBy(F.col("source_filename").alias("filename"), "document_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("block_order", "block_id", "text"))).alias("bs"))
    lines = F.flatten(F.transform("bs", lambda x: X.split_lines(x["text"])))
    return p.select("filename", "document_id", "page_number", F.posexplode(lines).alias("i", "line")).withColumn("line_number", F.col("i") + 1).drop("i")


def upsert_index(old: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; a new row replaces the old one, of repeated new rows the first in the order of their columns stays."""
    if old is None:
        return new.dropDuplicates([key])
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    rest = [c for c in new.columns if c != key]
    w = Window.partitionBy(key).orderBy("_age", *rest)
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_age")


def save_index(df: DataFrame, path: str) -> None:
    """JSON lines with the version of their schema; a reader of another version refuses them."""
    df.withColumn("schema_version", F.lit(1)).write.mode("overwrite").json(path)


def load_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    df = spark.read.schema(f"{schema}, schema_version int").json(path)
    fine = F.when(F.col("schema_version") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("unknown schema version")).cast("boolean"))
    return df.where(fine).drop("schema_version")


def semantic_input(raw: DataFrame, column: str, schema: str) -> DataFrame:
    """Adds value and problem (null, unreadable, malformed, not_an_object) of a column of JSON texts."""
    t = F.trim(F.col(column))
    kind = F.when(F.col(column).isNull(), "unreadable").when(F.expr(f"try_parse_json(`{column}`)").isNull(), "malformed").when(~t.startswith("{"), "not_an_object")
    return raw.withColumn("problem", kind).withColumn("value", F.when(kind.isNull(), F.from_json(column, schema)))
