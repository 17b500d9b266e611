"""Text normalisation and identities as Columns. Null in, null out; bad forms give null."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireloom.functions.columns import let

ALIASES = {"GY": "GR"}  # fixed value: exchange suffixes that mean the same place


@F.pandas_udf(T.StringType())
def nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def split_lines(text: Column) -> Column:
    """Lines of a text; an end of line at the very end opens no further line."""
    t = F.regexp_replace(text, "\r\n|[\r\x0b\x0c\x1c-\x1e\x85  ]", "\n")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, r"\n\z", ""), "\n", -1))


def clean_line(text: Column) -> Column:
    """Collapsed, without blanks and bars at the ends."""
    return F.regexp_replace(collapse(text), r"^[ |]+|[ |]+$", "")


def file_name(path: Column) -> Column:
    """The last part of a path with either kind of slash."""
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def normalize_date(value: Column) -> Column:
    """YYYYMMDD of YYYYMMDD or YYYY-MM-DD, if there is such a day."""
    d = F.when(value.rlike(r"^\d{8}$"), F.try_to_date(value, "yyyyMMdd")).when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))
    return F.date_format(d, "yyyyMMdd")


def english_date(value: Column) -> Column:
    """As normalize_date, also '5 Jan 2026' and '5 January 2026'."""
    t = collapse(value)
    d = F.coalesce(F.try_to_date(t, "d MMM yyyy"), F.try_to_date(t, "d MMMM yyyy"))
    return F.coalesce(normalize_date(value), F.date_format(d, "yyyyMMdd"))


def normalize_broker(value: Column) -> Column:
    """Letters and digits without accents, in lower case; names that agree in them are the same house."""
    return F.regexp_replace(F.replace(F.lower(nfkd(value)), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]", "")


def ticker_tokens(value: Column) -> Column:
    """Runs of A-Z and 0-9, exchange suffixes under their main name."""
    alias = lambda t: F.when(t == "GY", "GR").otherwise(t)
    return F.transform(F.regexp_extract_all(F.upper(nfkd(value)), F.lit("([A-Z0-9]+)"), 1), alias)


def normalize_ticker(value: Column) -> Column:
    """'ROOT EX': a security code and an exchange suffix of two letters; null for anything else."""
    raw = F.regexp_extract_all(F.upper(nfkd(value)), F.lit("([A-Z0-9]+)"), 1)
    good = lambda t: F.when((F.size(t) == 2) & F.get(t, F.lit(1)).rlike("^[A-Z]{2}$"), F.concat_ws(" ", F.get(t, F.lit(0)), F.when(F.get(t, F.lit(1)) == "GY", "GR").otherwise(F.get(t, F.lit(1)))))
    return let(raw, good)


def parse_filename(name: Column) -> Column:
    """struct<date, broker, digest> of {8 digits}_{source}_{32 hex}.pdf; null for other names."""
    p = r"(?i)^(\d{8})_(.+)_([0-9a-f]{32})\.pdf$"
    return F.when(name.rlike(p), F.struct(F.regexp_extract(name, p, 1).alias("date"), F.regexp_extract(name, p, 2).alias("broker"), F.regexp_extract(name, p, 3).alias("digest")))


def document_id(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def block_identity(document: Column, page: Column, order: Column, source_no: Column, bbox: Column, text: Column) -> Column:
    """p0001-b0002-{16 hex}: the same for the same content and place, else different."""
    box = F.concat_ws(",", *[F.format_string("%.3f", bbox[k]) for k in ("x0", "y0", "x1", "y1")])
    digest = F.sha2(F.concat_ws("\x1f", document, page.cast("string"), order.cast("string"), source_no.cast("string"), box, text), 256)
    return F.concat(F.format_string("p%04d-b%04d-", page, order), F.substring(digest, 1, 16))


def page_range(value: Column, page_count: Column) -> Column:
    """Sorted distinct pages of '1-3,5'; null value: all pages; a bad or reversed part, or one outside: null."""
    def parts(v: Column) -> Column:
        lo = lambda x: F.regexp_extract(x, r"^\s*(\d{1,9})\s*(?:-\s*(\d{1,9})\s*)?$", 1).try_cast("int")
        hi = lambda x: F.coalesce(F.regexp_extract(x, r"^\s*(\d{1,9})\s*(?:-\s*(\d{1,9})\s*)?$", 2).try_cast("int"), lo(x))
        fine = F.forall(v, lambda x: F.coalesce((lo(x) >= 1) & (lo(x) <= hi(x)) & (hi(x) <= page_count), F.lit(False)))
        return F.when(fine, F.array_sort(F.array_distinct(F.flatten(F.transform(v, lambda x: F.sequence(lo(x), hi(x)))))))

    return F.when(value.isNull(), F.when(page_count > 0, F.sequence(F.lit(1), page_count)).otherwise(F.array().cast("array<int>"))).otherwise(let(F.split(value, ",", -1), parts))


def redact(text: Column) -> Column:
    """Addresses, local paths and report file names replaced by marks."""
    t = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    t = F.regexp_replace(t, r"(?:/(?:home|Users|root|tmp|var)/[^\s\"']+|[A-Za-z]:\\[^\s\"']+)", "[PATH]")
    return F.regexp_replace(t, r"(?i)[^\s\"'/\\]+\.pdf\b", "[FILE]")


