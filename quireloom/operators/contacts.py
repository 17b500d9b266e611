"""Report metadata from blocks: contacts beside names, publication dates, titles.

A detail that could belong to two names belongs to none; a date that isn't the
only one on top of page one is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireloom.functions import text as X

EMAIL, PHONE = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", r"(\+?\d[\d ()./-]{7,}\d|\(\d{3}\) \d{3}-\d{4})"


def person_name(line: Column) -> Column:
    """A line of two to five capitalised words and nothing else; null for other lines."""
    t = F.regexp_replace(X.clean_line(line), r"^(?:Dr|Mr|Ms|Mrs|Prof)\.? ", "")
    words = F.split(t, " ")
    fine = F.size(words).between(2, 5) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}[\p{L}\p{M}'’-]*\.?,?$") & ~w.rlike(r"^\p{Lu}{2,}$"))
    return F.when(fine & ~t.rlike(r"(?i)^(?:senior )?(?:analyst|associate|director|head|vice|president|chief)\b"), t)


def contacts(blocks: DataFrame) -> DataFrame:
    """(document_id, block_id, name, email, phone): for each name line the nearest line with an address or a number, if it is nearest to no other name.

    All within a block, so without a join: lines of one block are one array.
    """
    b = blocks.where(F.col("text").isNotNull()).select("document_id", "block_id", F.posexplode(X.split_lines(F.col("text"))).alias("n", "line"))
    first = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    b = b.select("document_id", "block_id", "n", person_name(F.element_at(F.split("line", r"\||, (?=[+(\d]|\S+@)|\s\((?=[+\d])"), 1)).alias("name"), first(EMAIL).alias("email"), first(PHONE).alias("phone"))
    g = b.groupBy("document_id", "block_id").agg(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("n", "name")))).alias("names"), F.array_sort(F.collect_list(F.when(F.col("email").isNotNull(), F.struct("n", F.col("email").alias("v"))))).alias("emails"), F.array_sort(F.collect_list(F.when(F.col("phone").isNotNull(), F.struct("n", F.col("phone").alias("v"))))).alias("phones"))

    def nearest(items: str, at: Column) -> Column:
        """The value of the nearest line at or below the name, before the next name; null if two are as near."""
        after = F.array_min(F.transform(F.filter("names", lambda m: m["n"] > at), lambda m: m["n"]))
        mine = F.filter(items, lambda e: (e["n"] >= at) & (after.isNull() | (e["n"] < after)))
        return F.get(mine, F.lit(0))["v"]

    x = g.select("document_id", "block_id", F.explode(F.transform("names", lambda m: F.struct(m["n"].alias("n"), m["name"].alias("name"), nearest("emails", m["n"]).alias("email"), nearest("phones", m["n"]).alias("phone")))).alias("c"))
    return x.where(F.col("c.email").isNotNull() | F.col("c.phone").isNotNull()).select("document_id", "block_id", F.col("c.n").alias("line_number"), "c.name", "c.email", "c.phone")


# Lines that are no title, lines that are a date, forms of dates in the order in which they are tried.
NO_TITLE = r"(?i)\b(?:bloomberg|reuters|analysts?|research|target price|price target|rating|telephone|phone|email|disclosures?|contents|page \d+|www\.|equity research|company research|first reaction note|first take|company update|this insert is part of|sector report)\b|\b(?:sector|price)\s*:|@"
RATING_LINE = r"(?i)^(?:[A-Za-z0-9.&'’\-]+\s+){0,3}(?:buy|hold|sell|overweight|underweight|neutral|outperform|underperform)(?:\s*\([^)]{1,20}\))?$"
DATE_LINE = r"(?i)^(?:publication date|published|date)?\s*:?[ \t]*(\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}[./-]\d{1,2}[./-]\d{4})$"
DATE_FORMS = ["d MMMM yyyy", "d MMM yyyy", "yyyy-MM-dd", "d/M/yyyy", "d.M.yyyy", "d-M-yyyy"]
TITLE_BLOCKS, TITLE_BAND, DATE_BAND = 40, 0.48, 0.25


def front_lines(blocks: DataFrame, pages: DataFrame, band: float) -> DataFrame:
    """(document_id, block_id, place, y0, height, line_height, lines): cleaned lines of the blocks on top of page one, place counting from 1.

    pages: document_id, page_number, height. A page of unknown height has no top.
    """
    w = Window.partitionBy("document_id").orderBy("block_order", "block_id")
    b = blocks.where((F.col("page_number") == 1) & (F.trim("text") != "")).withColumn("place", F.row_number().over(w))
    j = b.join(pages.where(F.col("page_number") == 1).select("document_id", "height"), "document_id").where(F.col("bbox.y0") <= F.col("height") * band)
    lines = F.filter(F.transform(X.split_lines(F.col("text")), X.clean_line), lambda x: x != "")
    j = j.withColumn("lines", lines)
    return j.select("document_id", "block_id", "place", F.col("bbox.y0").alias("y0"), "height", ((F.col("bbox.y1") - F.col("bbox.y0")) / F.greatest(F.size("lines"), F.lit(1))).alias("line_height"), "lines")


def written_date(text: Column) -> Column:
    """A date in the first of DATE_FORMS that fits; null if none does."""
    t = F.initcap(text)
    return F.coalesce(*[F.try_to_date(t, f) for f in DATE_FORMS])


def publication_dates(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, published, block_ids): the only date that lines on the top quarter of page one consist of; null where there are several."""
    x = front_lines(blocks, pages, DATE_BAND).select("document_id", "block_id", F.explode("lines").alias("line"))
    d = x.select("document_id", "block_id", written_date(F.nullif(F.regexp_extract("line", DATE_LINE, 1), F.lit(""))).alias("d")).where(F.col("d").isNotNull())
    g = d.groupBy("document_id").agg(F.size(F.collect_set("d")).alias("n"), F.first("d").alias("d"), F.array_sort(F.collect_set("block_id")).alias("ids"))
    one = F.col("n") == 1
    return g.select("document_id", F.when(one, F.date_format("d", "yyyy-MM-dd")).alias("published"), F.when(one, F.col("ids")).alias("block_ids"))


def title_score(line: Column, y: Column, height: Column, line_height: Column) -> Column:
    """Place, height of the letters, number of words and a dash or colon; null for lines that can be no title."""
    words = F.size(F.regexp_extract_all(line, F.lit(r"([A-Za-z][A-Za-z0-9&'\-/]*)"), 1))
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    fine = words.between(3, 24) & F.length(line).between(12, 220) & ~line.rlike(NO_TITLE) & ~line.rlike(RATING_LINE) & (letters / F.length(line) >= 0.55) & ~line.rlike(r"^[A-Z]{1,6}(?:\s+[A-Z]{2})?$")
    place = F.greatest(F.lit(0.0), 70.0 - y / F.greatest(height, F.lit(1.0)) * 100.0)
    return F.when(fine, place + F.least(line_height, F.lit(28.0)) * 2.0 + F.when(words.between(4, 16), 12.0).otherwise(0.0) + F.when(line.rlike("[:\\-–—]"), 4.0).otherwise(0.0))


def titles(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, title, title_score, block_id): the best one to three lines of the first blocks in the upper half of page one, the earlier block on ties."""
    b = front_lines(blocks, pages, TITLE_BAND).where(F.col("place") <= TITLE_BLOCKS).where(F.size("lines") > 0)
    x = b.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("lines"))))
    x = x.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.size("lines") - F.col("at") + 1)))).withColumn("part", F.expr("slice(lines, at, n)"))
    x = x.where((F.col("n") == 1) | F.forall("part", lambda p: F.size(F.regexp_extract_all(p, F.lit("([A-Za-z0-9]+)"), 1)) >= 2)).withColumn("line", F.array_join("part", " "))
    x = x.withColumn("score", title_score(F.col("line"), F.col("y0"), F.col("height"), F.col("line_height")) + 6.0 * (F.col("n") - 1)).where(F.col("score").isNotNull())
    best = x.groupBy("document_id").agg(F.max(F.struct("score", (-F.col("place")).alias("p"), "line", "block_id")).alias("t"))
    return best.select("document_id", F.col("t.line").alias("title"), F.round("t.score", 6).alias("title_score"), F.col("t.block_id").alias("block_id"))


# Order of how analysts are named in a report.
STATUS_ORDER = {"covering": 0, "lead": 1, "relevant": 2}


def analyst_order(analysts: DataFrame, key: str) -> DataFrame:
    """analysts with place: by status, name without regard to case, address; key decides ties."""
    rank = F.coalesce(*[F.when(F.col("selection_status") == s, k) for s, k in STATUS_ORDER.items()], F.lit(3))
    return analysts.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy(rank, F.lower(F.coalesce("name", F.lit(""))), F.coalesce("email", F.lit("")), key)))
