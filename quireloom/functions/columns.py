"""Helpers on Columns: bindings, spans of matches, ordered distinct."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value evaluated once; the optimizer would else copy value to every place that reads it."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with value under name, evaluated once a row: projections and filters aren't merged across the generator."""
    return df.withColumn(name, F.explode(F.array(value)))


def ordered_distinct(rows: Column, field: str | None = None) -> Column:
    """First occurrences of a collected array of structs, in order of the structs."""
    s = F.array_sort(rows)
    return F.array_distinct(F.transform(s, lambda x: x[field]) if field else s)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: code point offsets and text of the matches; the pattern must not match the empty text."""
    def fold(w: Column) -> Column:
        at = F.aggregate(
            F.sequence(F.lit(0), F.size(w["m"])),
            F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out")),
            lambda acc, i: F.when(i < F.size(w["m"]), let(acc["pos"] + F.length(F.get(w["p"], i)), lambda s: F.struct(
                (s + F.length(F.get(w["m"], i))).alias("pos"),
                F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + F.length(F.get(w["m"], i))).alias("e"), F.get(w["m"], i).alias("m")))).alias("out"),
            ))).otherwise(acc),
        )
        return at["out"]

    return let(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1).alias("m")), fold)


def nonempty(c: Column) -> Column:
    """Null for the empty text that regexp_extract gives without a match."""
    return F.nullif(c, F.lit(""))
