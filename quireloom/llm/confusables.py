"""Visually identical text with different characters (problem 5).

Texts get one form: no invisible characters, ordinary spaces, characters of
normal width, joined letters apart, accents in one character with their letter.
Then look-alike letters are repaired token by token, script-aware: each token's
dominant script is determined, and in a token of mixed scripts the look-alikes
become Latin only when the result is a word of the corpus. Look-alikes are sure
(a Cyrillic o) or weak (a Greek nu); weak ones need a dominant Latin script too.

Two cases lie outside that method. A text with a letter of another script that
looks like no Latin one keeps all its letters. A token wholly of look-alikes
isn't mixed, so neither script nor corpus can speak for it: it becomes Latin if
every letter of the text that isn't Latin is a sure look-alike.

Null texts give no row, empty texts stay empty, repeated rows count once.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireloom.session import cut

# Letters of other scripts that look like a Latin letter.
SURE = dict(zip(
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοАВЕКМНОРСТХЅІЈУаеорсухѕіјһԁԛԝ",
    "ABEZHIKMNOPTYXoABEKMHOPCTXSIJYaeopcyxsijhdqw", strict=True,
))
WEAK = dict(zip("αγικνρτυχвгкмнпт", "ayikvptuxBrkmhnt", strict=True))
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]")
ODD = "[^ -~]"


@lru_cache(4096)
def script(c: str) -> str:
    """The script of a letter, by its name; '' for what isn't a letter."""
    if not c.isalpha():
        return ""
    name = unicodedata.name(c, "OTHER").split(" ")[0]
    return "LATIN" if name in ("LATIN", "FULLWIDTH", "KELVIN", "ANGSTROM", "FEMININE", "MASCULINE", "MODIFIER") else name


@lru_cache(4096)
def simple(c: str) -> str:
    """A character in ordinary width, joined letters apart; other compatibility characters stay."""
    if unicodedata.category(c) == "Zs":
        return " "
    kind = unicodedata.decomposition(c)
    if kind.startswith(("<wide>", "<narrow>")):
        return unicodedata.normalize("NFKC", c)
    if kind.startswith("<compat>") and len(n := unicodedata.normalize("NFKC", c)) > 1 and n.isalpha() and c.isalpha():
        return n
    return c


@lru_cache(100_000)
def plain(text: str) -> tuple[str, tuple[tuple[str, str, str | None], ...] | None]:
    """(the form, its tokens to be repaired: (as it stands, repaired, the word that the corpus must have)).

    No tokens: nothing to repair. No word: repaired in any case (or the same).
    """
    form = unicodedata.normalize("NFC", "".join(map(simple, INVISIBLE.sub("", text))))
    other = [c for c in unicodedata.normalize("NFD", form) if script(c) not in ("", "LATIN")]
    if not other or any(c not in SURE and c not in WEAK for c in other):
        return form, None
    all_sure = all(c in SURE for c in other)
    tokens = []
    for token in re.split("( +)", form):
        letters = unicodedata.normalize("NFD", token)
        scripts = [x for x in map(script, letters) if x]
        latin = scripts.count("LATIN")
        sure = all(c in SURE for c in letters if script(c) not in ("", "LATIN"))
        fixed = unicodedata.normalize("NFC", "".join(SURE.get(c) or WEAK.get(c) or c for c in letters))
        if fixed == token or not (all_sure if latin == 0 else sure or 2 * latin > len(scripts)):
            fixed = token
        tokens.append((token, fixed, bare(fixed) if fixed != token and latin else None))
    return form, tuple(tokens) if any(a != b for a, b, _ in tokens) else None


def bare(token: str) -> str:
    """A word without signs and digits around it, in lower case."""
    return re.sub(r"^[\W\d_]+|[\W\d_]+$", "", token).lower()


def bare_column(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, r"^\P{L}+|\P{L}+$", ""))


_TOKEN = T.StructType([T.StructField(c, T.StringType()) for c in ("token", "fixed", "word")])


@F.pandas_udf(T.StructType([T.StructField("form", T.StringType()), T.StructField("tokens", T.ArrayType(_TOKEN))]))
def plain_texts(text: pd.Series) -> pd.DataFrame:
    rows = [plain(t) for t in text]
    return pd.DataFrame({"form": [f for f, _ in rows], "tokens": [None if t is None else [dict(zip(("token", "fixed", "word"), x, strict=True)) for x in t] for _, t in rows]})


def repaired(odd: DataFrame, corpus: DataFrame) -> DataFrame:
    """Distinct texts of odd with plain; corpus: texts (text) whose words of Latin letters make up the vocabulary."""
    p = cut(odd.select("text").distinct().withColumn("p", plain_texts("text")).select("text", "p.*"))
    told = p.where(F.col("tokens").isNotNull())
    words = cut(told.select(F.explode("tokens.word").alias("word")).where(F.col("word").isNotNull()).distinct())
    vocabulary = corpus.select(F.explode(F.split("text", r"\s+")).alias("t")).where(F.col("t").rlike(r"^[\x21-\x7E\p{IsLatin}]+$")).select(bare_column(F.col("t")).alias("word"))
    known = vocabulary.join(words, "word", "left_semi").distinct()
    of_text = told.select("text", F.explode("tokens.word").alias("word")).join(known, "word").groupBy("text").agg(F.collect_set("word").alias("known"))
    use = lambda t: F.when(t["word"].isNull() | F.coalesce(F.array_contains("known", t["word"]), F.lit(False)), t["fixed"]).otherwise(t["token"])
    told = told.join(of_text, "text", "left").select("text", F.array_join(F.transform("tokens", use), "").alias("plain"))
    return p.where(F.col("tokens").isNull()).select("text", F.col("form").alias("plain")).unionByName(told)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """See TESTDATA.md. The corpus is the words, the tickers and the texts of the blocks."""
    read = lambda t, k, c: spark.read.parquet(f"{d}/{t}.parquet").select(F.lit(t).alias("record_table"), F.col(k).alias("record_id"), F.col(c).alias("text"))
    both = read("words", "word_id", "text").unionByName(read("queries", "query_id", "ticker"))
    odd = cut(both.where(F.col("text").rlike(ODD)).distinct())
    r = repaired(odd, both.select("text").unionByName(spark.read.parquet(f"{d}/blocks.parquet").select("text")))
    return odd.join(r.where(F.col("plain") != F.col("text")), "text").select("record_table", "record_id", F.col("plain").alias("plain_text"))
