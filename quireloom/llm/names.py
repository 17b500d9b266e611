"""Variant spellings of names typed by people (problem 3).

Spellings are parsed into forms (given and family name of a person; distinctive
words and type of a house), forms are blocked by token suffixes, pairs of a
block are compared by the ratio of their longest common subsequence (MIN_RATIO,
at most one letter off), and each form joins the best supported form it is a
variant of. Abbreviated forms
(initials, first letters, one of several words) join every form they shorten,
if that is one entity; else the one that shares an e-mail address, else the
best supported.

Blocks: all suffixes of at least MIN_SUFFIX letters of each token and of the
reversed token; what more than COMMON forms have is refined by another field and
discarded only if it is still as common. Short names with a letter off
share no such suffix, so all forms have keys for each rule of _relate as well
(one-letter deletions of the one field with what the rule asks of the other),
which give every pair that is linked, whatever the size of the tables.

Nulls and cells without a letter stand for nobody and give no row; repeated
rows count as support only; one spelling alone gives no pair.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireloom.session import cut

MIN_SUFFIX, COMMON = 3, 200
MIN_RATIO, LEAST = 0.75, 4

# Titles and degrees, short forms of given names, words that say what kind of house it is.
TITLES = {"dr", "prof", "mr", "mrs", "ms", "miss", "sir", "cfa", "phd", "mba", "cpa", "frm", "acca", "jr", "sr"}
NICKNAMES = {
    "bill": "william", "will": "william", "bob": "robert", "rob": "robert", "tony": "anthony", "ted": "theodore", "theo": "theodore", "ned": "edward", "ed": "edward",
    "eddie": "edward", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "jamie": "james", "jim": "james", "drew": "andrew", "andy": "andrew", "debbie": "deborah",
    "deb": "deborah", "becky": "rebecca", "hannes": "johannes", "annie": "annemarie", "anne": "annemarie", "jean": "jeanluc", "ola": "olumide", "mike": "michael", "mick": "michael",
    "dick": "richard", "rick": "richard", "rich": "richard", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "alex": "alexander", "sandy": "alexander", "sasha": "aleksandra",
    "chris": "christopher", "kit": "christopher", "sam": "samantha", "tom": "thomas", "nick": "nicholas", "ben": "benjamin", "pat": "patricia", "trish": "patricia", "jen": "jennifer",
    "jenny": "jennifer", "sue": "susan", "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "vicky": "victoria", "tina": "bettina", "dimi": "dimitrios", "fran": "francesca",
    "matt": "matthias", "gabi": "gabriele", "memo": "guillermo", "beppe": "giuseppe", "lou": "ludovic",
    "cesca": "francesca", "jo": "johannes", "ludo": "ludovic", "ali": "alison", "dan": "daniel", "dave": "david", "greg": "gregory", "jack": "john", "joe": "joseph", "larry": "lawrence", "len": "leonard", "lex": "alexander", "marty": "martin", "phil": "philip", "ray": "raymond", "ron": "ronald", "steve": "stephen", "tim": "timothy", "wendy": "gwendolyn",
}
ALSO_SHORT_FOR = {"ola": "aleksandra", "sandy": "aleksandra", "alex": "aleksandra", "sasha": "alexander", "anne": "anna", "jo": "joanna", "sam": "samuel", "chris": "christina", "pat": "patrick"}
HOUSE_WORDS = {
    "securities": ["sec", "secs"], "research": ["res", "rsch"], "bank": ["bk", "bnk", "bank"], "capital": ["cap"], "markets": ["mkts", "mkt"], "partners": ["ptnrs", "prtnrs"],
    "group": ["gp", "grp"], "equities": ["eq", "eqs"], "brokerage": ["brok", "brkrg"], "investment": ["inv"], "company": ["co"],
}
FILLERS = {"the", "and", "plc", "ltd", "inc", "llc", "llp", "ag", "sa", "se", "nv", "limited", "of"}
_WORD_OF = {s: w for w, ss in HOUSE_WORDS.items() for s in [w, *ss]}
_LONG_WORDS = [w for w in HOUSE_WORDS if len(w) > 4]
_LETTERS = str.maketrans({"ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})


def fold(s: str) -> str:
    """Lower case without accents."""
    s = unicodedata.normalize("NFKD", s.lower()).translate(_LETTERS)
    return "".join(c for c in s if not unicodedata.combining(c))


def lcs_length(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of a[i] and b[i], all pairs at once."""
    if not a:
        return np.zeros(0, np.int32)
    la, lb = max(map(len, a), default=0), max(map(len, b), default=0)
    pad = lambda xs, n, fill: np.array([[ord(c) for c in x] + [fill] * (n - len(x)) for x in xs], np.int32).reshape(len(xs), n)
    x, y = pad(a, la, -1), pad(b, lb, -2)
    row = np.zeros((len(a), lb + 1), np.int16)
    for i in range(la):
        new = row.copy()
        for j in range(lb):
            new[:, j + 1] = np.where(x[:, i] == y[:, j], row[:, j] + 1, np.maximum(row[:, j + 1], new[:, j]))
        row = new
    return row[:, lb].astype(np.int32)


def lcs_ratio(a: list[str], b: list[str]) -> np.ndarray:
    n = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], float)
    return np.where(n > 0, 2 * lcs_length(a, b) / np.maximum(n, 1), 1.0)


def near(a: list[str], b: list[str]) -> np.ndarray:
    """Whether two texts of at least LEAST letters have an LCS ratio of MIN_RATIO and miss at most one letter of the longer.

    The ratio alone would let long names differ in several letters, and similar
    names are of different people.
    """
    if not a:
        return np.zeros(0, bool)
    n = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)], float)
    longest = n.max(1)
    maybe = np.flatnonzero((abs(n[:, 0] - n[:, 1]) <= 1) & (longest >= LEAST))
    common = lcs_length([a[i] for i in maybe], [b[i] for i in maybe])
    out = np.zeros(len(a), bool)
    out[maybe] = (2 * common >= MIN_RATIO * n[maybe].sum(1)) & (common >= longest[maybe] - 1)
    return out


def without_one(w: str) -> set[str]:
    """w and what is left of it without one letter."""
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}


@lru_cache(1)
def _kinds_without_one() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for w in _LONG_WORDS:
        for k in without_one(w):
            out.setdefault(k, []).append(w)
    return out


@lru_cache(100_000)
def kind_word(w: str) -> str | None:
    """The word for a kind of house that w is or is near."""
    if w in _WORD_OF:
        return _WORD_OF[w]
    index = _kinds_without_one()
    may = sorted({x for k in without_one(w) for x in index.get(k, [])}, key=_LONG_WORDS.index)
    yes = near([w] * len(may), may)
    return next((x for x, y in zip(may, yes, strict=True) if y), None)


def parse_person(cell: str) -> tuple[str, str, str, bool]:
    """(given, family, '', shortened) of a name cell; contact details, titles and middle initials don't count."""
    s = re.sub(r"\s+(?:/|-|–|\|)\s+\S*[@\d(].*$|\s*[(<\[][^)>\]]*(?:@|\d)[^)>\]]*\)?.*$", "", cell).strip()
    parts = [p.strip() for p in s.split(",") if p.strip() and fold(p).strip(" .") not in TITLES]
    words = lambda p: [w for w in re.split(r"[\s.]+", p) if w and fold(w) not in TITLES]
    if len(parts) >= 2:
        family, given = words(parts[0]), words(parts[1])
    else:
        w = words(parts[0]) if parts else []
        if len(w) >= 2 and all(len(x) == 1 for x in w[1:]) or len(w) >= 2 and len(w[0]) > 2 and w[0].isupper() and not w[-1].isupper():
            family, given = w[:1], w[1:]
        else:
            family, given = w[-1:], w[:-1]
    letters = lambda ws: ["".join(c for c in fold(x) if c.isalpha()) for x in ws]
    f, g = "".join(letters(family)), [x for x in letters(given) if x]
    long = [x for x in g if len(x) > 1]
    given_name = "".join(long) if long else (g[0] if g else "")
    if len(given) == 1 and 1 < len(given[0]) < 4 and given[0].isupper() and family and not family[0].isupper():
        given_name = given_name[:1]  # initials of a double name
    return given_name, f, "", len(given_name) < 2


def parse_house(cell: str) -> tuple[str, str, str, bool]:
    """('', distinctive words in order of the alphabet, kind of house, shortened)."""
    s = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", cell)
    s = re.sub(r"[&+]", " and ", s)
    core, kind, dotted = [], [], False
    for raw in re.findall(r"[^\W\d_]+\.?", s):
        w = fold(raw.rstrip("."))
        if w in FILLERS:
            continue
        if k := kind_word(w):
            kind.append(k)
        elif w == "capmkts":
            kind += ["capital", "markets"]
        else:
            core.append(w)
            dotted |= raw.endswith(".")
    acronym = len(core) == 1 and len(core[0]) <= 3 and re.search(rf"\b{re.escape(core[0].upper())}\b", cell) is not None
    return "", " ".join(sorted(core)), " ".join(sorted(set(kind))), dotted or acronym


_PARSED = T.StructType([*[T.StructField(c, T.StringType()) for c in ("given", "family", "type")], T.StructField("short", T.BooleanType())])


@F.pandas_udf(_PARSED)
def parsed(kind: pd.Series, spelling: pd.Series) -> pd.DataFrame:
    rows = [parse_house(s) if k == "broker" else parse_person(s) for k, s in zip(kind, spelling, strict=True)]
    return pd.DataFrame(rows, columns=["given", "family", "type", "short"])


def email_key(cell: Column) -> Column:
    """The first address of a cell in plain form, without +notes; null if there is none."""
    t = F.regexp_replace(F.lower(cell), r"\s*[\[(]\s*at\s*[\])]\s*|\s+@\s+", "@")
    t = F.regexp_replace(t, r"\s*[\[(]\s*dot\s*[\])]\s*", ".")
    e = F.regexp_extract(t, r"[a-z0-9._+-]+@[a-z0-9.-]+[a-z0-9]", 0)
    return F.when(e != "", F.regexp_replace(e, r"\+[^@]*@", "@"))


def forms(spellings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: kind, spelling, form), (forms: form, kind, given, family, type, short, n, emails)."""
    per = spellings.groupBy("kind", "spelling").agg(F.count("*").alias("n"), F.collect_set("email").alias("emails"))
    # Written first: else the filter on the parsed form moves below the aggregation, and every row is parsed.
    p = cut(per).withColumn("p", parsed("kind", "spelling")).where(F.length("p.family") > 0)
    p = p.select("kind", "spelling", "n", "emails", "p.*").withColumn("form", F.concat_ws("|", "kind", "given", "family", "type", "short"))
    p = cut(p)
    f = p.groupBy("form", "kind", "given", "family", "type", "short").agg(F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("emails"))).alias("emails"))
    return p.select("kind", "spelling", "form"), cut(f)


def _map(pairs: dict[str, str], c: str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), F.col(c))


def deletions(t: Column) -> Column:
    """The text and what is left of it without one letter: texts one letter apart share one of them."""
    n = F.length(t)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, n))))


def exact_keys(f: DataFrame) -> DataFrame:
    """(form, key, hub): any two forms that _relate may link without an address share a key where one of them at least is no hub."""
    tokens = F.split("family", " ")
    letters = lambda t: F.array_join(F.array_sort(F.split(t, "")), "")
    prefixes = lambda t: F.transform(F.sequence(F.lit(MIN_SUFFIX), F.greatest(F.lit(MIN_SUFFIX), F.length(t))), lambda n: F.substring(t, F.lit(1), n))
    x = f.withColumn("root", F.coalesce(_map(NICKNAMES, "given"), "given")).withColumn("also", _map(ALSO_SHORT_FOR, "given"))
    people, houses = x.where("kind <> 'broker'"), x.where("kind = 'broker'")
    whole, full = people.where("NOT short"), houses.where("NOT short")
    word = houses.where(F.col("short") & (F.size(tokens) == 1))

    def keys(y: DataFrame, name: str, within: Column | str, each: Column, hub: Column | bool = False) -> DataFrame:
        k = y.select("form", "kind", F.col(within).alias("within") if isinstance(within, str) else within.alias("within"), F.explode(each).alias("part"), (F.lit(hub) if isinstance(hub, bool) else hub).alias("hub"))
        return k.select("form", F.concat_ws("#", F.lit(name), "kind", "within", "part").alias("key"), "hub")

    close, none = deletions(F.col("family")), F.lit("")
    return reduce(DataFrame.unionByName, [
        keys(whole, "given", "root", close), keys(whole.where("also IS NOT NULL"), "given", "also", close),  # one given name, families one letter apart
        keys(whole, "family", "family", deletions(F.col("root"))),  # one family, given names one letter apart
        keys(people, "initial", F.substring("root", 1, 1), close, ~F.col("short")),  # initials, and families alone, with what they shorten
        keys(full, "house", none, close),
        keys(full, "word", none, F.flatten(F.transform(tokens, deletions)), F.size(tokens) > 1),  # one word of several
        keys(full, "first", none, F.flatten(F.transform(tokens, prefixes)), True), keys(word.where(F.length("family") >= 3), "first", none, F.array("family")),  # first letters of a word
        keys(full.where(F.size(tokens) > 1), "letters", none, F.array(letters(F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), ""))), True), keys(word, "letters", none, F.array(letters(F.col("family")))),
    ])


def address_keys(f: DataFrame) -> DataFrame:
    """(form, key, hub) of people with addresses: one address and families one letter apart."""
    k = f.where("kind <> 'broker'").select("form", "family", F.explode("emails").alias("email")).select("form", "email", F.explode(deletions(F.col("family"))).alias("part"))
    return k.select("form", F.concat_ws("#", F.lit("address"), "email", "part").alias("key"), F.lit(False).alias("hub"))


def blocks(f: DataFrame) -> DataFrame:
    """(form, key, hub): the suffix index and the exact keys. Two hubs of a key needn't be compared.

    A suffix that more than COMMON forms have is refined by the initial of the
    given name or the kind of house, and discarded if it is still as common.
    """
    tokens = F.split("family", " ")
    suffixes = lambda t: F.transform(F.sequence(F.lit(MIN_SUFFIX), F.greatest(F.lit(MIN_SUFFIX), F.length(t))), lambda n: F.substring(t, -F.least(n, F.length(t)), F.length(t)))
    other = F.when(F.col("kind") == "broker", F.col("type")).otherwise(F.substring(F.coalesce(_map(NICKNAMES, "given"), "given"), 1, 1))
    rows = f.select("form", "kind", other.alias("other"), F.explode(tokens).alias("token"))
    both = F.concat(F.transform(suffixes(F.col("token")), lambda s: F.concat(F.lit("s:"), s)), F.transform(suffixes(F.reverse("token")), lambda s: F.concat(F.lit("p:"), s)))
    k = rows.withColumn("key", F.explode(F.array_distinct(both))).select("form", "other", F.concat_ws(":", "kind", "key").alias("key"))
    sized = k.join(k.groupBy("key").agg(F.countDistinct("form").alias("size")), "key")
    few = sized.where(F.col("size") <= COMMON).select("form", "key")
    fine = sized.where(F.col("size") > COMMON).select("form", F.concat_ws("#", "key", "other").alias("key"))
    fine = fine.join(fine.groupBy("key").agg(F.countDistinct("form").alias("size")).where(F.col("size") <= COMMON), "key").select("form", "key")
    return few.unionByName(fine).withColumn("hub", F.lit(False)).unionByName(exact_keys(f)).distinct()


def block_keys(f: DataFrame) -> DataFrame:
    return blocks(f).select("form", "key").distinct()


_REL = "child string, parent string, rel string, ratio double, n long, shared boolean"


def _relate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Which of two forms is a variant or a shortening of the other; see the rules in line."""
    for b in batches:
        g1, g2 = [NICKNAMES.get(x, x) for x in b.given_a], [NICKNAMES.get(x, x) for x in b.given_b]
        f1, f2, t1, t2 = list(b.family_a), list(b.family_b), list(b.type_a), list(b.type_b)
        e1, e2 = [set(x) for x in b.emails_a], [set(x) for x in b.emails_b]
        near_f, near_g = near(f1, f2), near(g1, g2)
        ratio = lcs_ratio([f"{g} {f}" for g, f in zip(g1, f1, strict=True)], [f"{g} {f}" for g, f in zip(g2, f2, strict=True)])
        out = []
        for i, r in enumerate(b.itertuples(index=False)):
            shared = bool(e1[i] & e2[i])
            against = bool(e1[i]) and bool(e2[i]) and not shared
            same_type = not t1[i] or not t2[i] or t1[i] == t2[i]
            rel = None
            if r.kind == "broker":
                for short, full, sf, ff, first in ((r.form_a, r.form_b, f1[i], f2[i], True), (r.form_b, r.form_a, f2[i], f1[i], False)):
                    whole, part = ff.split(" "), sf.split(" ")
                    flag, other = (r.short_a, r.short_b) if first else (r.short_b, r.short_a)
                    if other or len(part) > 1 or not same_type or rel:
                        continue
                    initials = "".join(w[0] for w in whole)
                    if len(whole) > 1 and flag and sorted(sf) == sorted(initials) and len(sf) == len(whole):
                        rel = (short, full, "short")
                    elif flag and len(sf) >= 3 and any(w.startswith(sf) for w in whole):
                        rel = (short, full, "short")
                    elif len(whole) > 1 and not flag and (sf in whole or near([sf] * len(whole), whole).any()):
                        rel = (short, full, "short")
                if rel is None and same_type and not r.short_a and not r.short_b and len(f1[i].split(" ")) == len(f2[i].split(" ")) and (f1[i] == f2[i] or near_f[i]):
                    rel = "same"
            elif not r.short_a and not r.short_b:
                same_f, same_g = f1[i] == f2[i], g1[i] == g2[i] or ALSO_SHORT_FOR.get(r.given_a) == g2[i] or ALSO_SHORT_FOR.get(r.given_b) == g1[i]
                if same_f and (same_g or shared) or not against and (same_f and near_g[i] or same_g and near_f[i]):
                    rel = "same"
            elif r.short_a != r.short_b:
                short, full, gs, gf = (r.form_a, r.form_b, g1[i], g2[i]) if r.short_a else (r.form_b, r.form_a, g2[i], g1[i])
                if (f1[i] == f2[i] or near_f[i] and not against) and gf.startswith(gs) and (gs or shared):
                    rel = (short, full, "short")
            elif (f1[i] == f2[i] or near_f[i]) and g1[i] == g2[i] and not against:
                rel = "same"
            if rel == "same":
                up = (r.n_a, r.form_b) >= (r.n_b, r.form_a)  # the better supported form is the parent
                rel = (r.form_b, r.form_a, "same") if up else (r.form_a, r.form_b, "same")
            if rel:
                out.append((*rel, float(ratio[i]), int(r.n_a if rel[1] == r.form_a else r.n_b), shared))
        yield pd.DataFrame(out, columns=["child", "parent", "rel", "ratio", "n", "shared"])


def compared(f: DataFrame) -> DataFrame:
    """(form_a, form_b): the pairs to be compared."""
    keys = blocks(f).unionByName(address_keys(f)).distinct()
    a, b = keys.toDF("form_a", "key", "hub_a"), keys.toDF("form_b", "key", "hub_b")
    return a.join(b, "key").where((F.col("form_a") < F.col("form_b")) & ~(F.col("hub_a") & F.col("hub_b"))).select("form_a", "form_b").distinct()


def related(f: DataFrame) -> DataFrame:
    """(child, parent, rel, ratio, n of the parent, shared): the compared pairs that are related."""
    pairs = compared(f)
    side = lambda x: f.select(F.col("form").alias(f"form_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("given", "family", "type", "short", "n", "emails")], *([F.col("kind")] if x == "a" else []))
    return pairs.join(side("a"), "form_a").join(side("b"), "form_b").mapInPandas(_relate, _REL)


def entities(f: DataFrame) -> DataFrame:
    """(form, entity): the root of each form; a shortened form may have several only if equal evidence leads to them."""
    rel = cut(related(f))
    best = Window.partitionBy("child").orderBy(F.desc("shared"), F.desc("n"), F.desc("ratio"), "parent")
    up = rel.where(F.col("rel") == "same").withColumn("k", F.row_number().over(best)).where("k = 1").select(F.col("child").alias("form"), F.col("parent").alias("root"))
    root = f.select("form").join(up, "form", "left").select("form", F.coalesce("root", "form").alias("root"))
    while True:  # pointer jumping: as many rounds as the logarithm of the longest chain of variants
        root = cut(root)
        nxt = root.alias("a").join(root.alias("b"), F.col("a.root") == F.col("b.form")).select(F.col("a.form"), F.col("a.root").alias("was"), F.col("b.root").alias("root"))
        nxt = cut(nxt)
        if nxt.where(F.col("was") != F.col("root")).isEmpty():
            break
        root = nxt.select("form", "root")
    # A short form, with the variants that chose it as their root, joins the entity that it shortens.
    short = rel.where(F.col("rel") == "short").join(root.withColumnRenamed("form", "parent").withColumnRenamed("root", "entity"), "parent")
    score = short.groupBy("child", "entity").agg(F.max(F.col("shared")).alias("shared"), F.sum("n").alias("n"), F.max("ratio").alias("ratio"))
    top = Window.partitionBy("child")
    score = score.withColumn("any_shared", F.max("shared").over(top)).withColumn("k", F.row_number().over(top.orderBy(F.desc("shared"), F.desc("n"), F.desc("ratio"), "entity")))
    joined = score.where((F.col("any_shared") & F.col("shared")) | (~F.col("any_shared") & (F.col("k") == 1))).select("child", "entity")
    via = root.join(joined.withColumnRenamed("child", "root").withColumnRenamed("entity", "through"), "root", "left")
    mine = root.join(joined.withColumnRenamed("child", "form"), "form").select("form", "entity")
    return via.select("form", F.coalesce("through", "root").alias("entity")).unionByName(mine).distinct()


def spelling_entities(spark: SparkSession, d: str) -> DataFrame:
    """(kind, spelling, entity)."""
    a = spark.read.parquet(f"{d}/analysts.parquet").select("analyst_row_id", "name", "email").where(F.col("name").isNotNull()).distinct()
    q = spark.read.parquet(f"{d}/queries.parquet").select("query_id", "broker").where(F.col("broker").isNotNull()).distinct()
    people = a.select(F.lit("analyst").alias("kind"), F.col("name").alias("spelling"), F.coalesce(email_key(F.col("email")), email_key(F.col("name"))).alias("email"))
    houses = q.select(F.lit("broker").alias("kind"), F.col("broker").alias("spelling"), F.lit(None).cast("string").alias("email"))
    members, f = forms(people.unionByName(houses))
    return members.join(entities(f), "form").select("kind", "spelling", "entity").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """See TESTDATA.md."""
    m = cut(spelling_entities(spark, d))
    a, b = m.withColumnRenamed("spelling", "spelling_a"), m.withColumnRenamed("spelling", "spelling_b")
    return a.join(b, ["kind", "entity"]).where(F.col("spelling_a") < F.col("spelling_b")).select(F.col("kind").alias("entity_kind"), "spelling_a", "spelling_b").distinct()


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    """Per spelling its entity and how many other spellings that has: the links without expanding them into pairs."""
    m = cut(spelling_entities(spark, d))
    n = m.groupBy("kind", "entity").agg((F.count("*") - 1).alias("n_links"))
    return m.join(n, ["kind", "entity"]).select("kind", "spelling", "entity", "n_links")
