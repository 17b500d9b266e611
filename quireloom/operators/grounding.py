"""Whether claims are supported by the blocks they cite: numbers, direction of effect, words, causes.

Every rule is a Column over (claim text, evidence text); evidence texts come
from one join and an ordered collection per claim, whose size is that of its
own list of ids. Claims with null or unknown ids only have no evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireloom.operators.passages import CAUSAL, INFERRED

# Words and patterns of the support rules.
POSITIVE = r"\b(?:raise[sd]?|increase[sd]?|lift(?:ed|s)?|support(?:ed|s)?|boost(?:ed|s)?|improv(?:e[sd]?|ing))\b"
NEGATIVE = r"\b(?:lower(?:ed|s)?|reduce[sd]?|cut(?:s|ting)?|weigh(?:ed|s)?|hurt(?:s|ing)?|declin(?:e[sd]?|ing))\b"
TOKEN, NUMBER = r"([A-Za-z][A-Za-z0-9_-]{2,})", r"((?<![A-Za-z])[-+]?\d+(?:[.,]\d+)?%?)"
STOPWORDS = ["and", "the", "for", "with", "that", "this", "from", "into", "because", "after", "before", "broker", "report", "estimate", "estimates", "change", "changed", "higher", "lower", "reflecting", "driven", "results", "result"]
GENERIC_ROLES = ["chief", "officer", "head", "director", "president", "executive"]
MAX_CLAIM, MAX_ITEMS = 500, 100


def polarities(text: Column) -> Column:
    return F.array_compact(F.array(F.when(text.rlike(f"(?i){POSITIVE}"), "positive_effect"), F.when(text.rlike(f"(?i){NEGATIVE}"), "negative_effect")))


def tokens(text: Column) -> Column:
    """Lower-case words of three letters and more, with a word for each direction of effect."""
    return F.array_union(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 1), F.lower)), polarities(text))


def content_tokens(text: Column) -> Column:
    return F.array_except(tokens(text), F.array(*[F.lit(w) for w in STOPWORDS]))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), 1), lambda x: F.replace(x, F.lit(","), F.lit("."))))


def needed(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((n + 1) / 2))


def supported(claim: Column, evidence: Column) -> Column:
    """Numbers and directions of the claim stand in the evidence, and half of its words do."""
    words = content_tokens(claim)
    overlap = F.size(F.array_intersect(words, tokens(evidence)))
    fine = (F.size(F.array_except(numbers(claim), numbers(evidence))) == 0) & (F.size(F.array_except(polarities(claim), polarities(evidence))) == 0) & ((F.size(words) == 0) | (overlap >= needed(F.size(words))))
    return F.coalesce(fine & (F.length(claim) > 0), F.lit(False))


def confidence(claim: Column, evidence: Column, n_ids: Column) -> Column:
    words = content_tokens(claim)
    ratio = F.size(F.array_intersect(words, tokens(evidence))) / F.greatest(F.size(words), F.lit(1))
    return F.when((n_ids == 1) & (ratio >= 0.8), "high").when(ratio >= 0.5, "medium").otherwise("low")


def causal_support(claim: Column, evidence: Column, pattern: str) -> Column:
    """Some sentence of the evidence has the causal phrase and half of the claim's words."""
    t = F.regexp_replace(evidence, r"\s*\n\s*", " ")
    for a, b in ((r"(?i)\bvs\.", "vs"), (r"(?i)\be\.g\.", "eg"), (r"(?i)\bi\.e\.", "ie")):
        t = F.regexp_replace(t, a, b)
    words = content_tokens(claim)
    return F.coalesce(F.exists(F.split(t, r"[.!?]\s+"), lambda s: s.rlike(f"(?is)(?:{pattern})") & (F.size(F.array_intersect(words, tokens(s))) >= needed(F.size(words)))), F.lit(False))


def causal_link(claim: Column, evidence: Column, stated: Column) -> Column:
    """The link that the evidence carries: explicit stays only with an explicit phrase, else inferred, else none."""
    e, i = causal_support(claim, evidence, CAUSAL), causal_support(claim, evidence, INFERRED)
    return F.when((stated == "explicit") & e, "explicit").when(e | i, "inferred")


def role_supported(role: Column, evidence: Column) -> Column:
    bare = lambda x: F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(TOKEN), 1), F.lower))
    special = F.array_except(bare(role), F.array(*[F.lit(w) for w in GENERIC_ROLES]))
    return F.when(F.size(special) > 0, F.size(F.array_except(special, bare(evidence))) == 0).otherwise(F.contains(F.lower(evidence), F.lower(role)))


def cited_evidence(claims: DataFrame, key: list[str], blocks: DataFrame) -> DataFrame:
    """claims with ids (known ones, in order), dropped (whether an id is unknown) and evidence (their texts, a line each)."""
    ids = F.array_distinct(F.slice(F.coalesce("evidence_block_ids", F.array().cast("array<string>")), 1, MAX_ITEMS))
    x = claims.select(*key, "document_id", F.posexplode(ids).alias("i", "block_id"))
    b = blocks.select("document_id", "block_id", "text").dropDuplicates(["document_id", "block_id"]).withColumn("known", F.lit(True))
    j = x.join(b, ["document_id", "block_id"], "left")
    g = j.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("i", "block_id", "text")))).alias("e"), F.max(F.col("known").isNull()).alias("dropped"))
    g = g.select(*key, F.transform("e", lambda v: v["block_id"]).alias("ids"), "dropped", F.array_join(F.transform("e", lambda v: v["text"]), "\n").alias("evidence"))
    out = claims.join(g, key, "left")
    return out.withColumns({"ids": F.coalesce("ids", F.array().cast("array<string>")), "dropped": F.coalesce("dropped", F.lit(False)), "evidence": F.coalesce("evidence", F.lit(""))})


def validate_claims(claims: DataFrame, key: list[str], blocks: DataFrame, text: str) -> DataFrame:
    """claims with valid, own_confidence and problems: codes of what was removed and why."""
    c = cited_evidence(claims, key, blocks).withColumn("said", F.when(F.length(F.trim(text)).between(1, MAX_CLAIM), F.trim(text)))
    ok = supported(F.col("said"), F.col("evidence")) & (F.size("ids") > 0)
    problems = F.array_compact(F.array(F.when(F.col("dropped"), "invented_or_unselected_block_id_removed"), F.when(F.col("said").isNull(), "malformed_grounded_claim_removed").when(~ok, "unsupported_claim_removed")))
    return c.withColumns({"valid": ok & F.col("said").isNotNull(), "own_confidence": F.when(ok, confidence(F.col("said"), F.col("evidence"), F.size("ids"))), "problems": problems})


# Words that the definition of a common short form must have.
JARGON = {
    "eps": ["earnings", "share"], "ebit": ["earnings", "interest", "tax"], "ebitda": ["earnings", "interest", "tax", "depreciation", "amortization"], "nii": ["net", "interest", "income"],
    "fcf": ["free", "cash", "flow"], "capex": ["capital", "expenditure"], "cet1": ["common", "equity", "tier"],
}


def jargon_supported(term: Column, definition: Column, evidence: Column) -> Column:
    """The term stands in the evidence, and its definition has the words it must have or is given there explicitly."""
    bare = lambda x: F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(TOKEN), 1), F.lower))
    t, words = F.lower(term), bare(definition)
    must = F.coalesce(*[F.when(t == k, F.array(*[F.lit(w) for w in v])) for k, v in JARGON.items()])
    quoted = F.concat(F.lit("\\Q"), term, F.lit("\\E"))
    explicit = F.rlike(evidence, F.concat(F.lit(r"(?is)\b"), quoted, F.lit(r"\b.{0,30}\b(?:means|defined as|refers to)\b")))
    given = explicit & (F.size(F.array_intersect(words, bare(evidence))) >= needed(F.size(words)))
    return F.coalesce(F.contains(F.lower(evidence), t) & F.when(must.isNotNull(), F.size(F.array_except(must, words)) == 0).otherwise(given), F.lit(False))


def person_supported(name: Column, evidence: Column) -> Column:
    """The name stands literally in evidence that speaks of a meeting with the management."""
    from quireloom.operators.passages import MANAGEMENT

    return F.coalesce((F.length(F.trim(name)) > 0) & F.contains(evidence, F.trim(name)) & evidence.rlike(f"(?is)(?:{MANAGEMENT})"), F.lit(False))


def supported_items(items: Column, evidence: Column, allowed: Column) -> Column:
    """The items that are allowed and whose words, underscores as blanks, stand in the evidence; in order, each once."""
    low = F.lower(evidence)
    return F.array_distinct(F.filter(items, lambda x: F.array_contains(allowed, x) & F.contains(low, F.lower(F.replace(x, F.lit("_"), F.lit(" "))))))
