"""Query p1: amounts of revisions and parsed values in the common unit of their metric."""

from __future__ import annotations


from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.operators import units as U
from quireloom.session import cut, table

# A figure is one number with what stands around it, up to the next clause.
_FIGURE = rf"([^\d\n]*?(?:'000[^\d\n]*?)?{U.NUMBER}(?:[^\d\n]*?'000)?[^\d\n]*?)"
_END = r"(?=\s+on new inputs|\s+by\s|[,;](?:\s|$)|\.(?:\s|$)|\s*$)"
FROM_TO, TO_FROM = rf"(?i)\bfrom\s+{_FIGURE}\s+to\s+{_FIGURE}{_END}", rf"(?i)\bto\s+{_FIGURE}\s+from\s+{_FIGURE}{_END}"

MATCH = 1e-6  # log residual up to which a sentence's figures are those of a revision
AGREE = 0.005  # and up to which a cell's figure can be its value (printed figures are rounded)


def unit_table(texts: list[Column | DataFrame]) -> DataFrame:
    """(unit_text, u): each distinct text is read once."""
    every = reduce(DataFrame.unionByName, texts).where(F.col("unit_text").isNotNull()).distinct()
    return cut(every.withColumn("u", U.unit_of(F.col("unit_text"))))


def with_units(df: DataFrame, units: DataFrame, **names: str) -> DataFrame:
    """df with the unit read from each text column: name=column."""
    for name, c in names.items():
        df = df.join(units.select(F.col("unit_text").alias(c), F.col("u").alias(name)), c, "left")
    return df


def _texts(df: DataFrame, *columns: str) -> list[DataFrame]:
    return [df.select(F.col(c).alias("unit_text")) for c in columns]


def _told(u: str) -> Column:
    return F.coalesce(F.col(u)["cur"].isNotNull() | F.col(u)["scale"].isNotNull() | F.col(u)["ratio"].isNotNull(), F.lit(False))


def _completed(first: str, second: str) -> Column:
    """first's unit; scale and ratio from second if first states nothing, the currency too if it states none."""
    got = lambda c: F.when(_told(first), F.col(first)[c]).otherwise(F.col(second)[c])
    money = lambda c: F.when(F.col(first)["cur"].isNotNull(), F.col(first)[c]).otherwise(F.col(second)[c])
    return F.struct(money("cur").alias("cur"), money("part").alias("part"), got("scale").alias("scale"), got("ratio").alias("ratio"))


def _reading(u: Column, old: Column, new: Column) -> Column:
    return F.struct(u["cur"].alias("cur"), U.milli_factor(u, F.col("quantity")).alias("factor"), old.cast("double").alias("old"), new.cast("double").alias("new"))


def _with_metric(df: DataFrame, metric_units: DataFrame) -> DataFrame:
    """df with the quantity and common unit of its metric, null if it isn't listed."""
    return df.join(metric_units.groupBy("metric").agg(F.first("quantity").alias("quantity"), F.first("common_unit").alias("common_form")), "metric", "left")


def parsed_readings(values: DataFrame, metric_units: DataFrame) -> DataFrame:
    """Per parsed value: own (what its unit says) and readings, what its cell and header print."""
    v = values.where(F.col("value").isNotNull()).withColumns({"cell": U.around_number(F.col("raw_text")), "head": U.after_title(F.col("header_text")), "figure": U.number_in(F.col("raw_text"))})
    v = with_units(v, unit_table(_texts(v, "unit", "cell", "head")), own="unit", in_cell="cell", in_head="head")
    v = _with_metric(v, metric_units).withColumn("printed", _completed("in_cell", "in_head"))
    printed = _reading(F.col("printed"), F.lit(None), F.col("figure"))
    return v.select("value_id", "quantity", "common_form", "unit", "own", F.lit(None).cast("decimal(20,6)").alias("old"), F.col("value").alias("new"), F.lit(None).cast("decimal(20,4)").alias("change_pp"), F.array(printed).alias("readings"))


def printed_figures(blocks: DataFrame) -> DataFrame:
    """(document_id, block_id, no, old_unit, new_unit, old, new): the pairs of figures that a block's lines print."""
    b = blocks.where(F.col("text").rlike(r"(?i)\bfrom\b")).select("document_id", "block_id", "text").distinct()
    x = b.select("document_id", "block_id", F.posexplode(F.split("text", r"\n")).alias("no", "line"))
    pair = lambda k, p, a, b: F.struct(F.lit(k).alias("k"), F.regexp_extract("line", p, a).alias("o"), F.regexp_extract("line", p, b).alias("n"))
    x = x.withColumn("f", F.explode(F.array(pair(0, FROM_TO, 1, 2), pair(1, TO_FROM, 2, 1)))).where(F.length("f.n") > 0)
    return x.select("document_id", "block_id", (F.col("no") * 2 + F.col("f.k")).alias("no"), U.around_number(F.col("f.o")).alias("old_text"), U.around_number(F.col("f.n")).alias("new_text"), U.number_in(F.col("f.o")).alias("p_old"), U.number_in(F.col("f.n")).alias("p_new"))


def revision_readings(revisions: DataFrame, blocks: DataFrame, metric_units: DataFrame) -> DataFrame:
    """Per revision: own and readings, the figures of its sentences in all cited blocks; only what own leaves open is looked up."""
    r = _with_metric(revisions.where(F.col("old_value").isNotNull() | F.col("new_value").isNotNull()), metric_units)
    r = r.withColumnsRenamed({"old_value": "old", "new_value": "new", "calculated_change_pp": "change_pp"})
    figures = cut(printed_figures(blocks))
    units = unit_table([*_texts(r, "unit"), *_texts(figures, "old_text", "new_text")])
    r = cut(with_units(r, units, own="unit"))
    closed = F.coalesce(F.col("own.ratio").isNotNull() | F.col("own.cur").isNotNull(), F.lit(False))
    cited = F.explode(F.array_distinct(F.flatten(F.transform("evidence", lambda e: F.coalesce(e["block_ids"], F.array().cast("array<string>"))))))
    todo = r.where(~closed).select("revision_id", "document_id", "quantity", cited.alias("block_id")).distinct()
    seen = with_units(todo.join(figures, ["document_id", "block_id"]), units, u_old="old_text", u_new="new_text").withColumn("printed", _completed("u_old", "u_new"))
    seen = seen.where(_told("printed")).withColumn("reading", _reading(F.col("printed"), F.col("p_old"), F.col("p_new")))
    # The sentences of the blocks that one revision cites.
    per = seen.groupBy("revision_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "no", "reading"))), lambda x: x["reading"]).alias("readings"))
    return r.join(per, "revision_id", "left").select("revision_id", "quantity", "common_form", "unit", "own", "old", "new", "change_pp", "readings")


def chosen(readings: DataFrame, match: float, printed_as_it_is: bool) -> DataFrame:
    """readings with cur, factor (the amount x 1000 of one recorded unit) and the flags checked, consistent and unique.

    What own states is fixed; open scales, parts of a currency unit and kinds of
    ratio are all candidates, and a currency is that of a reading. Identities:
    recorded value x factor = printed figure x its factor, for the old and the
    new value; and (new - old) x factor = the recorded change in percentage
    points x 1000. checked: some identity could be evaluated. printed_as_it_is:
    a reading that contradicts all candidates still states the unit.
    """
    told = F.coalesce(F.col("own.scale").isNotNull() | F.col("own.cur").isNotNull(), F.lit(False))
    closed = F.coalesce(F.col("own.ratio").isNotNull() | F.col("own.cur").isNotNull(), F.lit(False))
    own = U.milli_factor(F.col("own"), F.col("quantity"))
    blank = F.array(F.struct(F.lit(None).cast("string").alias("cur"), F.lit(None).cast("decimal(24,5)").alias("factor"), F.lit(None).cast("double").alias("old"), F.lit(None).cast("double").alias("new")))
    usable = F.filter("readings", lambda e: e["factor"].isNotNull())
    x = U.once(readings, "x", F.struct(
        F.when(closed, F.array(own)).otherwise(U.candidate_factors(F.col("quantity"), F.col("own.scale"), told)).alias("factors"),
        F.when(F.size(usable) > 0, usable).when(closed, blank).alias("readings"),
    ))

    def residual(p: dict[str, Column]) -> Column:
        f, e = p["factor"].cast("double"), p["reading"]
        at = e["factor"].cast("double")
        parts = [U.log_gap(F.col("old").cast("double") * f, e["old"] * at), U.log_gap(F.col("new").cast("double") * f, e["new"] * at), F.when(F.col("quantity") == "ratio", U.log_gap((F.col("new") - F.col("old")).cast("double") * f, F.col("change_pp").cast("double") * 1000))]
        return F.when(F.coalesce(*parts).isNotNull(), reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in parts]))

    far = lambda p: F.abs(F.log(p["factor"].cast("double")) - F.log(p["reading"]["factor"].cast("double")))
    cur = lambda p: F.when(closed, F.col("own.cur")).otherwise(p["reading"]["cur"])
    choice = U.choose_by_identities({"factor": F.col("x.factors"), "reading": F.col("x.readings")}, residual, match, far, lambda p: F.struct(p["factor"].alias("f"), cur(p).alias("c")))
    y = U.once(x, "c", choice)
    r = F.col("c.residual")
    checked, consistent = F.coalesce(r < float("inf"), F.lit(False)), F.coalesce(r <= match, F.lit(False))
    sure = closed | consistent | F.lit(printed_as_it_is)
    return y.withColumns({
        "factor": F.when(sure, F.col("c.pick_factor")), "cur": F.when(closed, F.col("own.cur")).otherwise(F.col("c.pick_reading.cur")),
        "checked": checked, "consistent": F.when(checked, consistent), "unique": F.col("c.n_best") == 1,
    }).drop("x", "c", "readings")


def amounts(spark: SparkSession, d: str) -> DataFrame:
    """One row per revision or parsed value with a value: its unit's factor (null if stated nowhere) and flags."""
    mu = table(spark, d, "metric_units")
    pv = table(spark, d, "parsed_values").select("value_id", "metric", "raw_text", "header_text", "value", "unit").distinct()
    rv = table(spark, d, "revisions").select("revision_id", "document_id", "metric", "old_value", "new_value", "unit", "calculated_change_pp", "evidence").distinct()
    field = lambda f, c: F.struct(F.lit(f).alias("field"), F.col(c).alias("v"))
    cols = ["fields", "unit", "quantity", "common_form", "cur", "factor", "checked", "consistent", "unique"]
    a = chosen(parsed_readings(pv, mu), AGREE, True).withColumn("fields", F.array(field("value", "new"))).select(F.lit("parsed_values").alias("record_table"), F.col("value_id").alias("record_id"), *cols)
    b = chosen(revision_readings(rv, table(spark, d, "blocks"), mu), MATCH, False).withColumn("fields", F.array(field("old_value", "old"), field("new_value", "new")))
    return a.unionByName(b.select(F.lit("revisions").alias("record_table"), F.col("revision_id").alias("record_id"), *cols))


def _common(a: DataFrame) -> DataFrame:
    form = F.col("common_form")
    return a.withColumn("common_unit", F.when(form.contains("CUR"), F.replace(form, F.lit("CUR"), F.col("cur"))).otherwise(form))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """See TESTDATA.md. Values without a stated or readable unit, or of an unknown metric, give no row (p1_flags counts them); null values give no row."""
    a = _common(amounts(spark, d)).where(F.col("common_unit").isNotNull() & F.col("factor").isNotNull() & ~F.col("unit").eqNullSafe(F.col("common_unit")))
    x = a.select("record_table", "record_id", "common_unit", "factor", F.explode("fields").alias("f")).where(F.col("f.v").isNotNull())
    milli = F.round(F.col("f.v").cast("decimal(20,6)") * F.col("factor")).cast("bigint")
    return x.select("record_table", "record_id", F.col("f.field").alias("field"), "common_unit", milli.alias("amount_milli")).distinct()


def p1_flags(spark: SparkSession, d: str) -> DataFrame:
    """(record_table, outcome, n_records): how each record's unit was settled.

    unknown_metric, no_unit; of the others contradicted (an identity fails with
    the unit), not_unique (several solutions fit as well), unchecked (no identity
    could be evaluated) or consistent.
    """
    a = _common(amounts(spark, d))
    outcome = (
        F.when(F.col("quantity").isNull(), "unknown_metric").when(F.col("factor").isNull() | F.col("common_unit").isNull(), "no_unit").when(~F.col("unique"), "not_unique")
        .when(~F.col("checked"), "unchecked").when(F.col("consistent"), "consistent").otherwise("contradicted")
    )
    return a.groupBy("record_table", outcome.alias("outcome")).agg(F.countDistinct("record_id").alias("n_records"))


def queries() -> dict:
    return {"p1_found": p1_found, "p1_flags": p1_flags}




def _quoted(xs: list[str]) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


def _cases(groups: dict[str, list[str]], x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} IN {_quoted(v)} THEN {k}" for k, v in groups.items()) + " END"


def oracle_sql() -> dict:
    """p1_found by a table of all unit texts, parsed once in stages, and equality of figures instead of log residuals."""
    cur = "(" + "|".join(U.CODES) + "|€|[$]|£|¥)"
    num = r"\(?[-−+]?[0-9][0-9,]*(?:\.[0-9]+)?\)?"
    cell = lambda x: f"regexp_replace(replace({x}, '''000', ' thousand '), '{num}', ' ', 'g')"
    head = r"regexp_replace(trim(regexp_replace(header_text, '^.*,\s*', '')), '(?i)^\(?\s*(?:all )?(?:figures|values|amounts|numbers|units?|currency)?\s*(?:are\s+)?(?:in\b|:)?\s*', '')"
    figure = lambda x: f"(CASE WHEN regexp_matches(regexp_extract(replace({x}, '''000', ' '), '{num}'), '[(−-]') THEN -1 ELSE 1 END * TRY_CAST(regexp_replace(regexp_extract(replace({x}, '''000', ' '), '{num}'), '[(),+−-]', '', 'g') AS DECIMAL(30,6)))"
    ends = r"(?:\s+on new inputs|\s+by\s|[,;](?:\s|$)|\.(?:\s|$)|\s*$)"
    ft, tf = rf"(?i)\bfrom\s+(.+?)\s+to\s+(.+?){ends}", rf"(?i)\bto\s+(.+?)\s+from\s+(.+?){ends}"
    symbols = " ".join(f"WHEN rc = '{k}' THEN '{v}'" for k, v in U.SYMBOLS.items())
    told = lambda a: f"({a}.cur IS NOT NULL OR {a}.scale IS NOT NULL OR {a}.ratio IS NOT NULL)"
    first = lambda f, *ts: "CASE " + " ".join(f"WHEN {told(t)} THEN {t}.{f}" for t in ts) + " END"
    money = lambda f, *ts: "CASE " + " ".join(f"WHEN {t}.cur IS NOT NULL THEN {t}.{f}" for t in ts) + " END"
    done = lambda *ts: f"{money('cur', *ts)} AS cur, {money('part', *ts)} AS part, {first('scale', *ts)} AS scale, {first('ratio', *ts)} AS ratio"
    pack = lambda t: f"{{'cur': {t}.cur, 'part': {t}.part, 'scale': {t}.scale, 'ratio': {t}.ratio}}"
    return {"p1_found": rf"""WITH pv AS (SELECT DISTINCT value_id, metric, value, unit, {cell('raw_text')} AS raw, {head} AS head FROM parsed_values WHERE value IS NOT NULL),
rv AS (SELECT DISTINCT revision_id, document_id, metric, old_value, new_value, unit, unnest(evidence).block_ids AS ids FROM revisions),
ln AS (SELECT DISTINCT document_id, block_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM (SELECT DISTINCT document_id, block_id, text FROM blocks WHERE regexp_matches(text, '(?i)\bfrom\b'))),
pr AS (SELECT document_id, block_id, 2 * n AS n, regexp_extract(line, '{ft}', 1) AS o, regexp_extract(line, '{ft}', 2) AS w FROM ln UNION ALL SELECT document_id, block_id, 2 * n + 1, regexp_extract(line, '{tf}', 2), regexp_extract(line, '{tf}', 1) FROM ln),
px AS (SELECT *, {cell('o')} AS ou, {cell('w')} AS wu, {figure('o')} AS po, {figure('w')} AS pw FROM pr WHERE w <> ''),
tx AS (SELECT DISTINCT x FROM (SELECT unit AS x FROM pv UNION SELECT raw FROM pv UNION SELECT head FROM pv UNION SELECT unit FROM rv UNION SELECT ou FROM px UNION SELECT wu FROM px) WHERE x IS NOT NULL),
t1 AS (SELECT x, trim(regexp_replace(trim(regexp_replace(x, '[()\s]+', ' ', 'g')), '(?i)\s*(?:/\s*share|per[ _]share)\s*$', '')) AS t FROM tx),
t2 AS (SELECT x, t, regexp_extract(t, '{cur}', 1) AS rc, trim(regexp_replace(trim(regexp_replace(t, '{cur}', ' ', 'g')), '[.]$', '')) AS rest, regexp_matches(t, '^(?:{cur}c|(?:US|EUR|USD|CHF|SEK|euro|Euro|{'|'.join(U.CODES)}) ?c(?:ents?)?)$') AS cent, t IN {_quoted(U.PENCE)} AS pence FROM t1),
t3 AS (SELECT *, {_cases(U.SCALES, 'rest')} AS sc, {_cases(U.RATIOS, 'lower(t)')} AS ratio FROM t2),
u AS (SELECT x, CASE WHEN pence THEN 'GBP' WHEN cent THEN CASE WHEN starts_with(t, 'US') THEN 'USD' WHEN regexp_matches(t, '(?i)^eur') THEN 'EUR' ELSE left(t, 3) END WHEN rest = '' OR sc IS NOT NULL THEN CASE {symbols} WHEN rc <> '' THEN rc END END AS cur, CASE WHEN pence OR cent THEN 0.01 WHEN rest = '' OR sc IS NOT NULL THEN CASE WHEN rc <> '' THEN 1 END END AS part, CASE WHEN NOT pence AND NOT cent THEN sc END AS scale, ratio FROM t3),
a AS (SELECT 'parsed_values' AS record_table, value_id AS record_id, metric, unit, [struct_pack(f := 'value', v := value)] AS fs, {done('b', 'c', 'd')} FROM pv LEFT JOIN u b ON b.x = pv.unit LEFT JOIN u c ON c.x = pv.raw LEFT JOIN u d ON d.x = pv.head),
r1 AS (SELECT rv.*, b.cur, b.part, b.scale, b.ratio FROM rv LEFT JOIN u b ON b.x = rv.unit),
r2 AS (SELECT DISTINCT ON (revision_id) revision_id, metric, unit, old_value, new_value, {done('g', 'h', 'i')} FROM (SELECT revision_id, metric, r1.unit, old_value, new_value, {pack('r1')} AS g, {pack('c')} AS h, {pack('e')} AS i, px.n
 FROM r1 JOIN px ON px.document_id = r1.document_id AND list_contains(r1.ids, px.block_id) LEFT JOIN u c ON c.x = px.ou LEFT JOIN u e ON e.x = px.wu WHERE r1.cur IS NULL AND r1.ratio IS NULL AND (r1.old_value IS NULL OR po = r1.old_value) AND (r1.new_value IS NULL OR pw = r1.new_value)) ORDER BY revision_id, n),
rr AS (SELECT revision_id, metric, unit, old_value, new_value, cur, part, scale, ratio FROM r1 WHERE cur IS NOT NULL OR ratio IS NOT NULL UNION ALL SELECT * FROM r2),
z AS (SELECT * FROM a UNION ALL SELECT 'revisions', revision_id, metric, unit, [struct_pack(f := 'old_value', v := old_value), struct_pack(f := 'new_value', v := new_value)], cur, part, scale, ratio FROM rr),
k AS (SELECT record_table, record_id, unit, unnest(fs) AS f, CASE WHEN contains(common_unit, 'CUR') THEN replace(common_unit, 'CUR', cur) ELSE common_unit END AS common, CASE quantity WHEN 'money' THEN coalesce(scale, 1) * part / 1000 WHEN 'ratio' THEN ratio * 1000 ELSE coalesce(scale, 1) * part * 1000 END AS factor FROM z JOIN metric_units USING (metric))
SELECT DISTINCT record_table, record_id, f.f AS field, common AS common_unit, CAST(round(f.v * CAST(factor AS DECIMAL(16,3))) AS BIGINT) AS amount_milli FROM k WHERE f.v IS NOT NULL AND common IS NOT NULL AND factor IS NOT NULL AND (unit IS NULL OR unit <> common)"""}
