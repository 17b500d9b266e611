"""Queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from quireloom.llm import boilerplate, bpe, confusables, names, packing, pii, spam


_P4 = r"""WITH s AS (SELECT document_id, block_id, text, lower(regexp_replace(regexp_extract(source_filename, '^[^_]*_(.+)_[^_]*$', 1), '[^\p{L}\p{N}]', '', 'g')) AS source FROM blocks),
l AS (SELECT DISTINCT document_id, block_id, source, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM s WHERE text IS NOT NULL),
k AS (SELECT *, regexp_replace(lower(trim(regexp_replace(line, '[\s\p{Z}]+', ' ', 'g'))), '[0-9]+', '0', 'g') AS canon FROM l),
n AS (SELECT source, count(DISTINCT document_id) AS n_all FROM s GROUP BY 1),
r AS (SELECT k.source, canon FROM k JOIN n USING (source) WHERE canon <> '' GROUP BY k.source, canon, n_all HAVING count(DISTINCT document_id) >= 3 AND count(DISTINCT document_id) * 10 >= 3 * n_all) """
P4_FOUND = _P4 + "SELECT DISTINCT block_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN r USING (source, canon)"
P4_CLEAN = _P4 + """SELECT document_id, block_id, CASE WHEN text IS NOT NULL THEN coalesce(t, '') END AS text FROM (SELECT DISTINCT document_id, block_id, text FROM blocks) b
LEFT JOIN (SELECT document_id, block_id, string_agg(line, chr(10) ORDER BY line_no) AS t FROM k WHERE (source, canon) NOT IN (SELECT (source, canon) FROM r) GROUP BY 1, 2) c USING (document_id, block_id)"""

_WIDE = "".join(chr(0xFF01 + i) for i in range(94))
_FULL = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
_SURE, _TO = "".join(confusables.SURE), "".join(confusables.SURE.values())
_WEAK, _WEAK_TO = "".join(confusables.WEAK), "".join(confusables.WEAK.values())
_FOREIGN = r"regexp_replace(regexp_replace({0}, '[{1}]', '', 'g'), '[\P{{L}}\p{{Latin}}]', '', 'g') = ''"  # no letter but Latin ones and those of {1}
P5_FOUND = rf"""WITH t AS (SELECT 'words' AS record_table, word_id AS record_id, text FROM words UNION SELECT 'queries', query_id, ticker FROM queries),
o AS (SELECT DISTINCT text, regexp_replace(regexp_replace(text, '[\x{{AD}}\x{{200B}}-\x{{200F}}\x{{2060}}-\x{{206F}}\x{{FEFF}}]', '', 'g'), '\p{{Zs}}', ' ', 'g') AS u FROM t WHERE regexp_matches(text, '[^ -~]')),
b AS (SELECT text, nfc_normalize(translate(replace(replace(replace(replace(replace(u, 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '{_WIDE}', '{_FULL}')) AS v FROM o),
c AS (SELECT *, {_FOREIGN.format("v", _SURE + "ї")} AS all_sure, {_FOREIGN.format("v", _SURE + _WEAK + "ї")} AS alike, string_split(v, ' ') AS ts FROM b),
k AS (SELECT text, all_sure, unnest(ts) AS token, unnest(range(len(ts))) AS i FROM c WHERE alike),
f AS (SELECT *, length(regexp_replace(token, '\P{{Latin}}', '', 'g')) AS latin, length(regexp_replace(token, '\P{{L}}', '', 'g')) AS letters, {_FOREIGN.format("token", _SURE + "ї")} AS sure, nfc_normalize(translate(token, '{_SURE}{_WEAK}ї', '{_TO}{_WEAK_TO}ï')) AS fixed FROM k),
w AS (SELECT DISTINCT lower(regexp_replace(x, '^\P{{L}}+|\P{{L}}+$', '', 'g')) AS word FROM (SELECT unnest(string_split_regex(text, '\s+')) AS x FROM (SELECT text FROM t UNION ALL SELECT text FROM blocks)) WHERE regexp_full_match(x, '[!-~\p{{Latin}}]+')),
r AS (SELECT text, i, CASE WHEN latin = 0 AND all_sure OR latin > 0 AND (sure OR 2 * latin > letters) AND word IS NOT NULL THEN fixed ELSE token END AS y FROM f LEFT JOIN w ON word = lower(regexp_replace(fixed, '^\P{{L}}+|\P{{L}}+$', '', 'g'))),
p AS (SELECT text, string_agg(y, ' ' ORDER BY i) AS plain FROM r GROUP BY text UNION ALL SELECT text, v FROM c WHERE NOT alike)
SELECT record_table, record_id, plain AS plain_text FROM t JOIN p USING (text) WHERE plain <> text"""


def queries() -> dict:
    return {"p3_found": names.p3_found, "p3_entities": names.p3_entities, "p4_found": boilerplate.p4_found, "p4_clean": boilerplate.p4_clean, "p5_found": confusables.p5_found, "p6_found": pii.p6_found, "p6_clean": pii.p6_clean, "p7_ids": bpe.p7_ids, "p8_containers": packing.p8_containers, "p8_fill": packing.p8_fill, "p8_invariants": packing.p8_invariants, "p9_found": spam.p9_found}


def oracle_sql() -> dict:
    p8 = "SELECT doc_id, coalesce(text, '') = '' AS empty, true AS whole, true AS fits FROM documents"
    return {"p8_invariants": p8, "p4_found": P4_FOUND, "p4_clean": P4_CLEAN, "p5_found": P5_FOUND}
