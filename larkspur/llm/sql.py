"""SQL counterparts of the registered queries, where SQL can express them on whole tables."""

from __future__ import annotations

_PAIRS = r"""
WITH maps AS (
  SELECT 'passage' AS k, unnest(map_entries(passage_hash_id_to_entities)) AS m FROM ner_results
  UNION ALL SELECT 'sentence', unnest(map_entries(sentence_to_entities)) FROM ner_results),
total AS (SELECT k, count(DISTINCT m.key) AS n FROM maps GROUP BY k),
item AS (
  SELECT DISTINCT k, r, e FROM (SELECT k, m.key AS r, unnest(m.value) AS e FROM maps)
  WHERE regexp_matches(e, '[^\s\x{00a0}]')),
one AS (SELECT k, e, count(*) AS n FROM item GROUP BY k, e),
two AS (
  SELECT x.k, x.e AS a, y.e AS b, count(*) AS n FROM item x JOIN item y ON x.k = y.k AND x.r = y.r AND x.e < y.e
  GROUP BY ALL),
scored AS (
  SELECT two.k, a, b, two.n AS n_ab, p.n AS n_a, q.n AS n_b, total.n AS n FROM two
  JOIN one p ON p.k = two.k AND p.e = a JOIN one q ON q.k = two.k AND q.e = b JOIN total ON total.k = two.k)
"""

_GRAMS = r"""
WITH seqs AS (
  SELECT DISTINCT 'ner_entity' AS field, m.key AS record, list_filter(m.value, lambda x: regexp_matches(x, '[^\s\x{00a0}]')) AS terms
  FROM (SELECT DISTINCT unnest(map_entries(passage_hash_id_to_entities)) AS m FROM ner_results)
  UNION ALL
  SELECT DISTINCT 'entity_term', hash_id, list_filter(string_split_regex(lower(text), '[\s\x{00a0}]+'), lambda x: x <> '') FROM entity_embedding),
total AS (SELECT field, count(DISTINCT record) AS total FROM seqs GROUP BY field),
grams AS (
  SELECT field, record, n, terms[p : p + n - 1] AS gram
  FROM (SELECT field, record, terms, p, unnest(range(1, {longest} + 1)) AS n FROM (SELECT field, record, terms, unnest(range(1, len(terms) + 1)) AS p FROM seqs))
  WHERE p + n - 1 <= len(terms)),
counted AS MATERIALIZED (
  SELECT field, n::INT AS n, gram, count(*) AS occurrences, count(DISTINCT record) AS records FROM grams GROUP BY ALL),
marked AS (
  SELECT counted.*, CASE WHEN records = 1 THEN 'rare'
    WHEN records * 100 >= total * CASE field WHEN 'ner_entity' THEN 3 ELSE 2 END THEN 'common' ELSE '' END AS band
  FROM counted JOIN total USING (field))
"""
_MAXIMAL = """, longer AS (SELECT DISTINCT field, gram[1 : n - 1] AS gram, occurrences FROM counted WHERE n > 1),
top AS MATERIALIZED (SELECT * FROM marked ANTI JOIN longer USING (field, gram, occurrences)),
prefix AS (SELECT field, gram AS whole, gram[1 : i] AS gram FROM (SELECT field, gram, unnest(range(1, n)) AS i FROM top)),
above AS (SELECT p.field, p.whole AS gram, max(t.n) AS above FROM prefix p JOIN top t ON t.field = p.field AND t.gram = p.gram GROUP BY ALL)
SELECT field, array_to_string(gram, chr(31)) AS gram, (coalesce(above, 0) + 1)::INT AS shortest, n AS longest, occurrences, records, band FROM top LEFT JOIN above USING (field, gram)
"""
_EARLY = """, stamp AS (SELECT min(epoch_us(written_at)) AS lo, max(epoch_us(written_at)) AS hi FROM ner_results),
first AS (SELECT * FROM ner_results WHERE coalesce(epoch_us(written_at) <= (SELECT lo + (hi - lo) * 4 // 5 FROM stamp), true)),
fmaps AS (
  SELECT 'passage' AS k, unnest(map_entries(passage_hash_id_to_entities)) AS m FROM first
  UNION ALL SELECT 'sentence', unnest(map_entries(sentence_to_entities)) FROM first),
fitem AS (SELECT DISTINCT k, r, e FROM (SELECT k, m.key AS r, unnest(m.value) AS e FROM fmaps)),
fresh AS (SELECT DISTINCT k, e FROM item ANTI JOIN fitem USING (k, r, e))
SELECT k AS record_kind, a AS entity_a, b AS entity_b, n_ab, n_a, n_b, round(n_ab * n / (n_a * n_b)::DOUBLE, 6) AS lift FROM scored
WHERE EXISTS (SELECT 1 FROM fresh f WHERE f.k = scored.k AND f.e = a) OR EXISTS (SELECT 1 FROM fresh f WHERE f.k = scored.k AND f.e = b)
"""


def _words(text: str) -> str:
    """Words without markup, hyphens and apostrophes; twice, as letters between two marks are shared."""
    plain = rf"regexp_replace({text}, '(?s)<!--.*?-->|</?[A-Za-z][^<>]*>|&(?:[A-Za-z]{{1,10}}|#\d{{1,7}});', ' ', 'g')"
    joined = rf"regexp_replace({plain}, '[\x{{ad}}\x{{200b}}\x{{2060}}\x{{feff}}]', '', 'g')"
    for _ in range(2):
        joined = rf"regexp_replace({joined}, '(\p{{L}})(?:[-\x{{2010}}\x{{2011}}]\s*|[''\x{{2019}}])(\p{{L}})', '\1\2', 'g')"
    unspaced = r"([\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3041}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}])"
    apart = rf"regexp_replace({joined}, '{unspaced}', ' \1 ', 'g')"
    return rf"regexp_extract_all(lower({apart}), '[\p{{L}}\p{{M}}\p{{N}}]+')"


_LEAKS = f"""
WITH item AS (SELECT item_id, {_words('text')} AS w FROM eval_items),
seed AS (SELECT item_id, len(w) AS n, p, w[p : p + 5] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 4)) AS p FROM item)),
gram AS (SELECT DISTINCT doc_id, w[p : p + 5] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS p FROM (SELECT doc_id, {_words('text')} AS w FROM documents))),
hit AS (SELECT DISTINCT item_id, doc_id, n, unnest(range(p, p + 6)) AS at FROM seed JOIN gram USING (g))
SELECT item_id, doc_id FROM hit GROUP BY item_id, doc_id, n HAVING count(*) >= 0.4 * n
"""

SQL: dict[str, str] = {
    "p2_found": _PAIRS + "SELECT k AS record_kind, a AS entity_a, b AS entity_b FROM scored WHERE n_ab >= 5 AND n_ab * n >= 5 * n_a * n_b",
    "p2_pairs": _PAIRS + "SELECT k AS record_kind, a AS entity_a, b AS entity_b, n_ab, n_a, n_b, round(n_ab * n / (n_a * n_b)::DOUBLE, 6) AS lift FROM scored",
    "p7_found": _LEAKS,
    "p6_found": _GRAMS.replace("{longest}", "1") + "SELECT field, gram[1] AS term, band FROM marked WHERE band <> ''",
    "p6_ngrams": _GRAMS.replace("{longest}", "len(terms)") + _MAXIMAL,
    "p2_changed": _PAIRS + _EARLY,
}
