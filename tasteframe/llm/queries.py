"""The queries of this package, and the SQL that checks them."""

from __future__ import annotations

from tasteframe.llm import ann, bpe, html, jaccard, lines, lm, packing, quality, repair, ring, search, substrings, toxicity

QUERIES = {
    "op1_repeated_lines": lines.op1_repeated_lines,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_lattice_scores": lm.op3_lattice_scores,
    "op4_packing": packing.op4_packing,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_one_bit_codes": ann.op7_one_bit_codes,
    "op8_repeated_windows": substrings.op8_repeated_windows,
    "op9_html_text": html.op9_html_text,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_best_positions": search.op11_best_positions,
    "op12_bounded_ring": ring.op12_bounded_ring,
    "op13_role_repair": repair.op13_role_repair,
}

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_SPACE = "concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))"


def _windows(units: str, n: int) -> str:
    """Positions covered by windows of n units that also start earlier; units has doc_id, p from 1 and u."""
    following = ", ".join(f"lead(u, {i}) OVER w" for i in range(1, n))
    return f"""units AS ({units}),
keys AS (SELECT doc_id, p, [u, {following}] AS s, lead(p, {n - 1}) OVER w IS NOT NULL AS whole FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM keys WHERE whole) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p + d AS p FROM later CROSS JOIN (SELECT unnest(range({n})) AS d))"""


#: SQL for what it can express: the two removals of exact repeats, and the ranking.
ORACLE_SQL: dict[str, str] = {
    "op1_repeated_lines": f"""
WITH every AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS q, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
marked AS (SELECT *, trim(line, {_SPACE}) AS u, sum(CASE WHEN trim(line, {_SPACE}) != '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY q) AS p FROM every),
{_windows("SELECT doc_id, CAST(p AS BIGINT) AS p, u FROM marked WHERE u != ''", 3)}
SELECT m.doc_id, count(*) FILTER (WHERE u != '') AS n_lines, count(*) FILTER (WHERE u != '' AND g.p IS NOT NULL) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY q) FILTER (WHERE u = '' OR g.p IS NULL), '')) AS kept_sha256
FROM marked m LEFT JOIN gone g ON g.doc_id = m.doc_id AND g.p = m.p GROUP BY 1""",
    "op8_repeated_windows": f"""
WITH words AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS l FROM documents),
{_windows("SELECT doc_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS u FROM words", 20)},
kept AS (SELECT u.doc_id, count(g.p) AS n_removed, string_agg(u, ' ' ORDER BY u.p) FILTER (WHERE g.p IS NULL) AS t FROM units u LEFT JOIN gone g ON g.doc_id = u.doc_id AND g.p = u.p GROUP BY 1)
SELECT w.doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id""",
    "op11_best_positions": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS l FROM documents),
sized AS (SELECT r, doc_id, len(l) AS n, count(*) OVER () AS total, CAST(sum(len(l)) OVER () AS BIGINT) AS length FROM docs WHERE len(l) > 0),
held AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(l) AS t FROM docs) GROUP BY 1, 2),
wanted AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY 1, 2),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * (SELECT max(total) FROM sized) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held GROUP BY 1),
scored AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * total) // length)))) AS BIGINT) AS score
  FROM wanted JOIN held USING (t) JOIN weights USING (t) JOIN sized USING (r) GROUP BY 1, 2, 3)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scored WHERE score > 0) WHERE rank <= 10""",
}
