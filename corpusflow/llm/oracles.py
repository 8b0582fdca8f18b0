"""DuckDB SQL for those of the operators' queries that SQL can express."""

from __future__ import annotations

OP3 = """
WITH d AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
 k AS (SELECT h, max(page_id) AS keeper FROM d GROUP BY h),
 b AS (SELECT page_id, strlen(html) AS payload_bytes, keeper, list_transform(range(0, 8), lambda i: ('0x' || substring(h, 5 * i + 1, 5))::INTEGER) AS v FROM d JOIN k USING (h))
SELECT page_id, payload_bytes, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
 CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM b
"""

OP8 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 g AS (SELECT doc_id, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS three FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
 again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, three) AS n FROM g) WHERE n > 1),
 r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM again, (VALUES (0), (1), (2)) t(o) GROUP BY doc_id),
 l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
 m AS (SELECT doc_id, text, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines, greatest(1, coalesce(l.n, 0)) AS n_lines, coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
 b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 10 * n_symbols > 2 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_dup_lines > 4 * n_lines
  OR 2 * len(regexp_extract_all(text, '!![\x20\x09-\x0D]|!!\z')) > n_words OR 20 * len(list_distinct(w)) < least(n_words, 2000)) AS kept FROM b
"""

OP10 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
 u AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
 pair AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
 link AS (SELECT a, b FROM pair WHERE 100 * c >= 75 * (na + nb - c)),
 edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
 reach(doc_id, to_id) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.to_id)
SELECT s.doc_id, len(s.g) AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = s.doc_id
"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || doc_id) AS h FROM documents WHERE doc_id IS NOT NULL),
 k AS (SELECT *, len(w) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substring(h, i, 8))::BIGINT) AS v FROM d),
 c AS (SELECT *, least(v[1] % (n + 1), v[2] % (n + 1)) AS lo, greatest(v[1] % (n + 1), v[2] % (n + 1)) AS hi,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR v[3] % 100 >= 90 THEN 'plain' WHEN v[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
 p AS (SELECT *, array_to_string(w[1:lo], '') AS prefix, array_to_string(w[lo + 1:hi], '') AS middle, array_to_string(w[hi + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
 sha256(text) AS restored_sha256 FROM p
"""
