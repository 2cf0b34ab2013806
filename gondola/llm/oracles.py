"""DuckDB twins of the queries that SQL can express on whole tables."""

_OP5 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS l FROM d),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS c FROM pos),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) AS v(k) WHERE c >= 2 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, coalesce(p.n, 0) AS n_repeat_words,
    length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals
  FROM w LEFT JOIN p USING (doc_id)),
n AS (SELECT *, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines FROM m),
f AS (
  SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (10 * n_dup_lines > 3 * n_lines)::INT + 16 * (word_chars < 3 * n_words)::INT + 32 * (word_chars > 14 * n_words)::INT
    + 64 * (2 * n_capitals > word_chars)::INT AS fail_mask FROM n)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (fail_mask & 3) <> 0 AS base_failed, fail_mask = 0 AS kept,
  n_lines::BIGINT AS n_lines, n_capitals::BIGINT AS n_capitals, fail_mask::BIGINT AS fail_mask
FROM f
"""

_OP4 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bp AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0),
ph AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS p FROM bp),
lens AS (SELECT DISTINCT n FROM ph),
dp AS (SELECT doc_id, lens.n, w, unnest(range(1, len(w) - lens.n + 2)) AS i FROM dw, lens WHERE len(w) >= lens.n),
ds AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS p FROM dp),
hit AS (SELECT doc_id, i, ds.n, item_id FROM ds JOIN ph ON ds.n = ph.n AND ds.p = ph.p),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLES = {"op4_fm_decontamination": _OP4, "op5_rule_ledger": _OP5}
