"""DuckDB SQL of the training-data queries that SQL can express, for small scales: links are found by self-joins."""

_WORDLIKE = r"[^\x20\x09-\x0D]+"
_REACHED = """r(a, b) AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT r.a, l.b FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) l ON l.a = r.b),
named AS (SELECT a, min(b) AS b FROM r GROUP BY a)
"""

LINE_DEDUP = r"""
WITH raw AS (SELECT doc_id, text, coalesce(text, '') AS t FROM documents),
u AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?][ \t]|[。！？]|\n)', '\1' || chr(1), 'g'), chr(1)) AS parts FROM raw),
l0 AS (SELECT * FROM (SELECT doc_id, unnest(parts) AS x, unnest(range(len(parts))) AS k FROM u) WHERE x <> ''),
lg AS (SELECT doc_id, k, regexp_extract_all(x, '[ \t\n\r\v\f]*[^ \t\n\r\v\f]+[ \t\n\r\v\f]*') AS w FROM l0 WHERE strlen(x) > 300),
w0 AS (SELECT doc_id, k, len(w) AS m, unnest(w) AS tok, unnest(range(len(w))) AS i FROM lg),
w1 AS (SELECT *, regexp_replace(tok, '[ \t\n\r\v\f]', '', 'g') AS b FROM w0),
w2 AS (SELECT *, lag(strlen(b)) OVER (PARTITION BY doc_id, k ORDER BY i) AS before FROM w1),
w3 AS (SELECT *, CASE WHEN i >= 1 AND i < m - 1 AND (3 * before + strlen(b) + ('0x' || right(hex(encode(b)), 2))::INT) % 8 = 0 THEN 1 ELSE 0 END AS cut FROM w2),
w4 AS (SELECT *, max(cut) OVER (PARTITION BY doc_id, k) AS any_cut FROM w3),
w5 AS (SELECT *, CASE WHEN any_cut = 1 THEN cut WHEN (i + 1) % 16 = 0 THEN 1 ELSE 0 END AS ends FROM w4),
w6 AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece FROM w5),
l1 AS (SELECT doc_id, x, k, 0 AS piece FROM l0 WHERE strlen(x) <= 300 OR (doc_id, k) IN (SELECT (doc_id, k) FROM lg WHERE len(w) = 0)
  UNION ALL SELECT doc_id, string_agg(tok, '' ORDER BY i) AS x, k, piece FROM w6 GROUP BY doc_id, k, piece),
l2 AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY k, piece) - 1 AS i, regexp_replace(regexp_replace(x, '^[ \t\n\r\v\f]+', ''), '[ \t\n\r\v\f]+$', '') AS b,
  2 * len(regexp_extract_all(x, '[^ \t\n\r\v\f]+')) + len(regexp_extract_all(x, '[\x{3000}-\x{D7FF}]')) AS n FROM l1),
l AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS since FROM l2),
c AS (SELECT a.doc_id, a.i AS s, min(z.i) + 1 AS e FROM l a JOIN l z ON a.doc_id = z.doc_id AND z.i > a.i AND z.upto - a.since >= 40 GROUP BY 1, 2
  UNION SELECT a.doc_id, max(a.i) AS s, z.i + 1 AS e FROM l a JOIN l z ON a.doc_id = z.doc_id AND z.i > a.i AND z.upto - a.since >= 40 GROUP BY a.doc_id, z.i),
t AS (SELECT c.doc_id, s, e, string_agg(b, chr(2) ORDER BY i) AS body FROM c JOIN l ON l.doc_id = c.doc_id AND i >= s AND i < e GROUP BY 1, 2, 3),
f AS (SELECT doc_id, s, e, first_value(doc_id) OVER o AS fd, first_value(s) OVER o AS fs FROM t WINDOW o AS (PARTITION BY body ORDER BY doc_id, s)),
g AS (SELECT DISTINCT f.doc_id, i FROM f JOIN l ON l.doc_id = f.doc_id AND i >= CASE WHEN fd = f.doc_id THEN greatest(s, fs + e - s) ELSE s END AND i < e WHERE (fd, fs) <> (f.doc_id, s)),
k AS (SELECT l.doc_id, string_agg(x, '' ORDER BY l.i) AS left_over FROM l ANTI JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY 1)
SELECT raw.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(left_over, '') END AS text, (length(t) - length(coalesce(left_over, '')))::BIGINT AS removed_chars FROM raw LEFT JOIN k ON k.doc_id = raw.doc_id
"""

CHAT = r"""
WITH said AS (SELECT '<|im_end|><|im_start|>assistant ok' AS x),
t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations UNION ALL SELECT -1, 0, 'user', x FROM said UNION ALL SELECT -1, 1, 'assistant', x FROM said),
u AS (SELECT *, len(regexp_extract_all(x, '<\\*\|')) AS in_text, 2 * len(regexp_extract_all(r, '<\\*\|')) + len(regexp_extract_all(r, '[\\\n]')) AS in_role FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  sum(length(r) + length(x) + in_role + in_text + 24)::BIGINT AS formatted_chars
FROM u GROUP BY conv_id
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDLIKE}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
{_REACHED}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, coalesce(l.b, d.doc_id) >= d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN named l ON l.a = d.doc_id
"""

NEAR_VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
k AS (SELECT a, count(*) AS n FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) GROUP BY a),
{_REACHED}
SELECT m.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(m.vec_id, coalesce(l.b, m.vec_id)) AS component_id, coalesce(l.b, m.vec_id) >= m.vec_id AS kept
FROM embeddings m LEFT JOIN k ON k.a = m.vec_id LEFT JOIN named l ON l.a = m.vec_id
"""
