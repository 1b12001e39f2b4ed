"""DuckDB SQL with the rows of the training-data queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

SOURCE_MIX = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size FROM documents),
k AS (SELECT *, ('0x' || substr(md5(concat_ws(':', '42', doc_id::VARCHAR, size::VARCHAR)), 1, 13))::BIGINT AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, (2.0::DOUBLE * source_size) / weight AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level_here
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level_here, ratio) AS level FROM l WHERE level_here <= ratio),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM l LEFT JOIN v ON true),
p AS (SELECT k.doc_id, k.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS passes,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 3) AS target,
  (passes * size + greatest(0, least(size, floor(target - passes * source_size)::BIGINT - before)))::BIGINT AS taken FROM p
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS grams FROM w),
n AS (SELECT doc_id, coalesce(len(grams), 0)::BIGINT AS n_shingles FROM g),
x AS (SELECT doc_id, unnest(grams) AS gram FROM g),
df AS (SELECT gram, count(*) AS df FROM x GROUP BY gram HAVING count(*) > 1),
o AS (SELECT x.doc_id, x.gram, coalesce(df.df, 1) AS df, row_number() OVER (PARTITION BY x.doc_id ORDER BY coalesce(df.df, 1), x.gram) AS place FROM x LEFT JOIN df USING (gram)),
f AS (SELECT o.doc_id, o.gram FROM o JOIN n USING (doc_id) WHERE o.place <= n.n_shingles // 10 + 1 AND o.df > 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.gram = b.gram AND a.doc_id < b.doc_id),
m AS (SELECT c.a, c.b, count(*) AS n_both FROM c JOIN x p ON p.doc_id = c.a JOIN x q ON q.doc_id = c.b AND q.gram = p.gram GROUP BY c.a, c.b),
e AS (SELECT a, b FROM m JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * n_both >= 90 * (na.n_shingles + nb.n_shingles - n_both)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS doc_id, a AS other FROM u UNION SELECT reach.doc_id, u.b FROM reach JOIN u ON reach.other = u.a)
SELECT n.doc_id, n.n_shingles, least(n.doc_id, coalesce(min(reach.other), n.doc_id))::BIGINT AS component_id
FROM n LEFT JOIN reach ON reach.doc_id = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""

CHAT_FORMAT = r"""
WITH c AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(role) + 1 + length(text) + 8 + len(regexp_extract_all(text, '</turn>|### |\\')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

QUALITY_RULES = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS ws FROM documents),
b AS (SELECT doc_id, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
l AS (SELECT doc_id, source, line, regexp_extract_all(line, '{_WORD}') AS ws FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM w)),
k AS (SELECT doc_id, source, line, len(ws) AS n, translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM l WHERE len(ws) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM k GROUP BY doc_id),
h AS (SELECT source, count(DISTINCT doc_id) AS docs FROM documents GROUP BY source),
s AS (SELECT k.source, norm FROM k JOIN h ON h.source IS NOT DISTINCT FROM k.source GROUP BY k.source, norm, h.docs HAVING count(DISTINCT doc_id) > 5 AND count(DISTINCT doc_id) > 0.02 * h.docs),
rm AS (SELECT doc_id, sum(n) AS removed FROM k JOIN s ON s.source IS NOT DISTINCT FROM k.source AND s.norm = k.norm GROUP BY doc_id),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, word, lead(word) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, i FROM g WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, word, w2, w3) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM t) GROUP BY doc_id),
f AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, (n_words - coalesce(removed, 0))::BIGINT AS words_left,
  n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed FROM b LEFT JOIN dup USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN rm USING (doc_id))
SELECT *, NOT base_failed AND words_left >= 0.5 * n_words AS kept FROM f
"""

SPELLING_VARIANTS = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda k: list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k)) AS t),
o AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code FROM o WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, times, xor(4294967295, list_reduce(list_transform(range(len(code) // 2), lambda k: ('0x' || substr(code, 2 * k + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT)) AS h FROM r, crc),
d AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM h),
w AS (SELECT word, sum(times)::BIGINT AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT DISTINCT a.word AS a, b.word AS b, b.n FROM x a JOIN x b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.less = w.word UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.less = w.word),
f AS (SELECT w.word, w.n, count(e.b) AS n_near, first(e.b ORDER BY e.n DESC, e.b) AS best, max(e.n) AS best_n FROM w LEFT JOIN e ON e.a = w.word GROUP BY w.word, w.n),
g AS (SELECT word, n, n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM f),
up AS (SELECT word, word AS root, 0 AS step FROM g UNION ALL SELECT up.word, g.form, step + 1 FROM up JOIN g ON g.word = up.root WHERE g.form IS NOT NULL)
SELECT g.word, g.form, u.root, g.n, g.n_near, g.form_n FROM g JOIN (SELECT word, arg_max(root, step) AS root FROM up GROUP BY word) u ON u.word = g.word
"""

PREFIX_TRIE = rf"""
WITH RECURSIVE s AS (SELECT conv_id::BIGINT AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT list_transform(range(256), lambda k: list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k)) AS t),
i AS (SELECT c, c - c % 20 AS up, hex(encode(c::VARCHAR)) AS code FROM (SELECT DISTINCT c FROM s)),
h AS (SELECT c, up, xor(4294967295, list_reduce(list_transform(range(len(code) // 2), lambda k: ('0x' || substr(code, 2 * k + 1, 2))::BIGINT), lambda x, b: xor(x >> 8, t[xor(x & 255, b) + 1]), 4294967295::BIGINT)) % 4 AS h FROM i, crc),
r AS (SELECT h.c, s.pos, 0 AS own, role, text FROM h JOIN s ON s.c = h.up AND s.pos < h.h UNION ALL SELECT h.c, s.pos, 1, role, text FROM h JOIN s ON s.c = h.c AND s.pos >= h.h),
n AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, length(role) || ':' || role || text AS turn, len(regexp_extract_all(text, '{_WORD}')) AS words FROM r),
p AS (SELECT c, 0::BIGINT AS d, '' AS node, NULL::VARCHAR AS up, 0 AS words FROM h UNION ALL SELECT n.c, n.d, sha256(p.node || n.turn), p.node, n.words FROM p JOIN n ON n.c = p.c AND n.d = p.d + 1),
e AS (SELECT c, max_by(node, d) AS node FROM p GROUP BY c),
v AS (SELECT node, any_value(up) AS up, any_value(d) AS depth, any_value(words) AS words, count(*) AS n_convs, min(c) AS conv_id FROM p GROUP BY node),
k AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN (SELECT up AS node, count(*) AS n_children FROM v WHERE up IS NOT NULL GROUP BY up) USING (node)),
a AS (SELECT node, node AS top FROM k UNION ALL SELECT a.node, k.up FROM a JOIN k ON k.node = a.top WHERE k.up IS NOT NULL),
b AS (SELECT a.top AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM a JOIN k ON k.node = a.node GROUP BY a.top),
g AS (SELECT node, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM e GROUP BY node)
SELECT k.conv_id, k.depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, b.n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(g.ids, '')) AS ends_sha256
FROM k JOIN b USING (node) LEFT JOIN k u ON u.node = k.up LEFT JOIN g ON g.node = k.node
"""
