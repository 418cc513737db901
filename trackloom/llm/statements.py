"""SQL that gives the rows of the numbered queries without their methods: by comparing everything.

Words are split and sets compared as plain strings, so hashes, signatures and packed tables of the
operators have no part in it."""

from __future__ import annotations

_FOLDED = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

#: Links between all sets that share a shingle, and the least id that can be reached over them.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, string_agg(g, chr(10) ORDER BY g) AS k FROM s GROUP BY doc_id),
c AS (SELECT k, any_value(n) AS n, min(doc_id) AS rep FROM n GROUP BY k),
m AS (SELECT rep, n, g FROM c JOIN s ON s.doc_id = c.rep),
p AS (SELECT a.rep AS a, b.rep AS b FROM m AS a JOIN m AS b ON a.g = b.g AND a.rep < b.rep
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(rep, seen) AS (SELECT rep, rep FROM c UNION SELECT r.rep, l.b FROM r JOIN l ON l.a = r.seen),
t AS (SELECT rep, min(seen) AS root FROM r GROUP BY rep)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(t.root, d.doc_id) AS component_id,
  coalesce(t.root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.k = n.k LEFT JOIN t ON t.rep = c.rep
"""

#: Every way to lay an item along a document in which a token agrees.
DECONTAMINATION = r"""
WITH d AS (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
dt AS (SELECT doc_id, text, unnest(range(len(w))) AS i, unnest(w) AS t FROM d WHERE text IS NOT NULL),
qt AS (SELECT item_id, w, len(w) AS m, unnest(range(len(w))) AS j, unnest(w) AS t FROM q),
a AS (SELECT doc_id, text, item_id, w, m, i - j AS place, count(*) AS n, list_sort(list(j)) AS js
      FROM dt JOIN qt USING (t) GROUP BY ALL HAVING count(*) >= 0.8 * m OR count(*) >= 11),
f AS (SELECT * FROM a WHERE n >= 0.8 * m OR len(list_filter(range(1, n - 9), lambda k: js[k + 10] - js[k] < 13)) > 0)
SELECT doc_id, item_id, CAST(b.m AS INTEGER) AS item_tokens, CAST(b.n AS INTEGER) AS agreeing, CAST(-b.place AS INTEGER) AS first_token
FROM (SELECT doc_id, item_id, max({'n': n, 'place': -place, 'm': m}) AS b FROM f GROUP BY doc_id, item_id)
"""

#: Katz's factors of {of}'s counts c, smoothed by a line through the logarithms of their counts of counts.
_FACTORS = """
{name}_n AS (SELECT c AS r, count(*) AS n FROM {of} WHERE c <= 6 GROUP BY c),
{name}_z AS (SELECT r, n, r - lag(r, 1, 0) OVER (ORDER BY r) AS lo,
              coalesce(lead(r) OVER (ORDER BY r) - r, r - lag(r) OVER (ORDER BY r)) AS hi FROM {name}_n),
{name}_up AS (SELECT least(CASE WHEN count(*) > 1 THEN regr_slope(ln(2.0 * n / (lo + hi)), ln(r)) ELSE -2 END + 1, 0) AS up FROM {name}_z),
{name} AS (SELECT r, 1 - CASE WHEN up < -1e-9 THEN (exp(up * ln(1 + 1 / r)) - 1) / (exp(up * ln(6)) - 1) ELSE ln(1 + 1 / r) / ln(6) END AS f
           FROM {name}_up, (SELECT unnest(range(1, 6)) AS r))"""

#: CRC-32 of the id's digits, bit by bit.
_CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ord(x) AS BIGINT))),
  lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda k: CAST(k AS BIGINT))), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

LANGUAGE_MODEL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_CRC} % 5 = 1 AS held, list_concat({_FOLDED}, ['']) AS w FROM documents),
t AS (SELECT id, held, unnest(list_concat([' '], w[:-2])) AS h, unnest(w) AS w FROM d),
u AS (SELECT w, count(*) AS c FROM t WHERE NOT held GROUP BY w),
b AS (SELECT h, w, count(*) AS c FROM t WHERE NOT held GROUP BY h, w),
s AS (SELECT h, sum(c) AS seen FROM b GROUP BY h),
nv AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM u),
{_FACTORS.format(name="uf", of="u")},
{_FACTORS.format(name="bf", of="b")},
one AS (SELECT w, c, c * coalesce(f, 1) / (n + 1) AS p FROM u CROSS JOIN nv LEFT JOIN uf ON r = c),
rest AS (SELECT 1 - coalesce(sum(p), 0) AS p FROM one),
two AS (SELECT b.h, b.w, b.c * coalesce(f, 1) / (seen + 1) AS p, one.p AS lower FROM b JOIN s ON s.h = b.h JOIN one ON one.w = b.w LEFT JOIN bf ON r = b.c),
back AS (SELECT h, (1 - sum(p)) / (1 - sum(lower)) AS a FROM two GROUP BY h),
x AS (SELECT t.id, one.c AS c, log10((coalesce(one.c, 0) + 0.5) / (n + 0.5 * (v + 1))) AS base,
        log10(coalesce(two.p, coalesce(back.a, 1) * coalesce(one.p, rest.p))) AS p
      FROM t CROSS JOIN nv CROSS JOIN rest LEFT JOIN one ON one.w = t.w LEFT JOIN two ON two.h = t.h AND two.w = t.w LEFT JOIN back ON back.h = t.h),
y AS (SELECT id, count(*) AS n_tokens, count(c) AS n_known, sum(base) AS base_score, sum(p) AS score FROM x GROUP BY id)
SELECT doc_id, held AS held_out, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_known AS BIGINT) AS n_known, CAST(n AS BIGINT) AS train_tokens, base_score, score
FROM d JOIN y ON y.id = d.id CROSS JOIN nv
"""

#: Digests of formatted conversations; lengths from what escaping adds.
CHAT_FORMAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v),
l AS (SELECT *, length(text) + length(text) - length(replace(text, chr(92), '')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]')) AS said,
  length(role) + length(role) - length(replace(role, chr(92), '')) + length(role) - length(replace(role, chr(10), '')) + len(regexp_extract_all(role, '</?s>|\[/?INST\]')) AS named FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(said + CASE WHEN role = 'assistant' THEN 7 ELSE 14 + named END) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id
"""

#: The trie, with whole prefixes as keys.
PREFIX_TRIE = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, '')))) AS i,
  {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, t.i, t.x FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.i <= c.h UNION ALL SELECT c.conv_id, t.i, t.x FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
w AS (SELECT c.conv_id, coalesce(list(b.x ORDER BY b.i) FILTER (b.i IS NOT NULL), []) AS path FROM c LEFT JOIN b ON c.conv_id = b.conv_id GROUP BY 1),
p AS (SELECT conv_id, d, list_slice(path, 1, d) AS node, d = len(path) AS ends FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM w)),
n AS (SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
k AS (SELECT list_slice(node, 1, depth - 1) AS node, depth - 1 AS depth, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1, 2),
s AS (SELECT n.*, coalesce(k.n, 0) AS n_children, (n_convs - 1) * CASE WHEN n.depth > 0 THEN len(regexp_extract_all(n.node[n.depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved FROM n LEFT JOIN k ON n.node = k.node AND n.depth = k.depth),
u AS (SELECT list_slice(node, 1, up) AS node, up AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS up FROM s) GROUP BY 1, 2)
SELECT s.conv_id, s.depth, m.conv_id AS parent_conv_id, s.n_convs, s.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, s.ends_sha256
FROM s JOIN u ON s.node = u.node AND s.depth = u.depth LEFT JOIN s m ON m.depth = s.depth - 1 AND m.node = list_slice(s.node, 1, s.depth - 1)
"""
