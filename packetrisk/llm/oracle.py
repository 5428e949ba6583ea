"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from packetrisk.llm.chat import CONTROL

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dg JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS s, least(3, len(w)) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM dw WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.k = y.k AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM pairs JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM dw UNION SELECT reach.doc_id, b FROM reach JOIN links ON reach.r = a),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN size USING (doc_id)
"""

_MARKS = "|".join([r"\\", *(c.replace("[", r"\[").replace("]", r"\]").replace("|", r"\|") for c in CONTROL)])

CHATS = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, 8 + length(role) + length(text) + len(regexp_extract_all(role, '{_MARKS}|\\n')) + len(regexp_extract_all(text, '{_MARKS}')) AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(length(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant')), 0) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda r, s: CASE WHEN s >= 0 THEN xor(r, s) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END), 4294967295)"

TRIE = f"""
WITH own AS (SELECT conv_id AS c, list(struct_pack(s := sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), b := strlen(coalesce(text, ''))) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
cut AS (SELECT *, {_CRC} % 9 AS h FROM own),
rebuilt AS (SELECT cut.c, list_concat(coalesce(list_slice(o.ts, 1, h), []), list_slice(cut.ts, h + 1, len(cut.ts))) AS ts FROM cut LEFT JOIN own o ON o.c = cut.c - cut.c % 5),
px AS (SELECT c, d, len(ts) AS n, array_to_string(list_transform(list_slice(ts, 1, d), lambda x: x.s), ',') AS k, array_to_string(list_transform(list_slice(ts, 1, d - 1), lambda x: x.s), ',') AS up, coalesce(ts[d].b, 0) AS b
  FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt)),
node AS (SELECT d, k, any_value(up) AS up, min(c) AS conv_id, count(*) AS n, any_value(b) AS b, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (px.n = d), '')) AS ends FROM px GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
below AS (SELECT DISTINCT x.d, x.k, y.d AS bd, y.k AS bk FROM px x JOIN px y ON x.c = y.c AND y.d >= x.d),
sums AS (SELECT below.d, below.k, sum((node.n - 1) * node.b)::BIGINT AS saved, count(*) FILTER (kids.n IS NULL) AS leaves FROM below JOIN node ON bd = node.d AND bk = node.k LEFT JOIN kids ON bd = kids.d AND bk = kids.k GROUP BY below.d, below.k)
SELECT node.conv_id, node.d AS depth, above.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN sums USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN node above ON above.d = node.d - 1 AND above.k = node.up AND node.d > 0
"""

PHRASES = f"""
WITH w AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
one AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (SELECT lang, k, p, count(*) AS n FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM one, range(1, 6) t(k) WHERE i + k - 1 <= len(w)) GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT *, string_split(p, ' ') AS q FROM f WHERE k > 1),
inside AS (SELECT lang, p, max(n) AS longer FROM (SELECT lang, n, array_to_string(q[i:i + m - 1], ' ') AS p FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) t(m) WHERE m < k)) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, p) WHERE longer IS NULL OR 100 * longer < 100 * n),
cuts AS (SELECT kept.lang, kept.p, kept.n AS a, l.n AS l, r.n AS r, total.n, j, (1000::HUGEINT * kept.n * total.n) // (l.n::HUGEINT * r.n) AS s FROM (SELECT *, unnest(range(1, k)) AS j FROM kept) kept
  JOIN f l ON l.lang = kept.lang AND l.p = array_to_string(q[1:j], ' ') JOIN f r ON r.lang = kept.lang AND r.p = array_to_string(q[j + 1:], ' ') JOIN total ON total.lang = kept.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY s, j) = 1)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY s DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, s::BIGINT AS score FROM best) WHERE rank <= 2000
"""

ORACLE = {"op2_winnowing": DECONTAMINATION, "op5_coordinate_join": NEAR_DUPLICATES, "op6_chat_parts": CHATS, "op11_dynamic_phrases": PHRASES, "op13_zfast_trie": TRIE}
