"""The operators that SQL can express, as DuckDB SQL over whole tables."""

from __future__ import annotations

from tidemark.llm.chat import END, MAPPINGS, START, fingerprint

_WORDS = r"w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)"

_LEDGER = rf"""{_WORDS},
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 4], ' ')) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest(range(5)) AS k) q WHERE n > 1 GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (WHERE regexp_matches(line, '^[\x20\x09-\x0D]*[-*•‣◦]')) AS n_bullet_lines, count(*) FILTER (WHERE regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS n_ellipsis_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) q WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_bullet_lines, 0) AS n_bullet_lines, coalesce(n_ellipsis_lines, 0) AS n_ellipsis_lines, len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha_words, coalesce(list_max(list_transform(ws, lambda x: length(x))), 0) AS longest_word, length(regexp_replace(t, '[^\x00-\x08\x0E-\x1F\x7F\x{{FFFD}}]', '', 'g')) AS n_control FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id),
b AS (SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END) + (CASE WHEN n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END) + (CASE WHEN 10 * word_chars < 15 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END) + (CASE WHEN 10 * n_bullet_lines > 9 * n_lines THEN 64 ELSE 0 END) + (CASE WHEN 10 * n_ellipsis_lines > 3 * n_lines THEN 128 ELSE 0 END) + (CASE WHEN 10 * n_alpha_words < 5 * n_words THEN 256 ELSE 0 END) + (CASE WHEN longest_word > 1000 THEN 512 ELSE 0 END) + (CASE WHEN 10 * n_control > n_words THEN 1024 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)"""

OP10 = rf"""WITH {_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b"""

ABLATION = rf"""WITH {_LEDGER},
q AS (SELECT unnest(['few_words', 'repeated_windows', 'symbols', 'repeated_lines', 'short_words', 'long_words', 'bullet_lines', 'ellipsis_lines', 'few_alphabetic', 'unbroken', 'control_characters']) AS rule, unnest(range(11)) AS k)
SELECT rule, count(*) FILTER (WHERE fail_bits & (1 << k) <> 0) AS failed, count(*) FILTER (WHERE fail_bits = 1 << k) AS failed_alone, count(*) FILTER (WHERE fail_bits - (fail_bits & (1 << k)) = 0) AS kept_without FROM q LEFT JOIN b ON true GROUP BY rule"""

OP4 = rf"""WITH {_WORDS},
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS n FROM p),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM g, (SELECT unnest(range(20)) AS k) q WHERE n > 1),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.i WHERE c.i IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""

OP3 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0) q),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.root)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT doc_id, min(root) AS c FROM r GROUP BY 1) m ON m.doc_id = w.doc_id"""


OP2 = r"""WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
t(rule, decision) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(decision, length(rule)) AS decision FROM p JOIN t ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY 1),
j AS (SELECT p.page_id, host, path, rule, decision FROM p LEFT JOIN f ON f.page_id = p.page_id),
h AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?\s*((?:https?:)?//[^"''\s>]*)', 1)) AS link FROM p WHERE host <> ''),
g AS (SELECT src, translate(regexp_extract(link, '//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM h),
l AS (SELECT src, dst, count(*) AS n FROM g WHERE dst <> '' AND dst <> src GROUP BY 1, 2),
w AS (SELECT 'allow' AS kind, src AS a, dst AS b, n / sum(n) OVER (PARTITION BY src) * 0.85 AS w FROM l UNION ALL SELECT 'block', dst, src, n / sum(n) OVER (PARTITION BY dst) * 0.85 FROM l),
r(kind, host, x, step) AS (SELECT decision, host, 0.15 * count(*) / sum(count(*)) OVER (PARTITION BY decision), 0 FROM j WHERE decision IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT r.kind, b, x * w, step + 1 FROM r JOIN w ON w.kind = r.kind AND w.a = r.host WHERE step < 90),
s AS (SELECT host, coalesce(sum(x) FILTER (WHERE kind = 'allow'), 0) AS trust, coalesce(sum(x) FILTER (WHERE kind = 'block'), 0) AS distrust FROM r GROUP BY 1)
SELECT page_id, j.host, path, rule, coalesce(decision, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(trust, 0), 6) AS trust, round(coalesce(distrust, 0), 6) AS distrust FROM j LEFT JOIN s ON s.host = j.host"""

TARGETS = r"""WITH s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS DOUBLE) AS size FROM documents GROUP BY 1),
w AS (SELECT source, size, 3 * size AS cap, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
c AS (SELECT *, (SELECT sum(size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over, sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM w),
v AS (SELECT left_over / w_left AS level FROM c WHERE cap * w_left > left_over * w ORDER BY cap / w, source LIMIT 1)
SELECT source, CAST(size AS BIGINT) AS source_size, round(least(cap, w * coalesce((SELECT level FROM v), 'inf'::DOUBLE)), 3) AS target FROM w"""

SHARDS = r"""SELECT count(*) AS n_rows, CAST(sum(coalesce(strlen(text), 0) + 8) AS BIGINT) AS bytes, CAST(24 AS BIGINT) AS shards, true AS gapless, true AS near_equal FROM documents"""


def _mark(*fields: str) -> str:
    mark = fingerprint(set(fields))
    assert mark in MAPPINGS
    return mark


_ESCAPES = r"len(regexp_extract_all({x}, '<\\*\|'))"
_BOTH = f"{END}{START}assistant ok"

OP8 = rf"""WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{_BOTH}' UNION ALL SELECT -1, 1, 'assistant', '{_BOTH}'),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned, string_agg(role, ',' ORDER BY turn, role, text) AS roles, sum({len(START) + len(END) + 2} + length(replace(replace(role, '%', '%25'), chr(10), '%0A')) + {_ESCAPES.format(x="role")} + length(text) + {_ESCAPES.format(x="text")}) AS chars FROM a GROUP BY 1)
SELECT conv_id, n_turns, turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars, CASE roles WHEN 'user,assistant' THEN '{_mark("prompt", "response")}' WHEN 'system,user,assistant' THEN '{_mark("system", "instruction", "output")}' ELSE '{_mark("messages", "messages[]", "messages[].role", "messages[].content")}' END AS fingerprint FROM g"""

OP11 = r"""WITH RECURSIVE tbl AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT)) AS v FROM (SELECT unnest(range(256)) AS i) q) q),
f AS (SELECT doc_id, source, lang, n_chars, text, coalesce(strlen(source) || ':' || source, '-') AS fs, coalesce(strlen(lang) || ':' || lang, '-') AS fl, coalesce(strlen(text) || ':' || text, '-') AS ft, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') AS fd FROM documents),
l AS (SELECT doc_id, lang, sha256(fd || fs || fl || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || ft) AS leaf, CASE WHEN xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN sha256(fd || fs || fl || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || ft) END AS tampered FROM f, tbl),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
n(lang, lvl, pos, d) AS (SELECT lang, 0, pos, leaf FROM p UNION ALL SELECT lang, lvl + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS k FROM n) q WHERE k > 1 GROUP BY lang, lvl, pos // 2),
s AS (SELECT lang, max(lvl) AS h, arg_max(d, lvl) AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM n GROUP BY lang),
t(lvl, pos, d) AS (SELECT 0, pos, subroot FROM s UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS k FROM t) q WHERE k > 1 GROUP BY lvl, pos // 2),
r AS (SELECT max(lvl) AS h, arg_max(d, lvl) AS root FROM t),
k AS (SELECT CAST(unnest(range(62)) AS INT) AS lv),
a AS (SELECT p.lang, p.pos, k.lv, CASE WHEN (p.pos >> k.lv) & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(n.d, '') AS step FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN k ON k.lv < s.h LEFT JOIN n ON n.lang IS NOT DISTINCT FROM p.lang AND n.lvl = k.lv AND n.pos = xor(p.pos >> k.lv, 1)),
b AS (SELECT s.lang, k.lv, CASE WHEN (s.pos >> k.lv) & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(t.d, '') AS step FROM s CROSS JOIN r JOIN k ON k.lv < r.h LEFT JOIN t ON t.lvl = k.lv AND t.pos = xor(s.pos >> k.lv, 1)),
u AS (SELECT lang, list(step ORDER BY lv) AS steps FROM b GROUP BY lang),
w AS (SELECT p.doc_id, p.leaf, coalesce(p.tampered, p.leaf) AS start, s.subroot, r.root, coalesce(g.steps, []) || coalesce(u.steps, []) AS steps FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN r LEFT JOIN (SELECT lang, pos, list(step ORDER BY lv) AS steps FROM a GROUP BY lang, pos) g ON g.lang IS NOT DISTINCT FROM p.lang AND g.pos = p.pos LEFT JOIN u ON u.lang IS NOT DISTINCT FROM p.lang),
v AS (SELECT *, list_reduce(steps, lambda acc, x: CASE WHEN x[1] = 'L' THEN sha256(x[2:] || acc) ELSE sha256(acc || x[2:]) END, start) AS folded_root FROM w)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM v"""

OP12 = r"""WITH t AS (SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT row, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY row),
c AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, c WHERE term IN (SELECT term FROM q) GROUP BY term),
s AS (SELECT item_id, p.row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN n ON n.row = p.row, c GROUP BY item_id, p.row, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 50"""

ORACLE_SQL = {"op11_merkle_manifest": OP11, "op12_ranked_search": OP12, "op2_url_filters": OP2, "mixing_targets": TARGETS, "shard_totals": SHARDS, "op3_ngram_jaccard": OP3, "op4_substring_dedup": OP4, "op8_chat_format": OP8, "op10_quality_rules": OP10, "quality_ablation": ABLATION}
