"""SQL for DuckDB that gives the rows of text queries, where SQL can."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
wins AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM w, range(1, CAST(len(ws) AS BIGINT) - 33) AS t(i)),
dup AS (SELECT g FROM wins GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM wins JOIN dup USING (g), range(i, i + 35) AS r(p)),
kept AS (SELECT w.doc_id, string_agg(ws[q.p], ' ' ORDER BY q.p) AS kept FROM w, range(1, CAST(len(ws) AS BIGINT) + 1) AS q(p) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = w.doc_id AND g.p = q.p) GROUP BY w.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = w.doc_id LEFT JOIN kept k ON k.doc_id = w.doc_id"""

REPETITION = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
base AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM w),
line AS (SELECT doc_id, l, count(*) AS c FROM w, unnest(string_split(text, chr(10))) AS t(l) WHERE len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) > 0 GROUP BY doc_id, l),
lines AS (SELECT doc_id, sum(c - 1)::BIGINT AS n_dup_lines, sum((c - 1) * strlen(l)) AS dup_bytes, sum(c * strlen(l)) AS bytes FROM line GROUP BY doc_id),
gram AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g, list_sum(list_transform(ws[i:i + n - 1], lambda x: length(x))) AS chars FROM w, range(2, 11) AS a(n), range(1, CAST(len(ws) AS BIGINT) - n + 2) AS t(i)),
again AS (SELECT *, count(*) OVER (PARTITION BY doc_id, n, g) AS c, row_number() OVER (PARTITION BY doc_id, n, g ORDER BY i) AS nth FROM gram),
three AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM again, range(i, i + 3) AS r(p) WHERE n = 3 AND c > 1 GROUP BY doc_id),
top AS (SELECT doc_id, n, max(chars * c) AS m FROM again WHERE n < 5 AND c > 1 GROUP BY doc_id, n),
cover AS (SELECT x.doc_id, x.n, sum(length(ws[p])) AS m FROM (SELECT DISTINCT doc_id, n, p FROM again, range(i, i + n) AS r(p) WHERE n >= 5 AND nth > 1) x JOIN w ON w.doc_id = x.doc_id GROUP BY x.doc_id, x.n),
bad AS (SELECT t.doc_id FROM top t JOIN base b ON b.doc_id = t.doc_id WHERE m > CASE n WHEN 2 THEN 0.20 WHEN 3 THEN 0.18 ELSE 0.16 END * word_chars
  UNION SELECT c.doc_id FROM cover c JOIN base b ON b.doc_id = c.doc_id WHERE m > 0.20 * word_chars UNION SELECT doc_id FROM lines WHERE dup_bytes > 0.20 * bytes)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM (
  SELECT b.*, coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(t.n, 0)::BIGINT AS n_repeat_words, n_words < 50 OR 100 * coalesce(t.n, 0) > 50 * n_words AS failed FROM base b LEFT JOIN lines l ON l.doc_id = b.doc_id LEFT JOIN three t ON t.doc_id = b.doc_id) x"""

#: CRC-32 of the ASCII text x, bit by bit.
CRC = "xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({x}) + 1), lambda i: ascii(substr({x}, i, 1))::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384::BIGINT))))"

LINES = r"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM d, range(1, CAST(len(ls) AS BIGINT) + 1) AS t(i)),
s AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper <> doc_id) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256 FROM l LEFT JOIN s USING (k) GROUP BY doc_id"""

_FIELD = lambda x: f"coalesce(strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
_RUNS = "list_transform(range(0, len(hs), 3), lambda i: sha256(array_to_string(hs[i + 1:i + 3], '')))"
MANIFEST = f"""WITH RECURSIVE x AS (SELECT doc_id, source, {_LEAF('text')} AS leaf, {_LEAF("replace(text, chr(10), '')")} AS other, {CRC.format(x='(doc_id::VARCHAR)')} % 2 = 0 AS tampered FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS nth FROM x),
lv AS (SELECT source, 0 AS d, list(leaf ORDER BY nth) AS hs FROM r GROUP BY source UNION ALL SELECT source, d + 1, {_RUNS} FROM lv WHERE len(hs) > 1),
tops AS (SELECT source, hs[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS t, d AS high FROM lv WHERE len(hs) = 1),
tv AS (SELECT 0 AS d, list(subroot ORDER BY t) AS hs FROM tops UNION ALL SELECT d + 1, {_RUNS} FROM tv WHERE len(hs) > 1),
steps AS (SELECT r.doc_id, lv.d, hs, nth // (3 ** lv.d)::BIGINT AS k FROM r JOIN lv ON lv.source IS NOT DISTINCT FROM r.source WHERE len(hs) > 1
  UNION ALL SELECT r.doc_id, high + tv.d, hs, t // (3 ** tv.d)::BIGINT FROM r JOIN tops ON tops.source IS NOT DISTINCT FROM r.source, tv WHERE len(hs) > 1),
sides AS (SELECT doc_id, d, array_to_string(hs[k - k % 3 + 1:k], '') AS a, array_to_string(hs[k + 2:k - k % 3 + 3], '') AS b FROM steps),
p AS (SELECT doc_id, list({{'a': a, 'b': b}} ORDER BY d) AS path, sha256(string_agg(a || b, '' ORDER BY d)) AS proof FROM sides GROUP BY doc_id),
f AS (SELECT r.doc_id, 0 AS i, CASE WHEN tampered THEN other ELSE leaf END AS h, coalesce(path, []) AS path FROM r LEFT JOIN p USING (doc_id) UNION ALL SELECT doc_id, i + 1, sha256(path[i + 1].a || h || path[i + 1].b), path FROM f WHERE i < len(path))
SELECT r.doc_id, leaf, subroot, tv.hs[1] AS root, coalesce(proof, sha256('')) AS proof_sha256, h AS folded_root, h = tv.hs[1] AS verified FROM tv, r JOIN tops ON tops.source IS NOT DISTINCT FROM r.source LEFT JOIN p USING (doc_id) JOIN f ON f.doc_id = r.doc_id AND f.i = len(f.path) WHERE len(tv.hs) = 1"""

#: Of the turns from i on, the cheapest audits by the grammar's phase (0 nothing, 1 system, 2 user, 3 assistant), as cost in nine digits and letters; o1-o3 are before inserts.
_ADD = lambda n, letter, x: f"(lpad((({n}) + substr({x}, 1, 9)::BIGINT)::VARCHAR, 9, '0') || '{letter}' || substr({x}, 10))"
_USER = lambda x: f"CASE WHEN fault < 2 THEN CASE WHEN r = 'u' THEN {_ADD('fault', 'K', x)} ELSE {_ADD('2 + fault', 'R', x)} END END"
_ASSISTANT = lambda x: f"CASE WHEN fault < 2 THEN CASE WHEN r = 'a' THEN {_ADD('fault', 'K', x)} ELSE {_ADD('2 + fault', 'R', x)} END END"
TURNS = rf"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC.format(x="(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
dam AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM c, range(0, 2) AS t(z) WHERE kind <> 0 AND (z = 0 OR kind = 3)),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM dam),
flt AS (SELECT *, substr(role, 1, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 3 WHEN regexp_matches(text, '[.!?][ 	-
]*$') THEN 0 ELSE 1 END AS fault, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM num),
agg AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 2) AS blank, count(*) FILTER (WHERE fault = 3) AS duplicate, count(*) FILTER (WHERE fault = 1) AS truncated, count(*) FILTER (WHERE prior IS NOT NULL AND (prior || r) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM flt GROUP BY conv_id),
dp AS (SELECT conv_id, n + 1 AS i, '000000000' AS f0, '000000004II' AS f1, '000000002I' AS f2, '000000000' AS f3 FROM agg
  UNION ALL SELECT conv_id, i, least(g0, {_ADD(2, 'I', 'g2')}, {_ADD(4, 'II', 'g3')}), least(g1, {_ADD(2, 'I', 'g2')}, {_ADD(4, 'II', 'g3')}), least(g2, {_ADD(2, 'I', 'g3')}), least(g3, {_ADD(2, 'I', 'g2')}) FROM (
    SELECT dp.conv_id, flt.i, least({_ADD(3, 'D', 'f0')}, CASE WHEN fault < 2 AND r = 's' THEN {_ADD('fault', 'K', 'f1')} END, {_USER('f2')}) AS g0, least({_ADD(3, 'D', 'f1')}, {_USER('f2')}) AS g1, least({_ADD(3, 'D', 'f2')}, {_ASSISTANT('f3')}) AS g2, least({_ADD(3, 'D', 'f3')}, {_USER('f2')}) AS g3 FROM dp JOIN flt ON flt.conv_id IS NOT DISTINCT FROM dp.conv_id AND flt.i = dp.i - 1) y),
best AS (SELECT conv_id, substr(f0, 1, 9)::BIGINT AS cost, substr(f0, 10) AS audit FROM dp WHERE i = 1),
let AS (SELECT conv_id, p, substr(audit, p, 1) AS e, length(replace(substr(audit, 1, p), 'I', '')) AS i FROM best, range(1, length(audit) + 1) AS t(p)),
emi AS (SELECT let.conv_id, p, e, CASE WHEN e <> 'I' THEN r END AS r, role, CASE WHEN e = 'I' THEN '' ELSE text END AS text, row_number() OVER (PARTITION BY let.conv_id ORDER BY p) AS q, first_value(CASE WHEN e = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY let.conv_id ORDER BY p) AS s FROM let LEFT JOIN flt ON flt.conv_id IS NOT DISTINCT FROM let.conv_id AND flt.i = let.i WHERE e <> 'D'),
rep AS (SELECT conv_id, sha256(string_agg((CASE WHEN e = 'K' THEN role WHEN (q - s) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY p)) AS h FROM emi GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN agg ON agg.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN rep ON rep.conv_id IS NOT DISTINCT FROM o.conv_id"""

ORACLES = {"op6_substring_dedup": SUBSTRINGS, "op8_repetition": REPETITION, "op11_turn_repair": TURNS, "op12_line_dedup": LINES, "op13_manifest": MANIFEST}
