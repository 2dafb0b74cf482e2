"""SQL twins of the corpus queries."""

OP3 = r"""
WITH sized AS (
  SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
p AS (SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0) AS BIGINT) AS remaining,
             CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS BIGINT) AS rest
      FROM s WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, min(CAST(remaining * w > 3 * source_size * rest AS INT))
             OVER (ORDER BY source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) = 1 AS capped FROM p),
lv AS (SELECT CAST(remaining AS DOUBLE) / CAST(rest AS DOUBLE) AS lev FROM c WHERE NOT capped
       ORDER BY source_size / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
                                       ELSE (SELECT lev FROM lv) * CAST(w AS DOUBLE) END AS target FROM c),
r AS (SELECT z.*, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN least(t.target / CAST(t.source_size AS DOUBLE), 3.0) ELSE 0.0 END AS rate,
             CAST(CAST('0x' || substr(md5(concat_ws('|', '11', coalesce(CAST(doc_id AS VARCHAR), ''),
                  coalesce(text, ''))), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0 AS u
      FROM sized z JOIN t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""

OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos
      FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
n AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY rid),
g AS (SELECT rid, pos, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram
      FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
rep AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, gram) AS c FROM g WHERE gram IS NOT NULL)
        WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT pos + j) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) x(j) GROUP BY rid),
l AS (SELECT rid, source, md5(text) AS content, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
              regexp_replace(trim(regexp_replace(lower(line), '\s+', ' ', 'g')), '[0-9]', '0', 'g') AS plain
       FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY rid),
hosts AS (SELECT source, count(DISTINCT md5(text)) AS n FROM d GROUP BY source),
f AS (SELECT lw.source, plain FROM lw JOIN hosts h ON lw.source IS NOT DISTINCT FROM h.source
      GROUP BY lw.source, plain, h.n HAVING count(DISTINCT content) > 10 AND count(DISTINCT content) > 0.01 * h.n),
rem AS (SELECT rid, sum(words) AS lost FROM lw JOIN f ON lw.source IS NOT DISTINCT FROM f.source AND lw.plain = f.plain
        GROUP BY rid),
a AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(lost, 0) AS n_removed_words
      FROM d LEFT JOIN n USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rem USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_removed_words AS BIGINT) AS n_removed_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.5 * n_words AS kept
FROM a
"""

OP9 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(CASE role WHEN 'human' THEN 'user' WHEN 'prompter' THEN 'user' WHEN 'gpt' THEN 'assistant'
         WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE role END, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '<\||<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]', 'X\0', 'g') AS shown,
             regexp_replace(replace(role, '\', '\\'), '<\||<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]', 'X\0', 'g') AS called
      FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(called) + length(shown) + 23) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT item, least(len(ws), 10) AS k, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS p, ws FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(ws[p:p + k - 1], ' ') AS gram FROM bw),
dw AS (SELECT rid, k, unnest(range(1, len(ws) - k + 2)) AS p, ws FROM d, (SELECT DISTINCT k FROM win) WHERE len(ws) >= k),
hit AS (SELECT g.rid, g.p, g.k, win.item FROM (SELECT rid, k, p, array_to_string(ws[p:p + k - 1], ' ') AS gram FROM dw) g
        JOIN win ON win.k = g.k AND win.gram = g.gram),
cov AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)
"""

OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
           FROM documents),
w AS (SELECT rid, p, md5(array_to_string(ws[p:p + 34], ' ')) AS h
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS p FROM d WHERE len(ws) >= 35)),
rep AS (SELECT rid, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT rid, unnest(range(p, p + 35)) AS p FROM rep),
words AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_removed FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN n USING (rid)
"""

OP5 = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x
           FROM documents),
k AS (SELECT rid, length(x) // 2 AS n, k, substr(x, 400 * k + 1, 598) AS b
      FROM (SELECT rid, x, unnest(range(0, length(x) // 400 + 1)) AS k FROM d WHERE length(x) >= 200)),
w AS (SELECT rid, 200 * k + j AS p, md5_number(substr(b, 2 * j - 1, 200)) AS h
      FROM (SELECT rid, n, k, b, unnest(range(1, 201)) AS j FROM k) WHERE 200 * k + j + 99 <= n),
f AS (SELECT h, min((rid, p)) AS earliest FROM w GROUP BY h HAVING count(*) > 1),
rep AS (SELECT rid, p FROM w JOIN f USING (h) WHERE (rid, p) <> earliest),
brk AS (SELECT rid, p, CAST(p > coalesce(lag(p) OVER (PARTITION BY rid ORDER BY p), -1000) + 100 AS INT) AS opens FROM rep),
isl AS (SELECT rid, p, sum(opens) OVER (PARTITION BY rid ORDER BY p) AS g FROM brk),
span AS (SELECT rid, min(p) AS a, max(p) + 99 AS b FROM isl GROUP BY rid, g),
gap AS (SELECT rid, a, b, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) + 1 AS s FROM span),
kept AS (SELECT rid, sum(b - a + 1) AS n_removed, count(*) AS n_spans, max(b) AS last,
                string_agg(substr(x, 2 * s - 1, 2 * (a - s)), '' ORDER BY a) AS t FROM gap JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(t, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

OP8 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(ws[p:p + 3], ' ') AS g
      FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
pairs AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b USING (g) GROUP BY a.rid, b.rid),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
c AS (SELECT x AS rid, min(doc_id) AS component_id FROM reach JOIN d ON d.rid = y GROUP BY x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       doc_id = coalesce(component_id, doc_id) AS kept
FROM d LEFT JOIN n USING (rid) LEFT JOIN c USING (rid)
"""

OP11 = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY body) AS least FROM t),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END
             || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
      FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
o(filter_order) AS (
  SELECT '' UNION ALL
  SELECT filter_order || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
      FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
m AS (SELECT s.*, c.*, contains(fails, own) AS failing, translate(fails, before, '') = fails AS reached FROM s, c),
a AS (SELECT part, filter_order, step, own,
             sum(CASE WHEN reached AND NOT failing THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN reached AND failing THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN failing AND NOT reached THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN reached AND failing THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN reached AND failing THEN toxic ELSE 0 END) AS toxic_lost
      FROM m GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley, own AS filter
FROM a
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
             lambda i: [ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INT), 1)), -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda acc, e: CASE WHEN e >= 0 THEN xor(acc, e) WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END)) AS h
  FROM documents),
e AS (SELECT *, len(ws) AS n, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM e),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(0, n), lambda i:
             ws[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) END AS ws FROM p),
six AS (SELECT rid, x, md5(array_to_string(ws[x + 1:x + 6], ' ')) AS gram
        FROM (SELECT rid, ws, unnest(range(0, n - 5)) AS x FROM t WHERE n >= 6)),
twice AS (SELECT * FROM six QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
same AS (SELECT u.rid, u.x, v.x - u.x AS q FROM twice u JOIN twice v ON u.rid = v.rid AND u.gram = v.gram AND u.x < v.x),
isl AS (SELECT rid, q, x, x - row_number() OVER (PARTITION BY rid, q ORDER BY x) AS k FROM same),
stretch AS (SELECT rid, q, min(x) AS s, max(x) + 6 + q AS e FROM isl GROUP BY rid, q, k),
runs AS (SELECT rid, s AS start, e - s AS length, min(q) AS period FROM stretch
         WHERE e - s >= greatest(12, 2 * q) GROUP BY rid, s, e),
r AS (SELECT rid, count(*) AS n_runs, string_agg(concat_ws(',', start, length, period) || chr(10), '' ORDER BY start, period) AS lines,
             max_by((start, length, period), (length, -start, -period)) AS best FROM runs GROUP BY rid),
lost AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT w.rid, string_agg(word, ' ' ORDER BY i) AS body
         FROM (SELECT rid, unnest(ws) AS word, unnest(range(0, n)) AS i FROM t WHERE n > 0) w ANTI JOIN lost USING (rid, i)
         GROUP BY w.rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best[1] AS BIGINT) AS start, CAST(best[2] AS BIGINT) AS length,
       CAST(best[3] AS BIGINT) AS period, CAST(1000 * best[2] // best[3] AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM t LEFT JOIN r USING (rid) LEFT JOIN kept USING (rid)
"""
