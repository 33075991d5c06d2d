"""DuckDB SQL of the training-data queries that SQL can express."""

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
OF_SPACE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, regexp_extract_all(body, '{WORD}') AS words, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
win AS (SELECT r, i, array_to_string(words[i:i+4], ' ') AS g FROM w, unnest(generate_series(1, len(words) - 4)) AS s(i) WHERE len(words) >= 5),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(0, 5) AS o(k) GROUP BY r),
base AS (SELECT w.r, doc_id, source, body, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
  length(body) - length(translate(body, '#*$%&|<>', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, lines
  FROM w LEFT JOIN cov USING (r)),
l AS (SELECT r, doc_id, source, body, n_words, len(regexp_extract_all(x, '{WORD}')) AS n,
  trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '{SPACES}', ' ', 'g')) AS line
  FROM base, unnest(lines) AS u(x)),
h AS (SELECT source, count(DISTINCT body) AS host_docs FROM d GROUP BY source),
f AS (SELECT l.source, line, min(doc_id) AS first_doc FROM l GROUP BY l.source, line
  HAVING count(DISTINCT body) > 20 AND count(DISTINCT body) > 0.02 * (SELECT host_docs FROM h WHERE h.source IS NOT DISTINCT FROM l.source)),
lost AS (SELECT r, sum(n) AS n_lost FROM l JOIN f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source WHERE l.doc_id IS DISTINCT FROM f.first_doc GROUP BY r),
v AS (SELECT base.*, n_words - coalesce(n_lost, 0) AS n_left, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base LEFT JOIN lost USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND n_left >= 10 AND n_left >= n_words * 0.2 AS kept, CAST(n_left AS BIGINT) AS n_words_left
FROM v
"""

OP7 = rf"""
WITH rows AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
k AS (SELECT *, CASE WHEN size > 0 THEN length(ltrim(bin(size), '0')) ELSE 0 END AS class FROM rows),
classes AS (SELECT source, class, CAST(sum(size) AS BIGINT) AS class_size FROM k GROUP BY source, class),
sizes AS (SELECT source, CAST(sum(class_size) AS BIGINT) AS source_size FROM classes GROUP BY source),
t1 AS (SELECT *, CAST([3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight, source_size * CAST(2.0 AS DOUBLE) AS most FROM sizes),
t2 AS (SELECT *, most / weight AS level FROM t1),
t3 AS (SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - (sum(most) OVER b - most)) / (sum(weight) OVER () - sum(weight) OVER b + weight) AS fill
  FROM t2 WINDOW b AS (ORDER BY level, source ASC NULLS LAST)),
t4 AS (SELECT source, source_size, least(most, coalesce((SELECT fill FROM t3 WHERE level >= fill ORDER BY level, fill LIMIT 1), 0) * weight) AS target FROM t3),
p1 AS (SELECT classes.*, source_size, target, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole
  FROM classes JOIN t4 ON classes.source IS NOT DISTINCT FROM t4.source),
p2 AS (SELECT *, target - whole * source_size AS rest, sum(class_size) OVER d - class_size AS above,
  sum(class * class_size) OVER s - sum(class * class_size) OVER d + class * class_size AS mass_left
  FROM p1 WINDOW s AS (PARTITION BY source), d AS (PARTITION BY source ORDER BY class DESC)),
p3 AS (SELECT *, CASE WHEN mass_left > 0 THEN (rest - above) / CAST(mass_left AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS factor FROM p2),
p4 AS (SELECT *, arg_max(factor, class) FILTER (WHERE factor * class <= 1) OVER (PARTITION BY source) AS c FROM p3),
p5 AS (SELECT *, greatest(0, least(1, coalesce(c, 1) * class)) AS p FROM p4),
p6 AS (SELECT *, CAST(p >= 1 AS BIGINT) AS sure, rest - sum(CASE WHEN p >= 1 THEN class_size ELSE 0 END) OVER (PARTITION BY source) AS quota FROM p5),
r1 AS (SELECT k.*, source_size, target, p, quota, whole + sure AS sure_copies, sure = 0 AND p > 0 AS drawn,
  (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(281474976710656 AS DOUBLE) AS u
  FROM k JOIN p6 ON k.source IS NOT DISTINCT FROM p6.source AND k.class = p6.class),
r2 AS (SELECT *, CASE WHEN drawn THEN (u / (1 - u)) / (p / (1 - p)) END AS rnk FROM r1),
r3 AS (SELECT *, CASE WHEN drawn THEN coalesce(sum(size) FILTER (WHERE drawn) OVER (PARTITION BY source ORDER BY rnk, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS start,
  CAST(floor(rnk / (1 + rnk) * 65536) AS BIGINT) AS bin FROM r2)
SELECT doc_id, size, source_size, target,
  CAST((sure_copies + CASE WHEN drawn AND start + size / CAST(2 AS DOUBLE) <= quota THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r3
"""

OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS a FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.a) + 1), lambda i: q.a[i] * c.a[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.a) = len(c.a) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""

#: A list of the 256 values of the crc32 table, and crc32 of a list of bytes.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS t"
CRC = "xor(list_reduce(list_concat([4294967295], {bytes}), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295)"
UTF8 = "list_transform(range(1, octet_length(encode({x})) + 1), lambda i: CAST('0x' || substr(hex(encode({x})), CAST(2 * i - 1 AS INT), 2) AS BIGINT))"

OP11 = rf"""
WITH crc AS ({CRC_TABLE}),
w AS (SELECT 0 AS target, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
d AS (SELECT target, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM w),
g AS (SELECT target, r, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]),
  list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) AS x FROM d),
c AS (SELECT target, r, x, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY ALL),
f AS (SELECT x, {CRC.format(bytes=UTF8.format(x="x"))} % 10000 AS bucket FROM (SELECT DISTINCT x FROM c), crc),
b AS (SELECT bucket, CAST(sum(CASE WHEN target = 0 THEN n ELSE 0 END) AS DOUBLE) AS s, CAST(sum(CASE WHEN target = 1 THEN n ELSE 0 END) AS DOUBLE) AS t FROM c JOIN f USING (x) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(CAST(1000 AS DOUBLE) * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM b),
weighed AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM c JOIN f USING (x) JOIN gain USING (bucket) WHERE target = 0 GROUP BY r),
scored AS (SELECT d.r, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(CAST(-1000 AS DOUBLE) *
  ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM d LEFT JOIN weighed USING (r) WHERE target = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * fit // 100 THEN place END AS rank FROM k
"""

OP13 = rf"""
WITH crc AS ({CRC_TABLE}),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, substr(sha256(CAST(length(role) AS VARCHAR) || ':' || role || text), 1, 32)) AS turns FROM t GROUP BY conv_id),
h AS (SELECT conv_id, turns, {CRC.format(bytes=UTF8.format(x="CAST(conv_id AS VARCHAR)"))} % 4 AS h FROM c, crc),
r AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h], []), h.turns[h + 1:]) AS turns FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, k AS depth, turns[1:k] AS path, len(turns) = k AS ends FROM r, unnest(range(0, len(turns) + 1)) AS u(k)),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
  CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(path[-1].text, '{WORD}')) END AS saved FROM p GROUP BY depth, path),
k AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
a AS (SELECT n.path[1:up] AS path, up AS depth, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves
  FROM n LEFT JOIN k ON n.path = k.path AND n.depth = k.depth, unnest(range(0, n.depth + 1)) AS u(up) GROUP BY ALL)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, a.n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN a ON n.path = a.path AND n.depth = a.depth LEFT JOIN k ON n.path = k.path AND n.depth = k.depth LEFT JOIN n m ON m.depth = n.depth - 1 AND m.path = n.path[1:n.depth - 1]
"""

ORACLE_SQL = {"op13_conversation_prefix_trie": OP13, "op11_importance_resampling": OP11, "op3_line_frequency": OP3, "op7_pareto_mixing": OP7, "op8_bit_sliced_top_k": OP8}
