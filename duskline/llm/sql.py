"""DuckDB SQL of the operators that SQL can express."""

CHAT = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text,
    sha256(coalesce(length(role) || ':' || role, '-1:') || coalesce(length(text) || ':' || text, '-1:')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST)
), c AS (
  SELECT conv_id, list(k ORDER BY i) AS ks, any_value(n_turns) AS n_turns,
    string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY i) AS rendered
  FROM n GROUP BY conv_id
), d AS (
  SELECT *, list_reduce(list_prepend('', ks), lambda a, k: sha256(a || k)) AS digest FROM c
), p AS (
  SELECT DISTINCT list_reduce(list_prepend('', ks[1:i]), lambda a, k: sha256(a || k)) AS digest
  FROM (SELECT ks, unnest(range(1, len(ks))) AS i FROM c)
), l AS (
  SELECT digest, min(conv_id) AS conv_id, count(*) AS n_snapshots FROM d GROUP BY digest
)
SELECT l.conv_id, d.n_turns, l.n_snapshots, l.digest, d.rendered
FROM l JOIN d ON d.conv_id = l.conv_id WHERE l.digest NOT IN (SELECT digest FROM p)
"""

MIX = """
WITH b AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5('mix' || coalesce(doc_id::VARCHAR, '')) AS d
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM b GROUP BY source
), w AS (
  SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s
), lv AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER up, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0))::DOUBLE AS level
  FROM w WINDOW up AS (ORDER BY cap::DOUBLE / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, (SELECT level FROM lv WHERE level * weight <= cap ORDER BY cap::DOUBLE / weight, i LIMIT 1) AS fair FROM lv
), tg AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(fair * weight, cap::DOUBLE)) AS target FROM f
), cum AS (
  SELECT b.*, row_number() OVER o AS k, sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM b WINDOW o AS (PARTITION BY source ORDER BY d, doc_id, size)
), e AS (
  SELECT c.*, t.source_size, t.target, unnest(range(0, least(ceil(t.target / t.source_size), 3)::BIGINT)) AS e
  FROM cum c JOIN tg t ON c.source IS NOT DISTINCT FROM t.source WHERE c.size > 0 AND t.target > 0
), r AS (
  SELECT source, k, size, sum(size) OVER (ORDER BY (e * source_size + cum)::DOUBLE / target, source NULLS LAST, e, d, doc_id, size, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM e
), took AS (
  SELECT source, k, sum(size)::BIGINT AS taken FROM r WHERE run <= (SELECT round(sum(target)) FROM tg) GROUP BY source, k
)
SELECT c.doc_id, c.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM cum c JOIN tg t ON c.source IS NOT DISTINCT FROM t.source
LEFT JOIN took k ON k.source IS NOT DISTINCT FROM c.source AND k.k = c.k
"""

JACCARD = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : least(i + 4, len(w))], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
  HAVING 100 * count(*) >= 75 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*))
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), c AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, c.c FROM c JOIN e ON e.a = c.doc_id
)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM c LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

SUFFIXES = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), p AS (
  SELECT doc_id, i, md5(substr(x, 2 * i - 1, 200)) AS g FROM (SELECT doc_id, x, unnest(range(1, length(x) // 2 - 98)) AS i FROM d)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM p) WHERE k > 1
), s AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
    SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM r)
), g AS (
  SELECT doc_id, min(i) AS a, max(i) + 99 AS b FROM s GROUP BY doc_id, run
), k AS (
  SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM g GROUP BY doc_id
)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE substr(x, 1, 2 * starts[1] - 2) ||
    array_to_string(list_transform(range(1, n_spans + 1), lambda j: substr(x, 2 * ends[j] + 1, 2 * (coalesce(starts[j + 1], length(x) // 2 + 1) - ends[j] - 1))), '') END)) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

RETENTION = """
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), k AS (
  SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL
), h AS (
  SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(click_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM k, crc
), a AS (
  SELECT *, coalesce(arrived_at + CASE WHEN h % 3 = 0 THEN to_days((h % 100)::INTEGER) ELSE to_days(0) END < TIMESTAMP '2024-02-01', false) AS known0 FROM h
), s AS (
  SELECT *, min(CASE WHEN kind = 'error' AND known0 THEN ts END) OVER w AS start0, min(CASE WHEN kind = 'error' THEN ts END) OVER w AS start1
  FROM a WINDOW w AS (PARTITION BY client_id)
), e AS (
  SELECT client_id, 0 AS state, ts, value, start0 AS start, start0, start1 FROM s WHERE known0 AND ts >= start0
  UNION ALL SELECT client_id, 1, ts, value, start1, start0, start1 FROM s WHERE ts >= start1
), u AS (
  SELECT client_id, state, floor((start::DATE - DATE '1970-01-01') / 7)::BIGINT AS cohort, (epoch_us(ts) - epoch_us(start)) // 604800000000 AS period,
    coalesce(floor((start0::DATE - DATE '1970-01-01') / 7) <> floor((start1::DATE - DATE '1970-01-01') / 7), false) AS moved,
    sum(coalesce(floor(100 * value + 0.5)::BIGINT, 0)) AS cents
  FROM e GROUP BY ALL
), g AS (
  SELECT client_id, max(source) AS segment FROM clients GROUP BY client_id
), c AS (
  SELECT client_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(client_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM (SELECT DISTINCT client_id FROM u), crc
)
SELECT state, coalesce(segment, '') AS segment, cohort, period, count(*) AS users, sum(crc)::BIGINT AS users_crc32, count(*) FILTER (moved) AS moved, sum(cents)::BIGINT AS cents
FROM u JOIN c USING (client_id) LEFT JOIN g USING (client_id) GROUP BY ALL
"""
