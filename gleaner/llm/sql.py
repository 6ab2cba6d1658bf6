"""DuckDB SQL for the operators that SQL can express, by plain definitions rather than by the operators' methods."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS m FROM x GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM x JOIN f ON x.h = f.h AND f.m < doc_id),
k AS (SELECT doc_id, k, word FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d) WHERE (doc_id, k) NOT IN (SELECT doc_id, k FROM c)),
s AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_transform({_WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.c),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.id = d.doc_id
"""

REPEATED_BYTES = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS t FROM documents),
x AS (SELECT doc_id, i, md5(substr(t, 2 * i + 1, 200)) AS h FROM (SELECT doc_id, t, unnest(range(0, length(t) // 2 - 99)) AS i FROM d)),
f AS (SELECT h, min((doc_id, i)) AS m FROM x GROUP BY h HAVING count(*) > 1),
z AS (SELECT doc_id, i FROM x JOIN f ON x.h = f.h WHERE f.m <> (doc_id, i)),
g AS (SELECT doc_id, i, coalesce(i > 100 + lag(i) OVER (PARTITION BY doc_id ORDER BY i), true) AS fresh FROM z),
q AS (SELECT doc_id, i, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
u AS (SELECT doc_id, run, min(i) AS low, max(i) + 100 AS high FROM q GROUP BY doc_id, run),
v AS (SELECT doc_id, low, high, lag(high) OVER (PARTITION BY doc_id ORDER BY low) AS before FROM u),
k AS (SELECT d.doc_id, coalesce(string_agg(substr(t, 2 * coalesce(before, 0) + 1, 2 * (low - coalesce(before, 0))), '' ORDER BY low), '') || substr(any_value(t), 2 * coalesce(max(high), 0) + 1) AS kept,
coalesce(sum(high - low), 0) AS removed, count(*) FILTER (WHERE low IS NOT NULL AND (before IS NULL OR before < low)) AS spans FROM d LEFT JOIN v ON v.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, CAST(length(t) // 2 AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN k ON k.doc_id = d.doc_id
"""

SHARDS = """
WITH t AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([CAST(i AS BIGINT), 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, CAST(length(h) // 2 + 1 AS BIGINT) AS size,
xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM b, t),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32) AS upto, sum(size) OVER () AS total FROM s),
a AS (SELECT *, CAST((2 * upto - size) * 8 // (2 * total) AS INTEGER) AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM a
"""

NEGATIVES = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
g AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT g.*, p.id AS negative_id, p.score AS negative_score, row_number() OVER (PARTITION BY g.anchor_id, positive_id ORDER BY p.score DESC, p.id) AS r FROM g JOIN p ON p.anchor_id = g.anchor_id AND NOT p.same AND 80 * positive_score <= 100 * p.score AND p.score <= positive_score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 5
"""

SQL = {"op1_cover_substrings": SUBSTRINGS, "op2_fast_sketch_neardup": NEAR_DUPLICATES, "op7_suffix_collections": REPEATED_BYTES, "op8_byte_shards": SHARDS, "op13_slot_negatives": NEGATIVES}
