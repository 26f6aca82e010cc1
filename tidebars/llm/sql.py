"""The SQL that the operators' queries are held against, where SQL can say it."""

from __future__ import annotations

#: Lower-cased words of a text, by the contract.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

op11_hard_negatives = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM r AS a, r WHERE a.id % 100 = 0 AND a.id <> r.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""

#: crc32 of a word's bytes (in hexadecimal digits), by the usual table of 256 remainders.
CRC = """xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"""

op13_importance = f"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, n)) AS t),
d AS (SELECT row_number() OVER () AS row, doc_id, {WORDS} AS w FROM documents), b AS (SELECT {WORDS} AS w FROM benchmark),
dw AS (SELECT row, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM b),
vocabulary AS (SELECT word, {CRC} % 10000 AS bucket FROM (SELECT word, lower(hex(encode(word))) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)), tab),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN vocabulary USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM bw JOIN vocabulary USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS s, (SELECT count(*) FROM bw)::DOUBLE AS t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * (sums.s + 10000) / ((s.n + 1.0::DOUBLE) * (sums.t + 10000)))) AS g FROM s LEFT JOIN t USING (bucket), sums),
weights AS (SELECT row, floor(sum(g) / count(*))::BIGINT AS weight FROM dw JOIN vocabulary USING (word) JOIN gain USING (bucket) GROUP BY row),
scored AS (
  SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS eligible,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (row)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY eligible) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in globals().items() if k.startswith("op")}
