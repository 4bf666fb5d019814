"""The registered queries of the operators and their DuckDB SQL, where SQL can express the result."""

from __future__ import annotations

from . import decontaminate, embedding_dedup, exact_dedup, language_id, license_scan, mixing, pii, resampling, secret_scan, simhash, toxicity, vector_codes, warc
from .common import read_table

QUERIES = {
    "op1_secret_scan": lambda spark, sf_dir: secret_scan.report(read_table(spark, sf_dir, "documents")),
    "op2_exact_dedup": lambda spark, sf_dir: exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents")),
    "op3_warc": lambda spark, sf_dir: warc.report(read_table(spark, sf_dir, "pages")),
    "op4_pii": lambda spark, sf_dir: pii.report(read_table(spark, sf_dir, "documents")),
    "op5_toxicity": lambda spark, sf_dir: toxicity.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")),
    "op6_license_scan": lambda spark, sf_dir: license_scan.report(read_table(spark, sf_dir, "documents")),
    "op7_mixing": lambda spark, sf_dir: mixing.mix(read_table(spark, sf_dir, "documents")),
    "op8_language_id": lambda spark, sf_dir: language_id.report(read_table(spark, sf_dir, "documents")),
    "op9_simhash": lambda spark, sf_dir: simhash.report(read_table(spark, sf_dir, "documents")),
    "op10_decontamination": lambda spark, sf_dir: decontaminate.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")),
    "op11_vector_codes": lambda spark, sf_dir: vector_codes.report(read_table(spark, sf_dir, "embeddings")),
    "op12_embedding_dedup": lambda spark, sf_dir: embedding_dedup.report(read_table(spark, sf_dir, "embeddings")),
    "op13_importance_resampling": lambda spark, sf_dir: resampling.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")),
}

#: One k-means round over integer parts: the nearest entry of each part, then floored means; unused entries stay.
_ROUND = """
a{n} AS (SELECT v.rid, v.p, v.x, min(struct_pack(d := list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.c[i]) * (v.x[i] - b.c[i])))::BIGINT, e := b.e)) AS m
  FROM parts v JOIN b{n} b USING (p) GROUP BY v.rid, v.p, v.x),
"""
_MEANS = """
u{n} AS (SELECT p, e, list(s ORDER BY i) AS c FROM (
    SELECT p, m.e AS e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS s FROM (SELECT p, m, x, unnest(range(1, len(x) + 1)) AS i FROM a{n}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{next} AS (SELECT p, e, coalesce(u.c, b.c) AS c FROM b{n} b LEFT JOIN u{n} u USING (p, e)),
"""

ORACLES = {
    "op3_warc": """
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS digest,
             max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
""",
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
    "op7_mixing": r"""
WITH sizes AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sizes GROUP BY source),
ord AS (
  SELECT *, row_number() OVER o AS k,
         sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS full_before,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
         sum(source_size) OVER () AS total
  FROM src WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
lev AS (
  SELECT *, (150 * total - 200 * coalesce(full_before, 0))::DOUBLE / (100 * open_weight)::DOUBLE AS level FROM ord),
lvl AS (SELECT level FROM lev WHERE NOT (2.0::DOUBLE * source_size < level * weight) ORDER BY k LIMIT 1),
goal AS (
  SELECT source, source_size, CASE WHEN 2.0::DOUBLE * source_size < level * weight THEN 2.0::DOUBLE * source_size ELSE level * weight END AS target
  FROM src, lvl),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM goal),
quota AS (SELECT *, floor(target)::BIGINT - whole * source_size AS quota FROM plan),
ranked AS (
  SELECT s.*, q.source_size, q.target, q.whole, q.quota,
         CASE WHEN q.quota > 0 THEN (u / (1.0::DOUBLE - u)) / ((q.quota::DOUBLE / q.source_size) / (1.0::DOUBLE - q.quota::DOUBLE / q.source_size)) END AS rnk
  FROM sizes s JOIN quota q ON s.source IS NOT DISTINCT FROM q.source),
one AS (
  SELECT *, rnk IS NOT NULL AND sum(size) OVER (PARTITION BY source ORDER BY rnk RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= quota AS first
  FROM ranked),
gap AS (SELECT *, quota - coalesce(sum(size) FILTER (WHERE first) OVER (PARTITION BY source), 0) AS gap FROM one),
two AS (
  SELECT *, rnk IS NOT NULL AND NOT first AND size <= gap AS eligible FROM gap),
fill AS (
  SELECT *, eligible AND sum(CASE WHEN eligible THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rnk RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= gap AS second
  FROM two)
SELECT doc_id, size::BIGINT AS size, source_size, target, ((whole + first::INT + second::INT) * size)::BIGINT AS taken FROM fill
""",
    "op10_decontamination": r"""
WITH items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
known AS (
  SELECT DISTINCT item, w[i + 1 : i + least(10, len(w))] AS win
  FROM (SELECT item, w, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (
  SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM docs),
lens AS (SELECT DISTINCT len(win) AS l FROM known),
spots AS (
  SELECT rid, i, l, w[i + 1 : i + l] AS win FROM (SELECT rid, w, l, unnest(range(0, len(w) - l + 1)) AS i FROM words, lens WHERE len(w) >= l)),
hits AS (SELECT rid, i, l, item FROM spots JOIN known USING (win)),
hit_words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM hits) GROUP BY rid),
hit_items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
""",
    "op11_vector_codes": """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256::DOUBLE * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT rid, p, x[p * (len(x) // 16) + 1 : (p + 1) * (len(x) // 16)] AS x FROM (SELECT rid, x, unnest(range(0, 16)) AS p FROM kept)),
b0 AS (SELECT p, rid AS e, x AS c FROM parts WHERE rid < 64),
"""
    + _ROUND.format(n=0) + _MEANS.format(n=0, next=1) + _ROUND.format(n=1) + _MEANS.format(n=1, next=2) + _ROUND.format(n=2)
    + """
coded AS (SELECT rid, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       sha256((SELECT string_agg(v, ',' ORDER BY p, e, i) FROM (SELECT p, e, unnest(range(1, len(c) + 1)) AS i, unnest(c)::VARCHAR AS v FROM b2))) AS codebooks_sha256
FROM coded JOIN kept USING (rid)
""",
    "op12_embedding_dedup": """
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS v,
         label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine
  FROM embeddings),
links AS (
  SELECT a.rid AS a, b.rid AS b FROM rows a JOIN rows b ON a.label = b.label AND len(a.v) = len(b.v)
  WHERE a.fine AND b.fine AND a.rid <> b.rid AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT rid AS a, rid AS b FROM rows UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS rid, min(vec_id) AS component_id FROM reach JOIN rows ON b = rid GROUP BY 1),
n AS (SELECT a AS rid, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM rows JOIN low USING (rid) LEFT JOIN n USING (rid)
""",
    "op13_importance_resampling": r"""
WITH RECURSIVE crc_step AS (
  SELECT i, i AS v, 0 AS k FROM (SELECT unnest(range(0, 256))::BIGINT AS i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(3988292384::BIGINT, v // 2) ELSE v // 2 END, k + 1 FROM crc_step WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc_step WHERE k = 8),
texts AS (
  SELECT 0 AS kind, row_number() OVER () AS rid, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT kind, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
each_word AS (SELECT kind, rid, unnest(w) AS word FROM words),
buckets AS (
  SELECT word, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(hex(word)) // 2), lambda i: ('0x' || substr(hex(word), (2 * i + 1)::INTEGER, 2))::BIGINT)),
                   lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM each_word), tab),
counts AS (SELECT bucket, count(*) FILTER (WHERE kind = 0) AS s, count(*) FILTER (WHERE kind = 1) AS t FROM each_word JOIN buckets USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM counts) + 10000))::DOUBLE / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000))::DOUBLE))::BIGINT AS g FROM counts),
weights AS (SELECT rid, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM each_word JOIN buckets USING (word) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY rid),
scored AS (
  SELECT rid, doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (rid) WHERE kind = 0),
ranked AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (rid)
""",
}
