WITH RECURSIVE w AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g'), '[ \t\n\r\f\v]+') AS w
           FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND regexp_matches(text, '[^ \t\n\r\f\v]'))),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(0, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i + 1 : i + 3], ' ')))) AS s FROM w),
f AS (SELECT s, min(doc_id) AS d, len(s) AS n, count(*) AS docs FROM s GROUP BY s),
t AS (SELECT d, n, unnest(s) AS g FROM f),
o AS (SELECT a.d AS a, b.d AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM t a JOIN t b ON a.g = b.g AND a.d <> b.d GROUP BY a.d, b.d),
e AS (SELECT a, b, docs FROM o JOIN f ON f.d = b WHERE c / (na + nb - c) >= 0.6 - 1e-12),
r AS (SELECT d, d AS c FROM f UNION SELECT e.b, r.c FROM r JOIN e ON r.d = e.a),
k AS (SELECT d, min(c) AS c FROM r GROUP BY d),
l AS (SELECT a AS d, sum(docs) AS near FROM e GROUP BY a)
SELECT doc_id, c AS class_id, (coalesce(near, 0) + docs - 1)::BIGINT AS n_links FROM s JOIN f USING (s) JOIN k USING (d) LEFT JOIN l USING (d)
UNION ALL SELECT DISTINCT doc_id, doc_id, 0::BIGINT FROM documents WHERE doc_id IS NOT NULL AND (text IS NULL OR NOT regexp_matches(text, '[^ \t\n\r\f\v]'))
