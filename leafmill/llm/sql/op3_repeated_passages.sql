WITH w AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g'), '[ \t\n\r\f\v]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM w WHERE len(w) >= 50),
g AS (SELECT doc_id, i, hash(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM p),
f AS (SELECT h, min({'d': doc_id, 'i': i}) AS m FROM g GROUP BY h HAVING count(*) > 1),
r AS (SELECT doc_id, i, m.d AS fd, m.i AS fi FROM g JOIN f USING (h) WHERE NOT (doc_id = m.d AND i = m.i)),
s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, fd, i - fi ORDER BY i) AS island FROM r)
SELECT doc_id, min(i) AS start_word, count(*) + 49 AS n_words, fd AS first_doc_id, min(fi) AS first_start_word FROM s GROUP BY doc_id, fd, i - fi, island
