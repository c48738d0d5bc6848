WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(range(0, len(l))) AS k, l FROM l)
SELECT doc_id, k::INTEGER AS unit, 1::INTEGER AS program, 257::INTEGER AS pid, 27::INTEGER AS stream_type, 3600 * k AS pts, NULL::BIGINT AS dts, k % 8 = 0 AS random_access,
       false AS broken, octet_length(encode(l[k + 1]))::INTEGER AS n_bytes, md5(l[k + 1]) AS digest FROM u
