WITH RECURSIVE v AS (SELECT DISTINCT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND len(a.v) = len(b.v) AND list_distance(a.v::DOUBLE[], b.v::DOUBLE[]) <= 0.3),
r AS (SELECT id, id AS c FROM v UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT id AS vec_id, min(c) AS class_id, coalesce(any_value(n), 0)::BIGINT AS n_links FROM r LEFT JOIN n ON n.a = id GROUP BY id
