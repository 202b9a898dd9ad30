"""DuckDB SQL for the queries that SQL can express on whole tables."""

#: Full shingle sets, all links of 0.85 or more, and the smallest doc_id reachable.
OP3 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id AND r.c < e.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id),
k AS (SELECT list_sort(sh) AS k, count(*) AS class_size FROM s GROUP BY 1)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.component_id, CAST(CASE WHEN len(sh) = 0 THEN 1 ELSE class_size END AS BIGINT) AS class_size, m.component_id = s.doc_id AS kept FROM s JOIN m ON m.doc_id = s.doc_id JOIN k ON k.k = list_sort(sh)
"""
