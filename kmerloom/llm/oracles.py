"""SQL of the operators that SQL can express, over the same tables. These are plain definitions, for small tables: they compare what the operators avoid to compare."""

_WORD = r"[^\x20\x09-\x0D]+"

#: Windows of 50 words as strings; the words that a window with a smaller first document covers go.
SUBSTRING_DEDUP = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM docs WHERE len(ws) >= 50)),
firsts AS (SELECT win, min(doc_id) AS first_doc FROM windows GROUP BY win HAVING count(DISTINCT doc_id) > 1),
hits AS (SELECT windows.doc_id, i FROM windows JOIN firsts USING (win) WHERE windows.doc_id > first_doc),
last AS (SELECT words.doc_id, words.i, w, max(hits.i) OVER (PARTITION BY words.doc_id ORDER BY words.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS covered_from FROM words LEFT JOIN hits ON hits.doc_id = words.doc_id AND hits.i = words.i),
flagged AS (SELECT doc_id, i, w, coalesce(i - covered_from < 50, false) AS gone FROM last),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT gone), '') AS t FROM flagged GROUP BY doc_id)
SELECT docs.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)
"""

#: Sets of 3-word shingles joined by their shingles; components by their smallest document.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
cut AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM docs WHERE len(ws) > 0),
sets AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS shingle FROM cut),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * common >= 85 * (p.n + q.n - common)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
walk(node, label) AS (SELECT DISTINCT x, x FROM edges UNION SELECT edges.y, label FROM walk JOIN edges ON edges.x = node WHERE label < edges.y),
found AS (SELECT node, min(label) AS label FROM walk GROUP BY node)
SELECT docs.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(label, docs.doc_id) AS component_id, coalesce(label, docs.doc_id) = docs.doc_id AS kept
FROM docs LEFT JOIN sizes ON sizes.doc_id = docs.doc_id LEFT JOIN found ON node = docs.doc_id
"""

#: All products of the queries with all rows, the five highest of each.
TOP_PRODUCTS = """
WITH good AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
vecs AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM good),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM vecs q JOIN vecs c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS "rank", vec_id, score FROM scored)
SELECT * FROM ranked WHERE "rank" <= 5
"""

#: Strings of 100 bytes as hexadecimal text; the bytes that a string with an earlier first place covers go.
SUFFIX_ARRAY_DEDUP = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, unnest(range(0, len(h) // 2)) AS i FROM docs),
pieces AS (SELECT doc_id, p * 1000 AS base, substr(h, p * 2000 + 1, 2198) AS piece FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0) // 1000 + 1)) AS p FROM docs)),
windows AS (SELECT doc_id, base + j AS i, md5(substr(piece, j * 2 + 1, 200)) AS win FROM (SELECT doc_id, base, piece, unnest(range(0, least(1000, greatest(len(piece) // 2 - 99, 0)))) AS j FROM pieces)),
ordered AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS turn FROM windows),
last AS (SELECT bytes.doc_id, bytes.i, max(o.i) OVER (PARTITION BY bytes.doc_id ORDER BY bytes.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS covered_from FROM bytes LEFT JOIN (SELECT doc_id, i FROM ordered WHERE turn > 1) o ON o.doc_id = bytes.doc_id AND o.i = bytes.i),
flagged AS (SELECT doc_id, i, coalesce(i - covered_from < 100, false) AS gone FROM last),
edged AS (SELECT *, lag(gone) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM flagged),
runs AS (SELECT doc_id, i, gone, sum(CASE WHEN before IS DISTINCT FROM gone THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edged),
stretches AS (SELECT doc_id, run, gone, min(i) AS lo, count(*) AS n FROM runs GROUP BY doc_id, run, gone),
kept AS (SELECT doc_id, sum(n) AS n_bytes, coalesce(sum(n) FILTER (gone), 0) AS n_removed, count(*) FILTER (gone) AS n_spans, coalesce(string_agg(substr(h, lo * 2 + 1, n * 2), '' ORDER BY lo) FILTER (NOT gone), '') AS t FROM stretches JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT docs.doc_id, CAST(coalesce(n_bytes, 0) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)
"""
