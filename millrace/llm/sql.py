"""The same results in SQL where it can express them."""

from __future__ import annotations

_BARE = "lower(trim({0}, e' \\t\\r\\n'))"
_SRC, _FAM, _BKT = (_BARE.format(c) for c in ("source", "family", "bucket"))

_TIED = f"""
keys AS (
  SELECT DISTINCT qid, k FROM (
    SELECT qid, CASE WHEN {_FAM} <> '' THEN 'f:' || {_FAM} END AS k FROM query_spec
    UNION ALL
    SELECT qid, CASE WHEN {_SRC} NOT IN ('', 'unknown') THEN 's:' || {_SRC} END FROM query_spec)
  WHERE k IS NOT NULL AND qid IS NOT NULL),
edges AS (SELECT DISTINCT a.k AS x, b.k AS y FROM keys a JOIN keys b USING (qid)),
reach(x, y) AS (
  SELECT k, k FROM keys
  UNION
  SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
roots AS (SELECT x, min(y) AS root FROM reach GROUP BY x),
tied AS (SELECT DISTINCT k.qid, r.root FROM keys k JOIN roots r ON k.k = r.x),
firsts AS (SELECT root, min(qid) AS comp FROM tied GROUP BY root),
sets AS (SELECT qid, comp FROM tied JOIN firsts USING (root))
"""

_P3 = """
WITH m AS (
  SELECT system, qid, doc_id, max(score) + 0.0 AS score FROM scored_point
  WHERE isfinite(score) AND system IS NOT NULL AND qid IS NOT NULL AND doc_id IN (SELECT doc_id FROM bank WHERE doc_id IS NOT NULL)
  GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY system, qid ORDER BY score DESC, doc_id) AS rn FROM m)
SELECT {cols} FROM r WHERE rn <= 5
"""

_P2 = """
WITH ok AS (
  SELECT doc_id, vector::DOUBLE[] AS v, row_number() OVER (PARTITION BY doc_id ORDER BY encoded_at DESC NULLS LAST, vector DESC) AS rn
  FROM bank
  WHERE doc_id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    AND len(list_filter(vector, lambda x: x <> 0)) > 0),
u AS (SELECT doc_id, v, sqrt(list_inner_product(v, v)) AS n FROM ok WHERE rn = 1),
s AS (
  SELECT a.doc_id, b.doc_id AS neighbour, round(list_inner_product(a.v, b.v) / (a.n * b.n), 9) AS cosine
  FROM u a JOIN u b ON a.doc_id <> b.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, neighbour) AS rn FROM s WHERE cosine >= 0.80)
"""

_P5 = f"""
WITH t AS (SELECT {_BARE.format("term")} AS term, docs, contexts FROM term_stat WHERE term IS NOT NULL),
d AS (SELECT term, unnest(docs) AS e FROM t),
c AS (SELECT term, unnest(contexts) AS e FROM t),
n AS (SELECT count(DISTINCT e) AS all_docs FROM d),
dd AS (SELECT term, count(DISTINCT e) AS docs, count(e) AS doc_occurrences FROM d GROUP BY term),
cc AS (SELECT term, count(DISTINCT e) AS contexts, count(e) AS context_occurrences FROM c GROUP BY term),
f AS (
  SELECT term, coalesce(docs, 0) AS docs, coalesce(contexts, 0) AS contexts, coalesce(doc_occurrences, 0) AS doc_occurrences,
    coalesce(context_occurrences, 0) AS context_occurrences,
    CASE WHEN coalesce(docs, 0) < 3 THEN 'rare' WHEN docs * 100 > all_docs * 8 THEN 'common' END AS mark
  FROM (SELECT DISTINCT term FROM t) LEFT JOIN dd USING (term) LEFT JOIN cc USING (term) CROSS JOIN n)
"""

_P5_REPORTS = f"""
WITH t AS (SELECT shard, {_BARE.format("term")} AS term, docs, contexts FROM term_stat WHERE term IS NOT NULL),
d AS (SELECT DISTINCT shard, term, unnest(docs) AS e FROM t), c AS (SELECT DISTINCT shard, term, unnest(contexts) AS e FROM t),
dd AS (SELECT term, count(DISTINCT e) AS docs, count(e) AS doc_reports FROM d GROUP BY term),
cc AS (SELECT term, count(DISTINCT e) AS contexts, count(e) AS context_reports FROM c GROUP BY term)
SELECT term, coalesce(docs, 0) AS docs, coalesce(contexts, 0) AS contexts, coalesce(doc_reports, 0) AS doc_reports, coalesce(context_reports, 0) AS context_reports
FROM (SELECT DISTINCT term FROM t) LEFT JOIN dd USING (term) LEFT JOIN cc USING (term)
"""

_P6 = f"""
WITH q AS (SELECT DISTINCT {_BKT} AS bucket, qid FROM query_spec WHERE {_BKT} IN ('general', 'coverage') AND qid IS NOT NULL),
v AS (SELECT DISTINCT alias_pair_id AS p, {_BARE.format("alias_view")} AS view FROM query_spec WHERE trim(alias_pair_id, e' \\t\\r\\n') <> '' AND {_BARE.format("alias_view")} IN ('a', 'b')),
hand AS (
  SELECT b.bucket, coalesce(n, 0) AS n FROM (VALUES ('general'), ('coverage'), ('alias')) b(bucket)
  LEFT JOIN (SELECT bucket, count(*) AS n FROM q GROUP BY 1 UNION ALL SELECT 'alias', count(*) FROM (SELECT p FROM v GROUP BY p HAVING count(*) = 2)) h USING (bucket)),
runs AS (
  SELECT DISTINCT run_id, steps::BIGINT AS steps, general_views g, coverage_views c, alias_pairs a FROM run_cfg
  WHERE run_id IS NOT NULL AND steps IS NOT NULL AND general_views >= 0 AND coverage_views >= 0 AND alias_pairs >= 0
    AND general_views + coverage_views + 2 * alias_pairs = batch),
draws AS (
  SELECT run_id, 'general' AS bucket, steps * g AS n FROM runs UNION ALL
  SELECT run_id, 'coverage', steps * c FROM runs UNION ALL
  SELECT run_id, 'alias', steps * a FROM runs)
SELECT DISTINCT d.run_id, d.bucket FROM draws d JOIN hand h USING (bucket) WHERE d.n > 4 * h.n
"""

_P4 = f"""
WITH r AS (
  SELECT CASE WHEN {_SRC} IS NULL OR {_SRC} IN ('', 'unknown') THEN '' ELSE {_SRC} END AS source, qid, min(coalesce(delivery, 0)) AS delivery
  FROM query_spec WHERE qid IS NOT NULL GROUP BY 1, 2),
s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY delivery, md5(qid), qid) - 1 AS seq FROM r),
h AS (
  SELECT *, seq % 64 AS pos, list_aggregate(list_transform(range(0, 8), lambda i: md5('millrace-sample-1|' || source || '|' || (seq // 64)::VARCHAR || '|' || i::VARCHAR)), 'string_agg', '') AS hx
  FROM s)
SELECT source, qid, delivery, seq FROM h
WHERE len(list_filter(range(0, 64), lambda p: substr(hx, p * 4 + 1, 4) < substr(hx, pos * 4 + 1, 4) OR (substr(hx, p * 4 + 1, 4) = substr(hx, pos * 4 + 1, 4) AND p < pos))) < 8
"""

_SPLITS = f"""
WITH RECURSIVE {_TIED},
recs AS (SELECT DISTINCT q.qid, coalesce(s.comp, q.qid) AS comp FROM query_spec q LEFT JOIN sets s USING (qid) WHERE q.qid IS NOT NULL),
sizes AS (SELECT comp, count(*) AS size FROM recs GROUP BY comp),
ord AS (SELECT size, row_number() OVER (ORDER BY size DESC) AS n FROM sizes),
g(n, size, pick, d0, d1, d2) AS (
  SELECT 0::BIGINT, 0::BIGINT, -1, sum(size)::BIGINT * 80, sum(size)::BIGINT * 10, sum(size)::BIGINT * 10 FROM sizes
  UNION ALL
  SELECT n, size, pick, d0 - CASE WHEN pick = 0 THEN 100 * size ELSE 0 END, d1 - CASE WHEN pick = 1 THEN 100 * size ELSE 0 END, d2 - CASE WHEN pick = 2 THEN 100 * size ELSE 0 END
  FROM (
    SELECT o.n, o.size, CASE WHEN d0 >= d1 AND d0 >= d2 THEN 0 WHEN d1 >= d2 THEN 1 ELSE 2 END AS pick, d0, d1, d2
    FROM g JOIN ord o ON o.n = g.n + 1)),
counts AS (SELECT size, pick, count(*) AS n FROM g WHERE pick >= 0 GROUP BY size, pick),
ranges AS (SELECT size, pick, sum(n) OVER (PARTITION BY size ORDER BY pick) AS hi, n FROM counts),
ranked AS (SELECT comp, size, row_number() OVER (PARTITION BY size ORDER BY md5(comp), comp) AS rn FROM sizes)
SELECT r.qid, r.comp, CASE x.pick WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split
FROM recs r JOIN ranked k USING (comp) JOIN ranges x ON x.size = k.size AND k.rn > x.hi - x.n AND k.rn <= x.hi
"""


def oracle_sql() -> dict[str, str]:
    """By query name. The others (tokens, leaks, forms, mixtures by knapsack) are tested against brute force."""
    return {
        "p1_found": f"WITH RECURSIVE {_TIED} SELECT comp AS qid_a, qid AS qid_b FROM sets WHERE qid <> comp",
        "p1_splits": _SPLITS,
        "p2_found": _P2 + "SELECT DISTINCT least(doc_id, neighbour) AS doc_id_a, greatest(doc_id, neighbour) AS doc_id_b FROM r WHERE rn <= 5",
        "p2_neighbours": _P2 + "SELECT doc_id, neighbour, cosine FROM r WHERE rn <= 5",
        "p3_found": _P3.format(cols="system, qid, doc_id"),
        "p3_top": _P3.format(cols="system, qid, doc_id, score"),
        "p4_sample": _P4,
        "p5_found": _P5 + "SELECT term, mark FROM f WHERE mark IS NOT NULL",
        "p5_terms": _P5 + "SELECT * FROM f",
        "p5_reports": _P5_REPORTS,
        "p6_found": _P6,
    }
