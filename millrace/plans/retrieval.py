"""Queries on search, fusion, metrics, mining and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import text as X
from millrace.operators import decisions, dense, fusion, judgments, lexical, metrics, mining
from millrace.session import scratch, spread, stage, table

from . import sql as S
from .registry import query


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def searches(spark: SparkSession, d: str) -> DataFrame:
    """The held-out questions: a fixed set."""
    return table(spark, d, "eval_item").where("role = 'query'").select(F.col("item_id").alias("qid"), "text")


def system_run(spark: SparkSession, d: str, system: str) -> DataFrame:
    s = F.col("score")
    x = table(spark, d, "scored_point").where((F.col("system") == system) & s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")) & F.col("qid").isNotNull() & F.col("doc_id").isNotNull())
    return x.groupBy("qid", "doc_id").agg((F.max("score") + 0.0).alias("score"))


def qrels(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "query_spec").where("qid is not null")
    return x.select("qid", F.explode("positive_ids").alias("doc_id")).where("doc_id is not null").distinct().withColumn("grade", F.lit(1))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


_POST = f"""
docs AS (SELECT doc_id, {S.lexical("text")} AS t FROM documents),
post AS (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM docs WHERE len(t) > 0) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
tot AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM docs),
q AS (SELECT qid, token, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({S.lexical("text")}) AS token FROM eval_item WHERE role = 'query') GROUP BY ALL)
"""
_BM25 = f"""{_POST},
bm AS (
  SELECT qid, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score
  FROM q JOIN df USING (token) JOIN post USING (token) CROSS JOIN tot GROUP BY qid, doc_id),
bmr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM bm WHERE score > 0 AND qid::VARCHAR <> doc_id::VARCHAR)
"""


@query(f"WITH {_BM25} SELECT qid, doc_id, score, rank FROM bmr WHERE rank <= 10")
def bm25_top10(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(documents(spark, d), searches(spark, d), 10)


_TFIDF = f"""
td AS (SELECT doc_id, list_filter({S.words("text")}, lambda w: length(w) >= 3) AS t FROM documents),
tp AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS token FROM td) GROUP BY ALL),
tdf AS (SELECT token, count(*) AS df FROM tp GROUP BY token),
tw AS (SELECT doc_id, token, (1 + ln(tf)) * ln((SELECT count(*) FROM documents) / (1 + df)) AS w FROM tp JOIN tdf USING (token)),
tl AS (SELECT doc_id, sqrt(sum(w * w)) AS len FROM tw WHERE w > 0 GROUP BY doc_id),
tv AS (SELECT doc_id, token, w / len AS w FROM tw JOIN tl USING (doc_id) WHERE w > 0)
"""


@query(f"""WITH {_TFIDF},
s AS (SELECT a.doc_id AS qid, b.doc_id, round(sum(a.w * b.w), 9) AS score FROM tv a JOIN tv b USING (token) WHERE a.doc_id % 100 = 0 AND a.doc_id <> b.doc_id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT qid, doc_id, score, rank FROM r WHERE rank <= 5""")
def tfidf_neighbours(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return lexical.tfidf_neighbours(docs, docs.where("doc_id % 100 = 0"), 5)


@query(f"""WITH {_POST}, i AS (SELECT token, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM df CROSS JOIN tot), m AS (SELECT median(idf) AS med FROM i)
SELECT token, df, round(idf, 9) AS idf, round(greatest(0.05, least(20.0, idf / med)), 9) AS weight FROM i CROSS JOIN m""")
def idf_weights(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return lexical.idf_table(lexical.postings(docs), docs.agg(F.count(F.lit(1)).alias("n")))


def _sparse_search(spark: SparkSession, d: str, depth: int, vectors_: DataFrame | None = None) -> DataFrame:
    v = lexical.tfidf_vectors(documents(spark, d)) if vectors_ is None else vectors_
    words = F.array_distinct(F.filter(X.fingerprint_words(F.col("text")), lambda w: F.length(w) >= 3))
    q = searches(spark, d).select("qid", F.explode(words).alias("token")).withColumn("w", F.lit(1.0))
    return lexical.sparse_dot(q, v, depth)


_SPARSE = f"""
sq AS (SELECT DISTINCT item_id AS qid, unnest(list_filter({S.words("text")}, lambda w: length(w) >= 3)) AS token FROM eval_item WHERE role = 'query'),
sp AS (SELECT qid, doc_id, round(sum(w), 9) AS score FROM sq JOIN tv USING (token) GROUP BY qid, doc_id),
spr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sp WHERE score > 0)
"""


@query(f"WITH {_TFIDF}, {_SPARSE} SELECT qid, doc_id, score, rank FROM spr WHERE rank <= 10")
def sparse_top10(spark: SparkSession, d: str) -> DataFrame:
    return _sparse_search(spark, d, 10)


_DBSF = """
{name}n AS (
  SELECT qid, doc_id, CASE WHEN min(score) OVER w = max(score) OVER w OR count(*) OVER w < 2 THEN 0.5
    ELSE (score - (avg(score) OVER w - 3 * stddev_samp(score) OVER w)) / (6 * stddev_samp(score) OVER w) END AS x
  FROM {run} WHERE rank <= {depth} WINDOW w AS (PARTITION BY qid))"""


_HYBRID = f"""WITH {_BM25}, {_TFIDF}, {_SPARSE}, {_DBSF.format(name="b", run="bmr", depth=100)}, {_DBSF.format(name="s", run="spr", depth=100)},
f AS (SELECT qid, doc_id, round(sum(x), 12) AS score FROM (SELECT * FROM bn UNION ALL SELECT * FROM sn) GROUP BY qid, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM f)
SELECT qid, doc_id, round(score, 6) AS score, rank, artifact_id, kind FROM r JOIN documents USING (doc_id) WHERE rank <= 10"""


@query(_HYBRID)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: BM25 and TF-IDF search, each to depth 100, fused by their score distributions, with the documents' metadata."""
    docs = documents(spark, d)
    runs = {"bm25": lexical.bm25(docs, searches(spark, d), 100), "sparse": _sparse_search(spark, d, 100)}
    best = fusion.dbsf(runs, 100).where("rank <= 10")
    return docs.select("doc_id", "artifact_id", "kind").join(best, "doc_id").select("qid", "doc_id", F.round("score", 6).alias("score"), "rank", "artifact_id", "kind")


def keep_hybrid(spark: SparkSession, d: str, path: str) -> None:
    """Both indexes of hybrid search, kept below a path for any number of query sets."""
    docs = documents(spark, d)
    lexical.build_index(docs, f"{path}/postings")
    lexical.build_vectors(docs, f"{path}/vectors")


def search_kept(spark: SparkSession, d: str, path: str) -> DataFrame:
    """``hybrid_search`` over indexes that ``keep_hybrid`` made."""
    index = lexical.open_index(spark, f"{path}/postings")
    runs = {"bm25": lexical.search_index(index, searches(spark, d), 100), "sparse": _sparse_search(spark, d, 100, spark.read.parquet(f"{path}/vectors"))}
    best = fusion.dbsf(runs, 100).where("rank <= 10")
    return documents(spark, d).select("doc_id", "artifact_id", "kind").join(best, "doc_id").select("qid", "doc_id", F.round("score", 6).alias("score"), "rank", "artifact_id", "kind")


@query(_HYBRID)
def hybrid_kept(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search over indexes that are written and opened again."""
    path = scratch(spark, "hybrid")
    keep_hybrid(spark, d, path)
    return search_kept(spark, d, path)


_KNN = """
v AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, label FROM embeddings),
s AS (SELECT a.doc_id AS qid, a.label AS ql, b.doc_id, b.label AS dl, round(list_inner_product(a.v, b.v), 9) AS score FROM v a JOIN v b ON a.doc_id % 100 = 0 AND a.doc_id <> b.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s)
"""


def _vector_run(spark: SparkSession, d: str, k: int) -> DataFrame:
    v = vectors(spark, d)
    return dense.knn(v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), "vector"), v.select("doc_id", "vector"), k)


@query(f"WITH {_KNN} SELECT qid, doc_id, score, rank FROM r WHERE rank <= 10")
def knn_top10(spark: SparkSession, d: str) -> DataFrame:
    return _vector_run(spark, d, 10)


def _label_qrels(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    q = v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), "label")
    return v.join(q, "label").where("qid <> doc_id").select("qid", "doc_id", F.lit(1).alias("grade"))


@query(f"""WITH {_KNN}, rr AS (SELECT qid, doc_id, rank FROM r), g AS (SELECT qid, doc_id, 1 AS grade FROM s WHERE ql = dl), m AS ({S.metrics("rr", "g")}),
c AS (SELECT label, avg(ndcg) AS m FROM m JOIN v ON v.doc_id = m.qid GROUP BY label)
SELECT round(avg(m), 9) AS macro, count(*) AS components FROM c""")
def knn_ndcg_macro(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.per_query(_vector_run(spark, d, 100), _label_qrels(spark, d))
    v = vectors(spark, d).select(F.col("doc_id").alias("qid"), "label")
    return metrics.macro(m.join(v, "qid"), "label", "ndcg")


@query("""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
s AS (SELECT a.id AS q, round(list_inner_product(a.v, b.v) / (greatest(a.n, 1e-12) * greatest(b.n, 1e-12)), 9) AS c, row_number() OVER (PARTITION BY a.id ORDER BY round(list_inner_product(a.v, b.v) / (greatest(a.n, 1e-12) * greatest(b.n, 1e-12)), 9) DESC, b.id) AS r FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
e AS (SELECT k, q, avg(c) AS m FROM s JOIN (VALUES (1), (5)) t(k) ON r <= k GROUP BY k, q)
SELECT k, round(avg(m), 6) AS mean_cosine FROM e GROUP BY k""")
def nn_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    x = dense.nn_cosine(v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), "vector"), v.select("doc_id", "vector"))
    return x.select("k", F.round("mean_cosine", 6).alias("mean_cosine"))


@query("""WITH v AS (SELECT vec_id AS id, label, list_transform(embedding::DOUBLE[], lambda x: x / greatest(1e-12, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))) AS v FROM embeddings),
x AS (SELECT * FROM v WHERE label < 5), y AS (SELECT * FROM v WHERE label >= 5),
xy AS (SELECT avg(sqrt(greatest(0, 2 - 2 * list_inner_product(x.v, y.v)))) AS d FROM x, y),
xx AS (SELECT avg(sqrt(greatest(0, 2 - 2 * list_inner_product(a.v, b.v)))) AS d FROM x a, x b),
yy AS (SELECT avg(sqrt(greatest(0, 2 - 2 * list_inner_product(a.v, b.v)))) AS d FROM y a, y b)
SELECT round(2 * xy.d - xx.d - yy.d, 6) AS energy FROM xy, xx, yy""")
def energy_distance(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return dense.energy_distance(v.where("label < 5"), v.where("label >= 5"))


@query(f"""WITH {_KNN},
m AS (SELECT qid, i, avg(x) AS x FROM (SELECT r.qid, unnest(range(1, 65)) AS i, unnest(d.v) AS x FROM r JOIN v d ON d.doc_id = r.doc_id WHERE rank <= 3) GROUP BY qid, i),
p AS (SELECT qid, i, v.v[i] * 0.4 + m.x * 0.6 AS x FROM m JOIN v ON v.doc_id = m.qid),
n AS (SELECT qid, greatest(1e-12, sqrt(sum(x * x))) AS n FROM p GROUP BY qid)
SELECT qid, i::INT AS i, round(x / n, 6) AS x FROM p JOIN n USING (qid)""")
def prf_queries(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select("doc_id", "vector")
    q = dense.prf(v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), "vector"), v)
    return q.select("qid", F.posexplode("vector").alias("i", "x")).select("qid", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


@query("""WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS m FROM embeddings),
c AS (SELECT vec_id, v, CASE WHEN m > 0 THEN m / 127.0::DOUBLE ELSE 1.0 END AS sc FROM s),
q AS (SELECT vec_id, v, sc, list_transform(v, lambda x: greatest(-127, least(127, round_even(x / sc, 0)))) AS codes FROM c)
SELECT vec_id, round(sc, 9) AS scale, list_sum(codes)::BIGINT AS code_sum, round(list_max(list_transform(range(1, 65), lambda i: abs(codes[i] * sc - v[i]))), 9) AS max_error FROM q""")
def int8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v")).withColumn("scale", A.int8_scale(F.col("v")))
    x = x.withColumn("codes", A.quantize_int8(F.col("v"), F.col("scale")))
    err = F.array_max(F.zip_with(A.dequantize_int8(F.col("codes"), F.col("scale")), "v", lambda a, b: F.abs(a - b.cast("double"))))
    x = x.select("vec_id", "scale", F.aggregate("codes", F.lit(0).cast("long"), lambda s, c: s + c).alias("code_sum"), err.alias("e"))
    return x.select("vec_id", F.round("scale", 9).alias("scale"), "code_sum", F.round("e", 9).alias("max_error"))


@query("""WITH t AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
tok AS (SELECT l_orderkey AS q, l_partkey % (SELECT count(*) FROM embeddings) AS token FROM lineitem),
c AS (SELECT q, token, sqrt(count(*)) AS w FROM tok GROUP BY q, token),
m AS (SELECT q, i, sum(w * x) / sum(w) AS x FROM (SELECT q, w, unnest(range(0, 64)) AS i, unnest(v) AS x FROM c JOIN t ON t.vec_id = c.token) GROUP BY q, i),
n AS (SELECT q, sqrt(sum(x * x)) AS n FROM m GROUP BY q)
SELECT q % 16 AS bucket, count(DISTINCT q) AS queries, round(sum(x / n), 4) AS total FROM m JOIN n USING (q) WHERE n > 1e-12 GROUP BY 1""")
def lookup_encode(spark: SparkSession, d: str) -> DataFrame:
    e = vectors(spark, d)
    n = e.agg(F.count(F.lit(1)).alias("n"))
    tok = table(spark, d, "lineitem").crossJoin(F.broadcast(n)).select(F.col("l_orderkey").alias("qid"), F.expr("l_partkey % n").alias("token"))
    enc = dense.lookup_encode(tok, e.select(F.col("doc_id").alias("token"), "vector"))
    s = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return enc.where("vector is not null").groupBy(F.expr("qid % 16").alias("bucket")).agg(F.count(F.lit(1)).alias("queries"), F.round(F.sum(s), 4).alias("total"))


@query()
def principal_axes(spark: SparkSession, d: str) -> DataFrame:
    return dense.matrix_frame(spark, dense.principal_axes(vectors(spark, d), "vector", 4)[1])


@query()
def ridge_to_label(spark: SparkSession, d: str) -> DataFrame:
    x = vectors(spark, d).withColumn("y", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("double")))
    return dense.matrix_frame(spark, dense.ridge(x, "vector", "y", 1.0))


_TWO = f"WITH a AS ({S.ranked(S.RUN.format('dense'))}), b AS ({S.ranked(S.RUN.format('lexical'))})"


def _two(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"dense": system_run(spark, d, "dense"), "lexical": system_run(spark, d, "lexical")}


def _top(df: DataFrame, k: int = 10) -> DataFrame:
    return df.where(F.col("rank") <= k).select("qid", "doc_id", F.round("score", 9).alias("score"), "rank")


def _fused_sql(parts: str) -> str:
    return f"""{_TWO}, p AS ({parts}), f AS (SELECT qid, doc_id, round(sum(x), 12) AS score FROM p GROUP BY qid, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM f) SELECT qid, doc_id, round(score, 9) AS score, rank FROM r WHERE rank <= 10"""


@query(_fused_sql("SELECT qid, doc_id, 1.0 / (60 + rank) AS x FROM a UNION ALL SELECT qid, doc_id, 1.0 / (60 + rank) FROM b"))
def rrf(spark: SparkSession, d: str) -> DataFrame:
    return _top(fusion.rrf(_two(spark, d)))


@query(_fused_sql("SELECT qid, doc_id, 1.0 / (rank / 0.7 + 1) AS x FROM a UNION ALL SELECT qid, doc_id, 1.0 / (rank / 0.3 + 1) FROM b"))
def rrf_server(spark: SparkSession, d: str) -> DataFrame:
    return _top(fusion.rrf_server(_two(spark, d), 2, {"dense": 0.7, "lexical": 0.3}))


@query(f"""{_TWO}, {_DBSF.format(name="a", run="a", depth=100)}, {_DBSF.format(name="b", run="b", depth=100)},
f AS (SELECT qid, doc_id, round(sum(x), 12) AS score FROM (SELECT * FROM an UNION ALL SELECT * FROM bn) GROUP BY qid, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f) SELECT qid, count(*) AS items, round(sum(score), 6) AS total, round(max(score), 6) AS best FROM r GROUP BY qid""")
def dbsf(spark: SparkSession, d: str) -> DataFrame:
    return fusion.dbsf(_two(spark, d)).groupBy("qid").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("score"), 6).alias("total"), F.round(F.max("score"), 6).alias("best"))


def _convex_sql(w: float, v: float, eps: str, lo: str) -> str:
    n = "(score - {lo}) / (max(score) OVER (PARTITION BY qid) - {lo} + {eps})".format(lo=lo, eps=eps)
    return _fused_sql(f"SELECT qid, doc_id, {w} * {n} AS x FROM a UNION ALL SELECT qid, doc_id, {v} * {n} FROM b")


_LO = "min(score) OVER (PARTITION BY qid)"


@query(_convex_sql(0.5, 0.5, "1e-9", _LO))
def convex(spark: SparkSession, d: str) -> DataFrame:
    r = _two(spark, d)
    return _top(fusion.convex(r["dense"], r["lexical"]))


@query(_convex_sql(0.75, 0.25, "1e-9", "0.0"))
def convex0(spark: SparkSession, d: str) -> DataFrame:
    r = _two(spark, d)
    return _top(fusion.convex(r["dense"], r["lexical"], 0.75, floor_zero=True))


@query(_convex_sql(0.7, 0.3, "1e-8", _LO))
def linear_hybrid(spark: SparkSession, d: str) -> DataFrame:
    r = _two(spark, d)
    return _top(fusion.linear_hybrid(r["dense"], r["lexical"]))


@query(f"""{_TWO}, g AS (SELECT k, w, (row_number() OVER (ORDER BY kp, wp) - 1)::INT AS grid_pos FROM (VALUES (1, 10), (2, 20), (3, 30), (4, 60), (5, 100)) x(kp, k), (VALUES (1, 0.3), (2, 0.4), (3, 0.5), (4, 0.6), (5, 0.7), (6, 0.8), (7, 0.9), (8, 1.0)) y(wp, w)),
f AS (SELECT grid_pos, k, w, qid, doc_id, round(sum(x), 12) AS score FROM (SELECT grid_pos, k, w, qid, doc_id, w::DOUBLE / (k + rank) AS x FROM a, g UNION ALL SELECT grid_pos, k, w, qid, doc_id, (1 - w::DOUBLE) / (k + rank) FROM b, g) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY grid_pos, qid ORDER BY score DESC, doc_id) AS rank FROM f), q AS ({S.QRELS}), qq AS (SELECT DISTINCT qid FROM q WHERE doc_id IS NOT NULL),
h AS (SELECT r.grid_pos, r.qid, max(1.0 / rank) AS rr FROM r JOIN q ON q.qid = r.qid AND q.doc_id = r.doc_id WHERE rank <= 10 GROUP BY ALL),
m AS (SELECT g.grid_pos, g.k, g.w, round(sum(coalesce(rr, 0)) / count(*), 9) AS macro FROM g CROSS JOIN qq LEFT JOIN h ON h.grid_pos = g.grid_pos AND h.qid = qq.qid GROUP BY ALL)
SELECT grid_pos, k, w::DOUBLE AS w, macro FROM m ORDER BY macro DESC, (w = 1.0) DESC, grid_pos LIMIT 1""")
def fusion_grid_select(spark: SparkSession, d: str) -> DataFrame:
    r, q = _two(spark, d), qrels(spark, d)
    grid = fusion.rrf_grid(r["dense"], r["lexical"])
    n = q.select("qid").distinct().agg(F.count(F.lit(1)).alias("n"))
    hit = grid.where("rank <= 10").join(q, ["qid", "doc_id"]).groupBy("grid_pos", "k", "w", "qid").agg(F.max(1.0 / F.col("rank")).alias("rr"))
    macro = hit.groupBy("grid_pos", "k", "w").agg(F.sum("rr").alias("s")).crossJoin(F.broadcast(n)).select("grid_pos", "k", "w", F.round(F.col("s") / F.col("n"), 9).alias("macro"))
    return fusion.select_setting(macro)


@query(f"""{_TWO}, x AS (SELECT a.qid, a.doc_id AS passage_id, u.artifact_id, a.score FROM a JOIN (SELECT DISTINCT unit_id, artifact_id FROM documents) u ON u.unit_id = a.doc_id),
ok AS (SELECT * FROM x WHERE (qid, artifact_id) NOT IN (SELECT q.qid, u.artifact_id FROM query_spec q JOIN documents u ON u.unit_id = q.source_doc)),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, passage_id) AS n FROM ok), b AS (SELECT *, row_number() OVER (PARTITION BY qid, artifact_id ORDER BY score DESC, passage_id) AS m FROM t WHERE n <= 500),
r AS (SELECT qid, artifact_id, passage_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, artifact_id) AS rank FROM b WHERE m = 1) SELECT * FROM r WHERE rank <= 100""".replace("b AS (SELECT *, row_number() OVER (PARTITION BY qid, artifact_id", "bb AS (SELECT *, row_number() OVER (PARTITION BY qid, artifact_id").replace("FROM b WHERE m = 1", "FROM bb WHERE m = 1"))
def collapse_artifacts(spark: SparkSession, d: str) -> DataFrame:
    units = documents(spark, d).select(F.col("unit_id").alias("passage_id"), "artifact_id").distinct().withColumn("text_hash", F.lit(None).cast("string"))
    own = table(spark, d, "query_spec").join(units, F.col("source_doc") == F.col("passage_id")).select("qid", "artifact_id").distinct()
    scores = system_run(spark, d, "dense").withColumnRenamed("doc_id", "passage_id")
    return fusion.collapse_passages(scores, units, excluded_artifacts=own)


_ROUTES = " UNION ALL ".join(f"SELECT '{s}' AS route, r.* FROM ({S.RUN.format(s)}) r" for s in ("dense", "lexical", "sparse", "hybrid"))


@query(f"""WITH runs AS ({_ROUTES}), x AS (SELECT route, qid, artifact_id, max(score) AS score FROM runs JOIN (SELECT DISTINCT unit_id, artifact_id FROM documents) u ON u.unit_id = runs.doc_id GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY route, qid ORDER BY score DESC, artifact_id) AS pos FROM x),
n AS (SELECT route, qid, artifact_id, CASE WHEN min(score) OVER w = max(score) OVER w OR count(*) OVER w < 2 THEN 0.5 ELSE (score - (avg(score) OVER w - 3 * stddev_samp(score) OVER w)) / (6 * stddev_samp(score) OVER w) END AS x FROM c WHERE pos <= 100 WINDOW w AS (PARTITION BY route, qid)),
f AS (SELECT qid, artifact_id, round(sum(x), 6) AS score, string_agg(route, ',' ORDER BY route) AS routes FROM n GROUP BY qid, artifact_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, artifact_id) AS rank FROM f) SELECT qid, sum(score) AS total, count(*) AS n, sum(length(routes))::BIGINT AS routes FROM r GROUP BY qid""".replace("sum(score) AS total", "round(sum(score), 4) AS total"))
def explain_routes(spark: SparkSession, d: str) -> DataFrame:
    units = documents(spark, d).select(F.col("unit_id").alias("doc_id"), "artifact_id").distinct()
    routes = None
    for s in ("dense", "lexical", "sparse", "hybrid"):
        r = system_run(spark, d, s).withColumn("route", F.lit(s))
        routes = r if routes is None else routes.unionByName(r)
    best = routes.join(units, "doc_id").groupBy("route", "qid", "artifact_id").agg(F.max("score").alias("score"), F.max_by("doc_id", "score").alias("passage_id"))
    f = fusion.dbsf_artifacts(best, limit=1_000_000)
    names = F.array_join(F.transform("support", lambda s: s.route), ",")
    return f.groupBy("qid").agg(F.round(F.sum(F.round("score", 6)), 4).alias("total"), F.count(F.lit(1)).alias("n"), F.sum(F.length(names)).alias("routes"))


@query(f"WITH r AS ({S.ranked(S.RUN.format('dense'))}), q AS ({S.QRELS}) {S.metrics('r', 'q')}")
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.per_query(fusion.ranked(system_run(spark, d, "dense")), qrels(spark, d))


def _scores(spark: SparkSession, d: str, system: str) -> DataFrame:
    """(qid, domain, ndcg) of every judged query that has a domain."""
    m = metrics.per_query(fusion.ranked(system_run(spark, d, system)), qrels(spark, d))
    dom = table(spark, d, "query_spec").where("domain is not null").groupBy("qid").agg(F.min("domain").alias("domain"))
    return m.join(dom, "qid").select("qid", "domain", "ndcg")


def scores_sql(system: str, name: str) -> str:
    """CTEs ending in ``name`` (qid, domain, ndcg)."""
    return f"""{name}_r AS ({S.ranked(S.RUN.format(system))}), {name}_q AS ({S.QRELS}), {name}_m AS ({S.metrics(f"{name}_r", f"{name}_q")}),
{name} AS (SELECT m.qid, domain, ndcg FROM {name}_m m JOIN (SELECT qid, min(domain) AS domain FROM query_spec WHERE domain IS NOT NULL GROUP BY qid) USING (qid))"""


@query(f"""WITH {scores_sql("dense", "s")}, b AS (SELECT domain AS stratum, avg(ndcg) AS mean, count(*) AS n FROM s GROUP BY 1)
SELECT stratum, round(mean, 9) AS mean, n FROM b UNION ALL SELECT '*query', round(avg(ndcg), 9), count(*) FROM s UNION ALL SELECT '*macro', round(avg(mean), 9), count(*) FROM b""")
def stratum_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.stratum_aggregate(_scores(spark, d, "dense"), "domain", "ndcg")


@query(f"""{_TWO}, x AS (SELECT qid, doc_id FROM a WHERE rank <= 10), y AS (SELECT qid, doc_id FROM b WHERE rank <= 10), q AS (SELECT qid FROM x UNION SELECT qid FROM y),
c AS (SELECT qid, count(*) AS n FROM x JOIN y USING (qid, doc_id) GROUP BY qid) SELECT round(avg(coalesce(n, 0) / 10), 9) AS overlap, count(*) AS queries FROM q LEFT JOIN c USING (qid)""")
def overlap_at_10(spark: SparkSession, d: str) -> DataFrame:
    r = _two(spark, d)
    return metrics.overlap(fusion.ranked(r["dense"]), fusion.ranked(r["lexical"]))


@query(f"""{_TWO}, j AS (SELECT a.qid, row_number() OVER (PARTITION BY a.qid ORDER BY a.rank) AS xa, row_number() OVER (PARTITION BY a.qid ORDER BY b.rank) AS xb FROM a JOIN b USING (qid, doc_id))
SELECT qid, count(*) AS shared, round(corr(xa, xb), 6) AS rho FROM j GROUP BY qid HAVING count(*) >= 2""")
def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    r = _two(spark, d)
    return metrics.spearman(fusion.ranked(r["dense"]), fusion.ranked(r["lexical"]), 6)


@query(f"""{_TWO}, o AS (SELECT qid, max((a.doc_id IS DISTINCT FROM b.doc_id)::INT) AS moved, max(abs(a.score - b.score)) AS dev FROM (SELECT * FROM a WHERE rank <= 10) a FULL JOIN (SELECT * FROM b WHERE rank <= 10) b USING (qid, rank) GROUP BY qid),
s AS (SELECT qid, max((x.d IS NULL OR y.d IS NULL)::INT) AS differ FROM (SELECT qid, doc_id, 1 AS d FROM a WHERE rank <= 10) x FULL JOIN (SELECT qid, doc_id, 1 AS d FROM b WHERE rank <= 10) y USING (qid, doc_id) GROUP BY qid)
SELECT count(*) AS queries, sum(moved)::BIGINT AS order_changes, sum(differ)::BIGINT AS set_changes, round(max(dev), 9) AS max_score_dev FROM o JOIN s USING (qid)""")
def rank_comparison(spark: SparkSession, d: str) -> DataFrame:
    r = _two(spark, d)
    return fusion.rank_comparison(fusion.ranked(r["dense"]), fusion.ranked(r["lexical"])).withColumn("max_score_dev", F.round("max_score_dev", 9))


_NEG = f"""WITH r AS ({S.RUN.format("dense")}), q AS ({S.QRELS}), c AS (SELECT * FROM r WHERE (qid, doc_id) NOT IN (SELECT qid, doc_id FROM q WHERE doc_id IS NOT NULL) AND doc_id NOT IN (SELECT doc_id FROM bank WHERE vector IS NULL AND doc_id IS NOT NULL)),
k AS (SELECT qid, doc_id, rank, max(rank) OVER (PARTITION BY qid) AS n FROM ({S.ranked("SELECT * FROM c")}) WHERE rank <= 8)"""


@query(f"{_NEG} SELECT qid, rank::INT AS slot, doc_id FROM k UNION ALL SELECT qid, unnest(range(n + 1, 9))::INT, doc_id FROM k WHERE rank = n AND n < 8")
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    banned = table(spark, d, "bank").where("vector is null and doc_id is not null").select("doc_id")
    return mining.hard_negatives(system_run(spark, d, "dense"), qrels(spark, d), banned, 8)


@query(f"""WITH q AS ({S.QRELS}), f AS (SELECT qid, min(doc_id) AS doc_id FROM q WHERE doc_id IS NOT NULL GROUP BY qid), a AS ({S.RUN.format("dense")}), b AS ({S.RUN.format("lexical")}),
t AS (SELECT * FROM (SELECT a.qid, a.doc_id, row_number() OVER (PARTITION BY a.qid ORDER BY score DESC, a.doc_id) AS slot FROM a JOIN f ON f.qid = a.qid WHERE a.doc_id <> f.doc_id) WHERE slot <= 4), g1 AS (SELECT qid, doc_id FROM f UNION ALL SELECT qid, doc_id FROM t),
s AS (SELECT * FROM (SELECT b.qid, b.doc_id, row_number() OVER (PARTITION BY b.qid ORDER BY score DESC, b.doc_id) AS slot FROM b JOIN f ON f.qid = b.qid WHERE (b.qid, b.doc_id) NOT IN (SELECT qid, doc_id FROM g1)) WHERE slot <= 4), g2 AS (SELECT * FROM g1 UNION ALL SELECT qid, doc_id FROM s),
o AS (SELECT doc_id, row_number() OVER (ORDER BY {S.order_key("mix", "doc_id")}, doc_id) - 1 AS k FROM (SELECT DISTINCT doc_id FROM bank WHERE doc_id IS NOT NULL)), n AS (SELECT count(*) AS n FROM o), i AS (SELECT f.qid, unnest(range(0, 12)) AS i FROM f),
u AS (SELECT i.qid, o.doc_id, i FROM i, n JOIN o ON o.k = ({S.key60("'mix|' || i.qid")} + i) % n), v AS (SELECT * FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY i, doc_id) AS slot FROM u WHERE (qid, doc_id) NOT IN (SELECT qid, doc_id FROM g2)) WHERE slot <= 3)
SELECT qid, 'positive' AS source, 1::INT AS slot, doc_id FROM f UNION ALL SELECT qid, 'teacher', slot::INT, doc_id FROM t UNION ALL SELECT qid, 'second', slot::INT, doc_id FROM s UNION ALL SELECT qid, 'uniform', slot::INT, doc_id FROM v""")
def candidate_mix(spark: SparkSession, d: str) -> DataFrame:
    pool = table(spark, d, "bank").where("doc_id is not null").select("doc_id").distinct()
    return mining.candidate_mix(qrels(spark, d), stage(system_run(spark, d, "dense"), "run"), stage(system_run(spark, d, "lexical"), "run"), stage(pool, "pool"), 4, 4, 3, "mix")


@query(f"""WITH r AS ({S.RUN.format("lexical")}), e AS (SELECT qid, exp((score - max(score) OVER (PARTITION BY qid)) / 0.5) AS e FROM r), p AS (SELECT qid, e / sum(e) OVER (PARTITION BY qid) AS p FROM e)
SELECT qid, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 6) AS entropy, round(max(p), 6) AS p_max FROM p GROUP BY qid""")
def teacher_entropy(spark: SparkSession, d: str) -> DataFrame:
    return mining.entropy(system_run(spark, d, "lexical"), 0.5).select("qid", F.round("entropy", 6).alias("entropy"), F.round("p_max", 6).alias("p_max"))


@query(f"""WITH runs AS ({_ROUTES}), r AS (SELECT *, row_number() OVER (PARTITION BY route, qid ORDER BY score DESC, doc_id) AS rank FROM runs)
SELECT substr(sha256(qid || '|' || doc_id), 1, 24) AS item_id, qid, doc_id AS artifact_id, string_agg(DISTINCT route, ',' ORDER BY route) AS routes, min(rank) AS best_rank FROM r WHERE rank <= 10 GROUP BY qid, doc_id""")
def judgment_pool(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d)


def _pool(spark: SparkSession, d: str) -> DataFrame:
    routes = None
    for s in ("dense", "lexical", "sparse", "hybrid"):
        r = fusion.ranked(system_run(spark, d, s)).select(F.lit(s).alias("route"), "qid", F.col("doc_id").alias("artifact_id"), "rank")
        routes = r if routes is None else routes.unionByName(r)
    return judgments.pool(routes)


_LABELS = f"""WITH runs AS ({_ROUTES}), r AS (SELECT *, row_number() OVER (PARTITION BY route, qid ORDER BY score DESC, doc_id) AS rank FROM runs),
it AS (SELECT DISTINCT substr(sha256(qid || '|' || doc_id), 1, 24) AS item_id, qid, doc_id FROM r WHERE rank <= 10), q AS ({S.QRELS}),
t AS (SELECT qid, min(domain) AS term FROM query_spec GROUP BY qid),
l AS (SELECT item_id, it.qid, t.term, CASE WHEN it.doc_id NOT IN (SELECT doc_id FROM bank WHERE doc_id IS NOT NULL) THEN NULL WHEN q.grade = 1 THEN 1 ELSE 0 END AS label FROM it LEFT JOIN q ON q.qid = it.qid AND q.doc_id = it.doc_id LEFT JOIN t ON t.qid = it.qid)"""


def _labelled_items(spark: SparkSession, d: str) -> DataFrame:
    p = _pool(spark, d).select("item_id", "qid", F.col("artifact_id").alias("doc_id"))
    bank = table(spark, d, "bank").where("doc_id is not null").select("doc_id").distinct().withColumn("b", F.lit(1))
    term = table(spark, d, "query_spec").groupBy("qid").agg(F.min("domain").alias("term"))
    x = p.join(qrels(spark, d), ["qid", "doc_id"], "left").join(bank, "doc_id", "left").join(term, "qid", "left")
    return x.select("item_id", "qid", "term", F.when(F.col("b").isNull(), None).otherwise(F.coalesce("grade", F.lit(0))).alias("label"))


@query(f"""{_LABELS}, neg AS (SELECT *, {S.order_key("audit", "item_id")} AS h FROM l WHERE label = 0),
must AS (SELECT item_id, 'label' AS reason FROM l WHERE label IS NULL OR label <> 0),
cov AS (SELECT DISTINCT item_id, 'cover' AS reason FROM (SELECT item_id, row_number() OVER (PARTITION BY qid ORDER BY h, item_id) AS a, row_number() OVER (PARTITION BY term ORDER BY h, item_id) AS b FROM neg) WHERE a = 1 OR b = 1),
base AS (SELECT * FROM must UNION ALL SELECT * FROM cov),
rest AS (SELECT item_id, row_number() OVER (ORDER BY h, item_id) AS rn FROM neg WHERE item_id NOT IN (SELECT item_id FROM base))
SELECT * FROM base UNION ALL SELECT item_id, 'fill' FROM rest WHERE rn <= (SELECT ceil(count(*) * 20 / 100) FROM l) - (SELECT count(*) FROM base)""")
def audit_sample(spark: SparkSession, d: str) -> DataFrame:
    return judgments.audit_sample(stage(_labelled_items(spark, d), "items"))


@query(f"""{_LABELS}, a AS (SELECT item_id, CASE WHEN substr(sha256(item_id), 64, 1) = '0' THEN 1 - label ELSE label END AS a, label AS p FROM l)
SELECT count(*) AS audited, count(*) FILTER (WHERE a IS NOT DISTINCT FROM p) AS agreements, round(avg((a IS NOT DISTINCT FROM p)::INT), 9) AS rate, avg((a IS NOT DISTINCT FROM p)::INT) >= 0.9 AS ok FROM a""")
def agreement(spark: SparkSession, d: str) -> DataFrame:
    x = stage(_labelled_items(spark, d), "items")
    auditor = x.select("item_id", F.when(F.substring(F.sha2("item_id", 256), 64, 1) == "0", 1 - F.col("label")).otherwise(F.col("label")).alias("label"))
    return judgments.agreement(x.select("item_id", "label"), auditor)


@query(f"""WITH r AS ({S.ranked(S.RUN.format("dense"))}), q AS ({S.QRELS}), t AS (SELECT r.qid, CASE WHEN r.doc_id NOT IN (SELECT doc_id FROM bank WHERE doc_id IS NOT NULL) THEN NULL WHEN q.grade = 1 THEN 1 ELSE 0 END AS label FROM r LEFT JOIN q ON q.qid = r.qid AND q.doc_id = r.doc_id WHERE rank <= 10),
g AS (SELECT qid, count(*) FILTER (WHERE label = 1) AS known, count(*) FILTER (WHERE label IS NULL) AS unknown FROM t GROUP BY qid)
SELECT qid, known, unknown, (known * 10 / 10)::DOUBLE AS low, ((known + unknown) * 10 / 10)::DOUBLE AS high, CASE WHEN known * 10 / 10 >= 2 THEN 'robust_pass' WHEN NOT (known + unknown) * 10 / 10 >= 2 THEN 'robust_fail' ELSE 'label_sensitive' END AS status FROM g""")
def label_bounds(spark: SparkSession, d: str) -> DataFrame:
    bank = table(spark, d, "bank").where("doc_id is not null").select("doc_id").distinct().withColumn("b", F.lit(1))
    r = fusion.truncate(system_run(spark, d, "dense"), 10).join(qrels(spark, d), ["qid", "doc_id"], "left").join(bank, "doc_id", "left")
    items = r.select("qid", "doc_id", "rank", F.when(F.col("b").isNull(), None).otherwise(F.coalesce("grade", F.lit(0))).alias("label"))
    x = decisions.threshold_status(decisions.label_bounds(items), 2.0)
    return x.withColumn("low", F.col("low").cast("double")).withColumn("high", F.col("high").cast("double"))
