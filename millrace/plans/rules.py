"""Queries on join shapes, judgements, candidate lists, decisions and bounds."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import text as X
from millrace.operators import aggregates, ann, decisions, decontam, dense, fusion, graph, integrity, joins, judgments, lexical, metrics, mining, sampling, stats, vocabulary
from millrace.session import scratch, stage, table
from millrace.sources import readers, sinks

from . import sql as S
from .inference import _PAIRS, _UNITS, paired_scores
from .registry import query
from .corpus import _DI, _QI, _hits_sql, items
from .retrieval import _BM25, _KNN, _LABELS, _TWO, _label_qrels, _labelled_items, _scores, _two, _vector_run, documents, qrels, scores_sql, searches, system_run, vectors

_POSITIVES = "(SELECT DISTINCT qid, unnest(positive_ids) AS doc_id FROM query_spec WHERE qid IS NOT NULL)"


def _positives(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_spec").where("qid is not null").select("qid", F.explode("positive_ids").alias("doc_id")).where("doc_id is not null").distinct()


def _bank_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bank").where("doc_id is not null").select("doc_id").distinct()


@query(f"SELECT qid, max(text) AS text FROM query_spec WHERE qid IN (SELECT qid FROM {_POSITIVES} WHERE doc_id IS NOT NULL) GROUP BY qid")
def judged_queries(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_spec").where("qid is not null").groupBy("qid").agg(F.max("text").alias("text"))
    return joins.with_judgements(q, qrels(spark, d))


@query(f"""WITH s AS (SELECT DISTINCT source AS store, unit_id AS doc_id FROM documents WHERE source IS NOT NULL), i AS (SELECT store, doc_id, row_number() OVER (ORDER BY store, md5(doc_id), doc_id) - 1 AS row_id FROM s),
p AS (SELECT qid, 'tracker' AS store, doc_id FROM {_POSITIVES} WHERE doc_id IS NOT NULL) SELECT store, doc_id, qid, row_id FROM p LEFT JOIN i USING (store, doc_id)""")
def pool_rows(spark: SparkSession, d: str) -> DataFrame:
    pool = readers.row_index(documents(spark, d).where("source is not null").select(F.col("source").alias("store"), F.col("unit_id").alias("doc_id")))
    return joins.resolve(_positives(spark, d).withColumn("store", F.lit("tracker")), pool, ["store", "doc_id"])


@query("SELECT unit_id, min(kind) AS kind FROM documents WHERE kind IS NOT NULL GROUP BY unit_id")
def unit_kinds(spark: SparkSession, d: str) -> DataFrame:
    return joins.single_label(documents(spark, d), "unit_id", "kind")


_AUDIT = "au AS (SELECT item_id, CASE WHEN substr(sha256(item_id), 64, 1) = '0' THEN 1 - label ELSE label END AS label FROM l WHERE substr(sha256(item_id), 63, 1) < '8')"


def _audited(items: DataFrame) -> DataFrame:
    """Labels of a second reader for half of the items, some of them other ones."""
    h = F.sha2("item_id", 256)
    return items.where(F.substring(h, 63, 1) < "8").select("item_id", F.when(F.substring(h, 64, 1) == "0", 1 - F.col("label")).otherwise(F.col("label")).alias("label"))


@query(f"""{_LABELS}, {_AUDIT} SELECT l.item_id, CASE WHEN l.label IS NOT NULL AND (au.item_id IS NULL OR l.label IS NOT DISTINCT FROM au.label) THEN l.label END AS label,
CASE WHEN l.label IS NOT NULL AND (au.item_id IS NULL OR l.label IS NOT DISTINCT FROM au.label) THEN 'known' ELSE 'unknown' END AS status FROM l LEFT JOIN au USING (item_id)""")
def resolved_labels(spark: SparkSession, d: str) -> DataFrame:
    x = stage(_labelled_items(spark, d), "items")
    return joins.label_resolution(x, x.select("item_id", "label"), _audited(x))


@query(f"""{_LABELS}, {_AUDIT} SELECT l.item_id, CASE WHEN l.label IS NULL OR (au.item_id IS NOT NULL AND l.label IS DISTINCT FROM au.label) THEN (substr(sha256('final' || l.item_id), 64, 1) < '8')::INT ELSE l.label END AS label FROM l LEFT JOIN au USING (item_id)""")
def frozen_labels(spark: SparkSession, d: str) -> DataFrame:
    x = stage(_labelled_items(spark, d), "items")
    primary, second = x.select("item_id", "label"), stage(_audited(x), "audit")
    status = joins.label_resolution(x, primary, second)
    final = status.where("status = 'unknown'").select("item_id", (F.substring(F.sha2(F.concat(F.lit("final"), "item_id"), 256), 64, 1) < "8").cast("int").alias("label"))
    authors = documents(spark, d).select("author").where("author is not null").distinct()
    return judgments.freeze_labels(primary, second, stage(final, "final"), ("reader one", "reader two"), authors)


@query("SELECT doc_id, (length(coalesce(text, '')) % 3)::INT AS judgement FROM documents")
def aligned_sheet(spark: SparkSession, d: str) -> DataFrame:
    x = documents(spark, d).select("doc_id", F.col("doc_id").alias("line"), (F.length(F.coalesce("text", F.lit(""))) % 3).cast("int").alias("judgement"))
    return judgments.align_sheet(x, x.select("line", "doc_id"), "doc_id")


@query("SELECT qid, text FROM (SELECT qid, max(text) AS text FROM query_spec WHERE qid IS NOT NULL GROUP BY qid) WHERE substr(md5(qid), 1, 1) < 'c'")
def cleared_queries(spark: SparkSession, d: str) -> DataFrame:
    x = stage(table(spark, d, "query_spec").where("qid is not null").groupBy("qid").agg(F.max("text").alias("text")), "queries")
    content = F.coalesce("text", F.lit(""))
    made = x.select("qid", F.when(F.substring(F.md5("qid"), 1, 1) < "c", "clear").otherwise("drop").alias("decision"), F.sha2(content, 256).alias("content_sha"))
    return judgments.apply_adjudications(x, made, "qid", content)


@query(f"SELECT count(*) AS collisions FROM (SELECT DISTINCT source_doc FROM query_spec WHERE source_doc IS NOT NULL AND source_doc IN (SELECT doc_id FROM {_POSITIVES}))")
def role_collisions(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "query_spec").where("source_doc is not null").select(F.col("source_doc").alias("unit"))
    return joins.role_collisions(a, _positives(spark, d).select(F.col("doc_id").alias("unit")), "unit")


@query("""WITH a AS (SELECT DISTINCT unit_id AS doc_id FROM documents WHERE unit_id IS NOT NULL), b AS (SELECT DISTINCT doc_id FROM bank WHERE doc_id IS NOT NULL)
SELECT doc_id, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT doc_id, 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def bank_differences(spark: SparkSession, d: str) -> DataFrame:
    return joins.set_differences(documents(spark, d).where("unit_id is not null").select(F.col("unit_id").alias("doc_id")), _bank_ids(spark, d), "doc_id")


@query("""SELECT doc_id, CASE WHEN author IN (SELECT author FROM documents WHERE kind = 'chat_line') THEN 'author' WHEN artifact_id IN (SELECT artifact_id FROM documents WHERE kind = 'release_note') THEN 'thread' WHEN source = 'manual' THEN 'source' END AS reason FROM documents""")
def exclusion_reasons(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "author", "artifact_id", "source", "kind")
    rules = [("author", "author", docs.where("kind = 'chat_line'").select("author")), ("thread", "artifact_id", docs.where("kind = 'release_note'").select("artifact_id")), ("source", "source", docs.where("source = 'manual'").select("source"))]
    return joins.excluded(docs, rules).select("doc_id", "reason")


_FORMS = {"tracker": "thread", "reviews": "thread", "manual": "page", "changelog": "page", "code": "comment"}


@query("SELECT doc_id, CASE source " + " ".join(f"WHEN '{s}' THEN '{f}'" for s, f in _FORMS.items()) + " ELSE 'other' END AS form FROM documents")
def source_forms(spark: SparkSession, d: str) -> DataFrame:
    return joins.routed(documents(spark, d), "source", _FORMS, "other").select("doc_id", "form")


_REJECT = {"version": r"[0-9]+\.[0-9]+", "question": r"\?", "error": r"(?i)error|fail", "short": r"^\S*$"}


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(title, '{p}') THEN '{n}'" for n, p in _REJECT.items()) + " END AS reject FROM documents WHERE title IS NOT NULL")
def title_rejects(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("title is not null").select("doc_id", X.first_match(F.col("title"), _REJECT).alias("reject"))


@query(f"WITH {scores_sql('dense', 's')} SELECT round(avg(m), 9) AS macro, count(*) AS components FROM (SELECT domain, avg(ndcg) AS m FROM s WHERE domain IN ('storage', 'hardware') GROUP BY domain)")
def other_domain_macro(spark: SparkSession, d: str) -> DataFrame:
    return metrics.subset_macro(_scores(spark, d, "dense"), "domain", "ndcg", ["storage", "hardware"])


_HALF = "(strpos('0123456789abcdef', substr(sha256(qid), 64, 1)) - 1) % 2"


@query(f"WITH {scores_sql('dense', 's')} SELECT half::INT AS half, round(avg(m), 9) AS macro, count(*) AS components FROM (SELECT {_HALF} AS half, domain, avg(ndcg) AS m FROM s GROUP BY 1, 2) GROUP BY half")
def half_macros(spark: SparkSession, d: str) -> DataFrame:
    return metrics.half_macros(_scores(spark, d, "dense"), "domain", "ndcg")


@query(f"""{_TWO}, g AS (SELECT k, (row_number() OVER (ORDER BY p) - 1)::INT AS grid_pos FROM (VALUES (1, 2), (2, 6), (3, 11), (4, 61)) x(p, k)),
f AS (SELECT grid_pos, qid, doc_id, round(sum(x), 12) AS score FROM (SELECT grid_pos, qid, doc_id, 0.5 / (k + rank) AS x FROM a, g UNION ALL SELECT grid_pos, qid, doc_id, 0.5 / (k + rank) FROM b, g) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY grid_pos, qid ORDER BY score DESC, doc_id) AS rank FROM f), q AS ({S.QRELS}),
h AS (SELECT r.grid_pos, r.qid, max(1.0 / rank) AS value FROM r JOIN q ON q.qid = r.qid AND q.doc_id = r.doc_id GROUP BY ALL),
m AS (SELECT {_HALF} AS half, grid_pos, round(avg(value), 9) AS m FROM h GROUP BY 1, 2), b1 AS (SELECT *, row_number() OVER (PARTITION BY half ORDER BY m DESC, grid_pos) AS n FROM m)
SELECT x.half::INT AS fitted_on, x.grid_pos, x.m AS fitted, y.m AS scored FROM b1 x LEFT JOIN m y ON y.grid_pos = x.grid_pos AND y.half = 1 - x.half WHERE x.n = 1""")
def split_half_setting(spark: SparkSession, d: str) -> DataFrame:
    r = _two(spark, d)
    grid = fusion.rrf_grid(r["dense"], r["lexical"], (2, 6, 11, 61), (0.5,))
    value = grid.join(qrels(spark, d), ["qid", "doc_id"]).groupBy("grid_pos", "qid").agg(F.max(1.0 / F.col("rank")).alias("value"))
    return fusion.split_half(value)


@query(S.ranked(S.RUN.format("sparse")))
def full_ranking(spark: SparkSession, d: str) -> DataFrame:
    return fusion.ranked(system_run(spark, d, "sparse"))


@query("""SELECT event_type, count(*) AS n, count(k) AS with_k, sum(k)::BIGINT AS total FROM (SELECT event_type, nullif(regexp_extract(props, '"k": ([0-9]+)', 1), '')::INT AS k FROM events) GROUP BY event_type""")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("p.k").alias("with_k"), F.sum("p.k").alias("total"))


@query(f"""{_TWO}, t AS (SELECT coalesce(x.qid, y.qid) AS qid, coalesce(x.doc_id, y.doc_id) AS doc_id, (coalesce(x.rank, 99) <= 10)::INT - (coalesce(y.rank, 99) <= 10)::INT AS gain FROM (SELECT * FROM a WHERE rank <= 10) x FULL JOIN (SELECT * FROM b WHERE rank <= 10) y ON x.qid = y.qid AND x.doc_id = y.doc_id),
q AS ({S.QRELS}), l AS (SELECT t.*, CASE WHEN t.doc_id NOT IN (SELECT doc_id FROM bank WHERE doc_id IS NOT NULL) THEN NULL ELSE coalesce(q.grade, 0) END AS label FROM t LEFT JOIN q ON q.qid = t.qid AND q.doc_id = t.doc_id)
SELECT sum(CASE WHEN label = 1 THEN gain WHEN label IS NULL THEN least(gain, 0) ELSE 0 END)::BIGINT AS low, sum(CASE WHEN label = 1 THEN gain WHEN label IS NULL THEN greatest(gain, 0) ELSE 0 END)::BIGINT AS high FROM l""")
def label_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Every assignment of a query's unknown labels, then the least and greatest sum over queries."""
    r = _two(spark, d)
    a, b = (fusion.truncate(r[s], 10).select("qid", "doc_id", F.col("rank").alias(f"rank_{n}")) for n, s in (("a", "dense"), ("b", "lexical")))
    known = _bank_ids(spark, d).withColumn("b", F.lit(1))
    x = a.join(b, ["qid", "doc_id"], "full").join(qrels(spark, d), ["qid", "doc_id"], "left").join(known, "doc_id", "left")
    items = x.select("qid", "doc_id", "rank_a", "rank_b", F.when(F.col("b").isNull(), None).otherwise(F.coalesce("grade", F.lit(0))).alias("label"))
    return decisions.contrast_bounds(decisions.label_states(items, "rank_a", "rank_b"))


_BUCKET = "lower(trim(bucket, e' \\t\\r\\n'))"


@query(f"""WITH h AS (SELECT {_BUCKET} AS bucket, count(DISTINCT qid) AS n FROM query_spec WHERE {_BUCKET} IN ('general', 'coverage', 'alias') GROUP BY 1),
a AS (SELECT p, s.bucket, coalesce(n, 0) AS n, least(coalesce(n, 0), floor(900 * share)::BIGINT) AS m FROM (VALUES (1, 'general', 0.5), (2, 'coverage', 0.4), (3, 'alias', 0.1)) s(p, bucket, share) LEFT JOIN h USING (bucket)),
b AS (SELECT *, 900 - (SELECT sum(m) FROM a) AS free, coalesce(sum(n - m) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a)
SELECT bucket, n AS available, (m + greatest(0, least(n - m, free - before)))::BIGINT AS planned FROM b""")
def bucket_plan(spark: SparkSession, d: str) -> DataFrame:
    b = F.lower(F.trim(F.col("bucket"), F.lit(" \t\r\n")))
    have = table(spark, d, "query_spec").groupBy(b.alias("bucket")).agg(F.count_distinct("qid").alias("available"))
    return sampling.plan_table(have, {"general": 0.5, "coverage": 0.4, "alias": 0.1}, 900)


@query(f"""WITH {_BM25}, c AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS slot FROM bmr WHERE rank <= 1000 AND rank > 2 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE kind = 'release_note')),
k AS (SELECT *, max(slot) OVER (PARTITION BY qid) AS n FROM c WHERE slot <= 5) SELECT qid, slot::INT AS slot, doc_id FROM k UNION ALL SELECT qid, unnest(range(n + 1, 6))::INT, doc_id FROM k WHERE slot = n AND n < 5""")
def lexical_negatives(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    best = stage(lexical.bm25(docs, searches(spark, d), 2).select("qid", "doc_id"), "best")
    return lexical.bm25_negatives(docs, searches(spark, d), best, docs.where("kind = 'release_note'"), 5)


@query(f"WITH {_KNN} SELECT qid, doc_id, score, rank FROM r WHERE rank <= 10")
def kept_run(spark: SparkSession, d: str) -> DataFrame:
    """A run kept under the identity of its inputs: built once, read from then on."""
    identity = sinks.table_identity(table(spark, d, "embeddings")).first().identity
    root = scratch(spark, "kept")
    sinks.cached(spark, root, identity, lambda: _vector_run(spark, d, 10), "knn")
    return sinks.cached(spark, root, identity, lambda: 1 / 0, "knn")


@query(f"WITH {_KNN} SELECT qid, doc_id, score, rank FROM r WHERE rank <= 10")
def index_exhaustive(spark: SparkSession, d: str) -> DataFrame:
    """The vector index with as many probes as cells: exact."""
    return ann.search(_index(spark, d), vectors(spark, d).where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), "vector"), 10, 16)


def _index(spark: SparkSession, d: str) -> ann.Index:
    return ann.build(vectors(spark, d).select("doc_id", "vector"), scratch(spark, "index"), 16)


@query()
def index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the vector index by probes, against exact search."""
    return ann.recall_sweep(_index(spark, d), vectors(spark, d).where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), "vector"), [1, 2, 4, 8, 16])


@query(f"""WITH {_KNN}, n AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, round(list_inner_product(list_transform(a.embedding::DOUBLE[], lambda x, i: CASE WHEN i <= 32 THEN x ELSE 0 END), b.embedding::DOUBLE[]), 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM n) SELECT 'whole' AS variant, qid, doc_id, score, rank FROM r WHERE rank <= 5 UNION ALL SELECT 'half', qid, doc_id, score, rank FROM h WHERE rank <= 5""")
def variant_search(spark: SparkSession, d: str) -> DataFrame:
    """Two encodings of the queries searched in one pass."""
    v = vectors(spark, d).select("doc_id", "vector")
    q = v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), "vector")
    makers = {"whole": lambda t: t.select("qid", "vector"), "half": lambda t: t.select("qid", F.transform("vector", lambda x, i: F.when(i < 32, x).otherwise(F.lit(0.0))).alias("vector"))}
    return dense.knn_variants(dense.encoded(makers, q), v, 5)


@query(f"""WITH {_KNN}, m AS (SELECT a.doc_id AS qid, i, avg(x) AS x FROM v a JOIN (SELECT doc_id, label, unnest(range(1, 65)) AS i, unnest(v) AS x FROM v WHERE doc_id % 10 = 3) b ON b.label = a.label WHERE a.doc_id % 100 = 0 GROUP BY 1, 2),
c AS (SELECT qid, i, x / sqrt(sum(x * x) OVER (PARTITION BY qid)) AS x FROM m), p AS (SELECT qid, i, v.v[i] * 0.5 + c.x * 0.5 AS x FROM c JOIN v ON v.doc_id = c.qid)
SELECT qid, i::INT AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY qid)), 6) AS x FROM p""")
def centroid_targets(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    q = v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), "vector", "label")
    pairs = v.where("doc_id % 10 = 3").join(q.select("qid", "label"), "label").select("qid", "doc_id")
    t = dense.centroid_targets(pairs, v.select("doc_id", "vector"), q.select("qid", "vector"))
    return t.select("qid", F.posexplode("vector").alias("i", "x")).select("qid", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


@query(f"""WITH r AS ({S.RUN.format("dense")}), o AS (SELECT DISTINCT q.qid, b.unit_id AS doc_id FROM query_spec q JOIN documents a ON a.unit_id = q.source_doc JOIN documents b ON b.artifact_id = a.artifact_id)
SELECT qid, doc_id, score FROM r WHERE (qid, doc_id) NOT IN (SELECT qid, doc_id FROM o WHERE qid IS NOT NULL AND doc_id IS NOT NULL)""")
def without_own_source(spark: SparkSession, d: str) -> DataFrame:
    units = documents(spark, d).where("unit_id is not null and artifact_id is not null").select(F.col("unit_id").alias("doc_id"), F.col("artifact_id").alias("object_id")).distinct()
    own = table(spark, d, "query_spec").where("qid is not null").join(units, F.col("source_doc") == F.col("doc_id")).select("qid", "object_id").distinct()
    return fusion.exclude_sources(system_run(spark, d, "dense"), own, units)


@query(f"WITH r AS ({S.ranked(S.RUN.format('dense'))}) SELECT qid, doc_id FROM r WHERE rank <= 10 AND (qid, doc_id) NOT IN (SELECT qid, doc_id FROM ({S.QRELS}) WHERE doc_id IS NOT NULL)")
def unjudged_hits(spark: SparkSession, d: str) -> DataFrame:
    return metrics.unjudged(fusion.truncate(system_run(spark, d, "dense"), 10), qrels(spark, d))


@query(f"WITH {scores_sql('dense', 's')} SELECT DISTINCT q.qid, coalesce(s.ndcg, 0.0) AS ndcg FROM query_spec q LEFT JOIN s USING (qid) WHERE q.qid IS NOT NULL")
def scores_of_all_queries(spark: SparkSession, d: str) -> DataFrame:
    return metrics.with_missing(_scores(spark, d, "dense"), table(spark, d, "query_spec").where("qid is not null"), "ndcg")


_DELTAS = f"""{_UNITS}, dr AS ({S.picks("sz", stats.BOOTSTRAP, "b", "domain")}), mm AS (SELECT rep, dr.domain, avg(d) AS m FROM dr JOIN k ON k.domain = dr.domain AND k.k = dr.k GROUP BY rep, dr.domain),
de AS (SELECT rep, round(avg(m), 12) AS delta FROM mm GROUP BY rep), ob AS (SELECT avg(m) AS o FROM (SELECT avg(a - b) AS m FROM p GROUP BY domain))"""


@query(f"WITH {_DELTAS} SELECT round(quantile_disc(delta, 0.025), 6) AS lower, round(quantile_disc(delta, 0.975), 6) AS upper, quantile_disc(delta, 0.975) < 0.005 AS equivalent FROM de")
def equivalence_bounds(spark: SparkSession, d: str) -> DataFrame:
    return stats.one_sided_bounds(stats.bootstrap_deltas(paired_scores(spark, d), "domain", "qid", stats.BOOTSTRAP, "b"), 0.975, 0.005)


@query(f"WITH {_DELTAS} SELECT round(quantile_cont(delta, 0.05 / 3), 6) AS lower FROM de")
def bonferroni_bound(spark: SparkSession, d: str) -> DataFrame:
    return stats.bonferroni_lower(stats.bootstrap_deltas(paired_scores(spark, d), "domain", "qid", stats.BOOTSTRAP, "b")).select(F.round("lower", 6).alias("lower"))


@query(f"WITH {_DELTAS}, g AS (SELECT domain, var_samp(a - b) / count(*) AS v FROM p GROUP BY domain), s AS (SELECT round(sqrt(sum(v)) / count(*), 9) AS se FROM g) SELECT round(avg((abs(delta - round(o, 12)) > 1.959963985 * se)::INT), 9) AS exceed FROM de, ob, s")
def studentized_share(spark: SparkSession, d: str) -> DataFrame:
    p = paired_scores(spark, d)
    return stats.studentized_calibration(stats.bootstrap_deltas(p, "domain", "qid", stats.BOOTSTRAP, "b"), p, "domain")


_LEGS = f"""WITH {_PAIRS}, g AS (SELECT domain, avg(a - b) AS delta, stddev_samp(a - b) / sqrt(count(*)) AS se FROM p GROUP BY domain),
legs AS (SELECT CASE WHEN domain < 'h' THEN 'first' ELSE 'second' END AS family, domain, delta, delta + 1.96 * se AS upper, delta - 1.96 * se AS ci_low, delta - 2.4 * se AS lower, delta > 0 AS rejected FROM g)"""


def _legs(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("a") - F.col("b")
    g = paired_scores(spark, d).groupBy("domain").agg(F.avg(x).alias("delta"), (F.stddev_samp(x) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return g.select(F.when(F.col("domain") < "h", "first").otherwise("second").alias("family"), "domain", "delta", (F.col("delta") + 1.96 * F.col("se")).alias("upper"), (F.col("delta") - 1.96 * F.col("se")).alias("ci_low"), (F.col("delta") - 2.4 * F.col("se")).alias("lower"), (F.col("delta") > 0).alias("rejected"))


@query(f"{_LEGS} SELECT family, bool_and(coalesce(rejected AND ci_low > 0 AND lower > 0, false)) AS ships, round(min(delta), 9) AS worst FROM legs GROUP BY family")
def family_decision(spark: SparkSession, d: str) -> DataFrame:
    return decisions.family_decision(_legs(spark, d))


@query(f"{_LEGS} SELECT domain, delta < -0.01 AND upper < -0.01 AS vetoed FROM legs")
def vetoes(spark: SparkSession, d: str) -> DataFrame:
    return decisions.veto(_legs(spark, d), 0.01).select("domain", "vetoed")


@query(f"{_LEGS}, t AS (SELECT domain, delta FROM legs WHERE delta > 0 AND delta = (SELECT max(delta) FROM legs WHERE delta > 0)) SELECT CASE WHEN count(*) = 1 THEN min(domain) END AS winner FROM t")
def winning_arm(spark: SparkSession, d: str) -> DataFrame:
    return decisions.winner(_legs(spark, d).select(F.col("domain").alias("arm"), F.col("delta").alias("estimate"), (F.col("delta") > 0).alias("resolves")))


@query("""SELECT min_by(phase, (b, s, (phase <> 'final')::INT, phase)) AS winner FROM (SELECT phase, max(batch)::BIGINT AS b, max(steps)::BIGINT AS s FROM run_cfg WHERE phase IS NOT NULL GROUP BY phase)""".replace("min_by(phase, (b, s, (phase <> 'final')::INT, phase))", "first(phase ORDER BY b, s, (phase <> 'final')::INT, phase)"))
def cheapest_arm(spark: SparkSession, d: str) -> DataFrame:
    arms = table(spark, d, "run_cfg").where("phase is not null").groupBy(F.col("phase").alias("arm")).agg(F.max("batch").cast("long").alias("params"), F.max("steps").cast("long").alias("layers"))
    return decisions.cheapest(arms, "final")


@query("""WITH s AS (SELECT s_nationkey % 5 AS seed, max(s_acctbal) AS winner, avg(s_acctbal) AS default_score FROM supplier GROUP BY 1)
SELECT bool_and(winner - default_score > 0) AND avg(winner - default_score) FILTER (WHERE seed >= 3) >= avg(winner - default_score) FILTER (WHERE seed < 3) / 2 AS stands FROM s""")
def confirmation(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "supplier").groupBy((F.col("s_nationkey") % 5).alias("seed")).agg(F.max("s_acctbal").alias("winner"), F.avg("s_acctbal").alias("default_score"))
    return decisions.confirmation_stands(x.withColumn("fresh", F.col("seed") >= 3))


@query("""WITH c AS (SELECT o_orderpriority AS name, avg(o_totalprice) AS value FROM orders GROUP BY 1), t AS (SELECT name, value, CASE WHEN name < '3' THEN value > 250000 ELSE value >= 1000 END AS ok FROM c)
SELECT bool_and(ok) AS eligible, coalesce(string_agg(CASE WHEN NOT ok THEN name END, ',' ORDER BY name), '') AS failed FROM t""")
def eligible(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.avg("o_totalprice").alias("value"))
    strict = F.col("name") < "3"
    return decisions.eligibility(x.withColumns({"strict": strict, "threshold": F.when(strict, 250000.0).otherwise(1000.0)}))


_EVALS = "e AS (SELECT o_orderstatus || (o_custkey % 20) AS run, o_orderkey AS step, CASE WHEN o_orderkey % 2 = 0 THEN 'middle' ELSE 'end' END AS kind, CASE WHEN o_orderkey % 997 = 0 THEN NULL ELSE o_totalprice END AS value FROM orders WHERE o_custkey < 400)"


def _evals(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_custkey < 400")
    return o.select(F.concat("o_orderstatus", (F.col("o_custkey") % 20).cast("string")).alias("run"), F.col("o_orderkey").alias("step"), F.when(F.col("o_orderkey") % 2 == 0, "middle").otherwise("end").alias("kind"), F.when(F.col("o_orderkey") % 997 == 0, None).otherwise(F.col("o_totalprice")).alias("value"))


@query(f"""WITH {_EVALS}, b AS (SELECT *, value IS NULL AS broken, coalesce(value < max(value) OVER (PARTITION BY run, kind ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 300000, false) AS bad FROM e),
c AS (SELECT *, bad AND coalesce(lag(bad) OVER (PARTITION BY run ORDER BY step), false) AS again FROM b), f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS n FROM c WHERE broken OR again)
SELECT run, step AS at, CASE WHEN broken THEN 'not finite' ELSE 'two in a row' END AS reason FROM f WHERE n = 1""")
def stopped_runs(spark: SparkSession, d: str) -> DataFrame:
    return decisions.kill_rule(_evals(spark, d), 300000.0)


@query(f"""WITH {_EVALS}, c AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY step) AS cycle, value FROM e WHERE value IS NOT NULL), g AS (SELECT *, value - max(value) OVER (PARTITION BY run ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gain FROM c)
SELECT run, min(cycle) AS at FROM g WHERE cycle >= 3 AND gain < 1000 GROUP BY run""")
def plateaus(spark: SparkSession, d: str) -> DataFrame:
    e = sampling.range_numbers(_evals(spark, d).where("value is not null"), ["run"], [F.col("run"), F.col("step")], "cycle")
    return decisions.plateau_rule(e, 1000.0, 3)


@query("SELECT min(unit_id) AS doc_id FROM documents WHERE unit_id NOT IN (SELECT doc_id FROM bank WHERE doc_id IS NOT NULL)")
def fallback_unit(spark: SparkSession, d: str) -> DataFrame:
    return mining.fallback_row(documents(spark, d).where("unit_id is not null").select(F.col("unit_id").alias("doc_id")), _bank_ids(spark, d))


@query(f"""{_TWO}, x AS (SELECT qid, doc_id FROM a WHERE rank <= 20), y AS (SELECT qid, doc_id FROM b WHERE rank <= 20), nx AS (SELECT qid, count(*) AS nx FROM x GROUP BY 1), ny AS (SELECT qid, count(*) AS ny FROM y GROUP BY 1),
n AS (SELECT qid, count(*) AS n FROM x JOIN y USING (qid, doc_id) GROUP BY 1) SELECT qid, round(coalesce(n, 0) / least(nx, ny), 9) AS shared FROM nx JOIN ny USING (qid) LEFT JOIN n USING (qid)""")
def list_overlap(spark: SparkSession, d: str) -> DataFrame:
    r = _two(spark, d)
    return mining.list_overlap(fusion.truncate(r["dense"], 20), fusion.truncate(r["lexical"], 20), 20)


@query(f"""WITH r AS ({S.ranked(S.RUN.format("dense"))}), q AS ({S.QRELS}), p AS (SELECT r.qid, max(score) AS pos FROM r JOIN q ON q.qid = r.qid AND q.doc_id = r.doc_id GROUP BY 1)
SELECT qid, count(*) AS candidates, count(*) FILTER (WHERE score > pos - 0.05) AS masked FROM r JOIN p USING (qid) WHERE rank <= 20 GROUP BY qid""")
def masked_candidates(spark: SparkSession, d: str) -> DataFrame:
    run = system_run(spark, d, "dense")
    best = run.join(qrels(spark, d), ["qid", "doc_id"]).groupBy("qid").agg(F.max("score").alias("score"))
    m = mining.false_negative_mask(fusion.truncate(run, 20), best, 0.05)
    return m.groupBy("qid").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("masked").alias("masked"))


@query(f"SELECT qid, doc_id FROM {_POSITIVES} WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM bank WHERE doc_id IS NOT NULL)")
def positives_outside_bank(spark: SparkSession, d: str) -> DataFrame:
    return mining.positives_outside(_positives(spark, d), _bank_ids(spark, d))


@query("""WITH p AS (SELECT DISTINCT doc_id FROM bank WHERE doc_id IS NOT NULL), q AS (SELECT qid, min(doc_id) AS pos FROM (SELECT DISTINCT qid, unnest(positive_ids) AS doc_id FROM query_spec WHERE qid IS NOT NULL) WHERE doc_id IS NOT NULL GROUP BY qid)
SELECT 'positive' AS source, count(*) AS wanted, count(*) AS filled, 0::BIGINT AS short FROM q""")
def candidate_shortfall(spark: SparkSession, d: str) -> DataFrame:
    none = qrels(spark, d).select("qid", "doc_id", F.lit(0.0).alias("score")).limit(0)
    mix = mining.candidate_mix(qrels(spark, d), none, none, _bank_ids(spark, d), 0, 0, 0, "mix")
    return mining.shortfalls(mix, {"positive": 1})


@query("SELECT DISTINCT term FROM term_stat WHERE length(lower(term)) <= 6 AND (regexp_matches(lower(term), '[0-9]') OR NOT regexp_matches(lower(term), '[aeiouy]'))")
def short_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "term_stat").where(X.is_abbreviation(F.col("term"))).select("term").distinct()


@query("""WITH w AS (SELECT DISTINCT p_name AS term FROM part), c AS (SELECT term, ascii(unnest(string_split(term, ''))) AS piece FROM w), n AS (SELECT term, piece, sqrt(count(*)) AS w FROM c GROUP BY 1, 2),
v AS (SELECT vec_id AS piece, unnest(range(0, 64)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings) SELECT term, i::INT AS i, round(sum(w * v), 6) AS v FROM n JOIN v USING (piece) GROUP BY 1, 2""")
def new_term_rows(spark: SparkSession, d: str) -> DataFrame:
    pieces = table(spark, d, "part").select(F.col("p_name").alias("term")).distinct().select("term", F.explode(F.split("term", "")).alias("c")).where("c <> ''").select("term", F.ascii("c").cast("long").alias("piece"))
    r = vocabulary.new_rows(pieces, vectors(spark, d).select(F.col("doc_id").alias("piece"), "vector"))
    return r.select("term", F.posexplode("vector").alias("i", "v")).select("term", "i", F.round("v", 6).alias("v"))


@query("SELECT pos, gram, n FROM (SELECT gram, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, gram) AS pos FROM (SELECT unnest(" + S.kgrams("w", 2) + f") AS gram FROM (SELECT {S.words('text')} AS w FROM documents)) GROUP BY gram) WHERE pos <= 50")
def top_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.top_grams(documents(spark, d), A.kgrams(X.fingerprint_words(F.col("text")), 2), 50)


_STORES = "(VALUES ('table16', 64, 2, 0), ('table8', 64, 1, 4), ('table32', 64, 4, 0))"


@query(f"SELECT store, dim, round(n * (dim * width + extra) / 1e6, 4) AS mb, round(1000000 * (dim * width + extra) / 1e9, 4) AS gb_per_million FROM {_STORES} s(store, dim, width, extra), (SELECT count(*) AS n FROM embeddings)")
def store_costs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("rows"))
    s = spark.createDataFrame([("table16", 64, 2, 0), ("table8", 64, 1, 4), ("table32", 64, 4, 0)], "store string, dim int, width int, extra int")
    return aggregates.storage_costs(s.crossJoin(F.broadcast(n)))  # one row


_PHRASES = f"""c AS (SELECT DISTINCT doc_id, kind, title AS phrase FROM documents WHERE trim(title) <> ''), o AS (SELECT doc_id, min(kind) AS kind FROM c GROUP BY 1), p AS (SELECT c.doc_id, c.kind, min(phrase) AS phrase FROM c JOIN o USING (doc_id, kind) GROUP BY 1, 2),
r AS (SELECT *, {S.order_key('draft', 'doc_id')} AS h, row_number() OVER (PARTITION BY kind ORDER BY {S.order_key('draft', 'doc_id')}, doc_id) AS n FROM p)"""


@query(f"""WITH {_PHRASES}, l AS (SELECT *, CASE WHEN n <= CASE kind WHEN 'issue_opening' THEN 10 WHEN 'manual_section' THEN 20 ELSE 0 END THEN 0 ELSE 1 END AS lead FROM r),
t AS (SELECT *, row_number() OVER (ORDER BY lead, h, doc_id) AS m FROM l) SELECT doc_id, kind, trim(regexp_replace(phrase, '\\s+', ' ', 'g')) AS query FROM t WHERE m <= 60""")
def drafted_queries(spark: SparkSession, d: str) -> DataFrame:
    c = documents(spark, d).select("doc_id", "kind", F.col("title").alias("phrase"))
    return sampling.drafted_queries(c, {"issue_opening": 10, "manual_section": 20}, 60, "draft")


@query(f"""WITH n AS (SELECT count(DISTINCT doc_id) AS n FROM documents), i AS (SELECT DISTINCT doc_id FROM documents), e AS (SELECT p, doc_id, p * n + row_number() OVER (PARTITION BY p ORDER BY md5('st:' || p || chr(31) || doc_id::VARCHAR), doc_id) - 1 AS pos FROM i, n, (SELECT unnest(range(0, 3)) AS p))
SELECT pos - (n * 3 // 2) AS step, doc_id FROM e, n WHERE pos >= n * 3 // 2 AND pos < n * 3 // 2 + n""")
def resumed_stream(spark: SparkSession, d: str) -> DataFrame:
    """A shuffled stream gone on with from its saved state, over the end of a pass."""
    docs = documents(spark, d)
    n = docs.select("doc_id").distinct().count()
    return sampling.stream_batch(docs, "doc_id", n, "st", sampling.stream_state(docs, "doc_id", n * 3 // 2))[0]


def _chain(rows: list[tuple[int, str]]) -> list[tuple[int, str, str, str]]:
    out, before = [], ""
    for i, payload in rows:
        sha = hashlib.sha256(f"{before}|{payload}".encode()).hexdigest()
        out.append((i, payload, before, sha))
        before = sha
    return out


@query("""WITH RECURSIVE n AS (SELECT n_nationkey AS seq, n_name AS payload FROM nation), c(seq, before, sha) AS (SELECT seq, '', sha256('|' || payload) FROM n WHERE seq = 0 UNION ALL SELECT n.seq, c.sha, sha256(c.sha || '|' || n.payload) FROM c JOIN n ON n.seq = c.seq + 1),
t AS (SELECT c.seq, before, sha, CASE WHEN c.seq = 7 THEN 'changed' ELSE payload END AS payload FROM c JOIN n USING (seq)) SELECT seq, sha256(before || '|' || payload) = sha AS ok FROM t""")
def ledger(spark: SparkSession, d: str) -> DataFrame:
    """A hash chain of which one payload was changed afterwards."""
    rows = [(r.n_nationkey, r.n_name) for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    made = [(i, "changed" if i == 7 else p, b, s) for i, p, b, s in _chain(rows)]
    return integrity.ledger_chain(spark.createDataFrame(made, "seq int, payload string, previous_sha string, sha string"))


_MERGES = [(105, 110, 256), (114, 105, 257), (257, 256, 258), (101, 100, 259), (97, 108, 260), (256, 103, 261)]


def _merge_sql(column: str) -> str:
    """The merges of the list one after the other, each id being one letter."""
    for a, b, new in _MERGES:
        column = f"replace({column}, chr({a}) || chr({b}), chr({new}))"
    return column


@query(f"SELECT p_partkey AS qid, length({_merge_sql('p_name')}) AS tokens, coalesce(list_sum(list_transform(string_split({_merge_sql('p_name')}, ''), lambda c: unicode(c))), 0)::BIGINT AS total FROM part")
def segmented_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("qid"), F.transform(F.filter(F.split("p_name", ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long")).alias("tokens"))
    s = dense.segment_rows(p, _MERGES)
    return s.select("qid", F.size("tokens").cast("long").alias("tokens"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"""WITH w AS (SELECT item_id AS qid, {S.words("text")} AS w FROM eval_item), g AS (SELECT unnest(['the index', 'in the', 'of the segment']) AS gram, unnest([1001, 1002, 1003]) AS token),
p AS (SELECT qid, unnest(w) AS t FROM w), x AS (SELECT qid, unnest(list_concat({S.kgrams("w", 2)}, {S.kgrams("w", 3)})) AS gram FROM w), u AS (SELECT qid, ('0x' || substr(md5(t), 1, 6))::BIGINT AS token FROM p UNION ALL SELECT qid, g.token FROM x JOIN g USING (gram))
SELECT qid, count(*) AS rows, sum(token)::BIGINT AS total FROM u GROUP BY qid""")
def gram_features(spark: SparkSession, d: str) -> DataFrame:
    """Words of the held-out texts and rows of their known phrases."""
    w = table(spark, d, "eval_item").select(F.col("item_id").alias("qid"), X.fingerprint_words(F.col("text")).alias("tokens"))
    g = spark.createDataFrame([("the index", "#1001"), ("in the", "#1002"), ("of the segment", "#1003")], "gram string, token string")
    r = dense.gram_rows(w, g)
    number = F.when(F.startswith("token", F.lit("#")), F.expr("cast(substr(token, 2) as long)")).otherwise(F.conv(F.substring(F.md5("token"), 1, 6), 16, 10).cast("long"))
    return r.groupBy("qid").agg(F.count(F.lit(1)).alias("rows"), F.sum(number).alias("total"))


@query("""WITH w AS (SELECT p_partkey AS qid, unnest(string_split(p_name, ' ')) AS w FROM part), g AS (SELECT unnest(['ed', 'ing', 'in']) AS gram, unnest([1, 2, 3]) AS token),
x AS (SELECT qid, unnest(list_concat(list_transform(range(1, length(w)), lambda i: substr(w, i, 2)), list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)))) AS gram FROM w) SELECT qid, token, count(*) AS n FROM x JOIN g USING (gram) GROUP BY 1, 2""")
def character_features(spark: SparkSession, d: str) -> DataFrame:
    g = spark.createDataFrame([("ed", 1), ("ing", 2), ("in", 3)], "gram string, token int")
    r = dense.character_rows(table(spark, d, "part").select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("text")), g)
    return r.groupBy("qid", "token").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_BM25} SELECT qid, doc_id, score, rank FROM bmr WHERE rank <= 10")
def kept_index_search(spark: SparkSession, d: str) -> DataFrame:
    """An index of postings that is written, opened again and searched."""
    path = scratch(spark, "postings")
    lexical.build_index(documents(spark, d), path)
    return lexical.search_index(lexical.open_index(spark, path), searches(spark, d), 10)


@query(f"WITH {_DELTAS} SELECT rep, round(delta, 9) AS delta FROM de")
def planned_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Replicates by a plan of draws that is kept and could serve other contrasts of the same units."""
    p = paired_scores(spark, d)
    plan = stage(stats.draw_plan(stats.numbered(p, "domain", "qid"), "domain", stats.BOOTSTRAP, "b"), "plan")
    return stats.planned_deltas(plan, p, "domain", "qid").withColumn("delta", F.round("delta", 9))


_MODES = {"mean": "n", "presence": "1.0", "cap2": "least(2.0, n)", "sqrt": "sqrt(n)"}


@query("""WITH t AS (SELECT vec_id AS token, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT l_orderkey AS q, l_suppkey % (SELECT count(*) FROM embeddings) AS token, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), """ + ", ".join(f"{m} AS (SELECT q, i, sum({w} * x) / sum({w}) AS x FROM (SELECT q, n, unnest(range(0, 64)) AS i, unnest(v) AS x FROM c JOIN t USING (token)) GROUP BY q, i)" for m, w in _MODES.items())
       + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS mode, count(DISTINCT q) AS queries, round(sum(x / l), 3) AS total FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY q)) AS l FROM {m}) WHERE l > 1e-12" for m in _MODES) + ")")
def pool_modes(spark: SparkSession, d: str) -> DataFrame:
    """Every way to weigh a token that occurs several times."""
    e = vectors(spark, d)
    n = e.agg(F.count(F.lit(1)).alias("n"))
    tok = table(spark, d, "lineitem").crossJoin(F.broadcast(n)).select(F.col("l_orderkey").alias("qid"), F.expr("l_suppkey % n").alias("token"))  # one row
    v = dense.pooled(tok, e.select(F.col("doc_id").alias("token"), "vector"), list(_MODES)).where("vector is not null")
    x = v.select("mode", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("x"))
    of = lambda m: F.struct(F.lit(m).alias("mode"), F.count_if(F.col("mode") == m).alias("queries"), F.round(F.sum(F.when(F.col("mode") == m, F.col("x"))), 3).alias("total"))
    return x.agg(F.array(*[of(m) for m in _MODES]).alias("m")).select(F.inline("m"))


@query(f"""WITH {_KNN}, t AS (SELECT qid, doc_id AS passage_id, dl AS artifact_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS n FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY qid, artifact_id ORDER BY score DESC, passage_id) AS m FROM t WHERE n <= 50)
SELECT qid, artifact_id, passage_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, artifact_id) AS rank FROM b WHERE m = 1""")
def dense_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Exact search over passages, then the best passage of each artifact."""
    p = vectors(spark, d).select(F.col("doc_id").alias("passage_id"), F.col("label").alias("artifact_id"), F.lit(None).cast("string").alias("text_hash"))
    return fusion.collapse_passages(_vector_run(spark, d, 50).select("qid", F.col("doc_id").alias("passage_id"), "score"), p, passage_depth=50)


_SHAPE = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '\b(?:v?\d+(?:\.\d+){1,3}|backport|cherry[- ]pick)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""WITH RECURSIVE k AS (SELECT doc_id::VARCHAR AS n, 'a:' || artifact_id AS k FROM documents WHERE artifact_id IS NOT NULL UNION SELECT doc_id::VARCHAR, 't:' || md5(text) FROM documents WHERE trim(text) <> '' UNION SELECT doc_id::VARCHAR, 's:' || {_SHAPE} FROM documents WHERE {_SHAPE} <> '' UNION SELECT doc_id::VARCHAR, 'u:' || unnest(list_distinct(regexp_extract_all(text, 'https?://[^\s)>"''\]]+'))) FROM documents),
e AS (SELECT DISTINCT a.k AS x, b.k AS y FROM k a JOIN k b USING (n)), r(x, y) AS (SELECT DISTINCT k, k FROM k UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), c AS (SELECT x, min(y) AS y FROM r GROUP BY x),
m AS (SELECT DISTINCT n, y FROM k JOIN c ON c.x = k.k), root AS (SELECT y, min(n) AS root FROM m GROUP BY y) SELECT d.doc_id::VARCHAR AS node, coalesce(root.root, d.doc_id::VARCHAR) AS root FROM documents d LEFT JOIN m ON m.n = d.doc_id::VARCHAR LEFT JOIN root USING (y)""")
def thread_families(spark: SparkSession, d: str) -> DataFrame:
    """Units tied by thread, equal text, restated title or a link that they share."""
    shape = X.title_shape(F.col("title"))
    x = documents(spark, d).select("doc_id", "artifact_id", F.when(F.trim("text") != "", F.md5("text")).alias("t"), F.when(shape != "", shape).alias("s"), X.urls(F.col("text")).alias("u"))
    links = graph.star_edges(x.select("doc_id", F.explode("u").alias("k")), "doc_id", "k")
    return graph.families(x, "doc_id", ["artifact_id", "t", "s"], extra=links)


@query(f"""WITH i AS (SELECT item_id, role, {S.words("text")} AS w FROM eval_item), d AS (SELECT DISTINCT {S.words("text")} AS w FROM documents), ex AS (SELECT item_id FROM i WHERE len(w) > 0 AND array_to_string(w, ' ') IN (SELECT array_to_string(w, ' ') FROM d)),
a AS (SELECT item_id, unnest({S.query_gram_keys("w")}) AS k FROM i WHERE len(w) > 0), b AS (SELECT array_to_string(w, ' ') AS s, unnest({S.query_gram_keys("w")}) AS k FROM d WHERE len(w) > 0), ne AS (SELECT DISTINCT item_id FROM (SELECT item_id, s FROM a JOIN b USING (k) GROUP BY 1, 2 HAVING count(*) >= 4))
SELECT role, count(*) AS items, round(count(*) FILTER (WHERE item_id IN (SELECT item_id FROM ex)) / count(*), 9) AS exact, round(count(*) FILTER (WHERE item_id NOT IN (SELECT item_id FROM ex) AND item_id IN (SELECT item_id FROM ne)) / count(*), 9) AS near FROM i GROUP BY role""")
def leakage_shares(spark: SparkSession, d: str) -> DataFrame:
    """What share of the held-out items of each role the corpus holds, whole or nearly."""
    return decontam.leakage_shares(items(spark, d), documents(spark, d), "item_id", "role")


@query(f"WITH {_QI}, {_hits_sql('documents', 'doc_id')}, {_DI} SELECT doc_id AS id, doc_id NOT IN (SELECT id FROM dh UNION SELECT id FROM hit) AS keep FROM documents")
def keep_mask(spark: SparkSession, d: str) -> DataFrame:
    """Which rows of the pool stay, made once for these tables and read again."""
    docs, it = documents(spark, d), items(spark, d)
    root = scratch(spark, "masks")
    doc_index, q_index = decontam.document_index(it.where("role = 'passage'"), "item_id"), decontam.query_index(it.where("role = 'query'"))
    make = lambda: decontam.keep_mask(docs, doc_index, q_index, "doc_id")
    name = decontam.mask_identity(table(spark, d, "documents"), table(spark, d, "eval_item"))
    sinks.cached(spark, root, name, make, "mask")
    return sinks.cached(spark, root, name, lambda: 1 / 0, "mask")


@query("SELECT doc_id, md5(coalesce(text, '')) AS code FROM documents")
def encoded_shards(spark: SparkSession, d: str) -> DataFrame:
    """A corpus encoded shard by shard, broken off after a few and gone on with."""
    root, done = scratch(spark, "shards"), []

    def encode(part: DataFrame, shard: int) -> DataFrame:
        if shard == 3 and 3 not in done:
            done.append(3)
            raise ConnectionError("broken off")
        done.append(shard)
        return part.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("code"))

    docs = documents(spark, d).select("doc_id", "text")
    try:
        sinks.encode_shards(docs, "doc_id", root, 6, encode)
    except ConnectionError:
        sinks.encode_shards(docs, "doc_id", root, 6, encode)
    if sorted(done) != [0, 1, 2, 3, 3, 4, 5]:
        raise AssertionError("a finished shard was encoded again")
    return spark.read.parquet(*[f"{root}/shard={i}" for i in range(6)])


@query("""WITH r AS (SELECT vec_id, embedding::DOUBLE[] AS v, vec_id % 5 AS n FROM embeddings), x AS (SELECT vec_id, n, unnest(range(0, 64)) AS i, unnest(v) AS x FROM r), m AS (SELECT i, avg(x) AS m FROM x WHERE n >= 2 GROUP BY i)
SELECT 'mean' AS policy, vec_id % 8 AS part, round(sum(CASE WHEN n >= 2 THEN x ELSE m END), 5) AS total FROM x JOIN m USING (i) GROUP BY 2 UNION ALL SELECT 'zero', vec_id % 8, round(sum(CASE WHEN n >= 2 THEN x ELSE 0 END), 5) FROM x GROUP BY 2 UNION ALL SELECT 'start', vec_id % 8, round(sum(CASE WHEN n >= 2 THEN x ELSE -x END), 5) FROM x GROUP BY 2""")
def unseen_rows(spark: SparkSession, d: str) -> DataFrame:
    """What rows of a lookup table become that were seldom updated."""
    e = vectors(spark, d).select(F.col("doc_id").alias("token"), "vector", F.transform("vector", lambda x: -x).alias("start"), (F.col("doc_id") % 5).alias("updates"))
    out = None
    for policy in ("mean", "zero", "start"):
        v = dense.unseen_policy(e, policy, 2)
        one = v.groupBy((F.col("token") % 8).alias("part")).agg(F.round(F.sum(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)), 5).alias("total")).select(F.lit(policy).alias("policy"), "part", "total")
        out = one if out is None else out.union(one)
    return out


@query(f"SELECT doc_id, CASE WHEN len({S.plain_words('text')}) < 3 THEN 'short' WHEN regexp_matches(text, '[?]') THEN 'asks' WHEN source = 'code' THEN 'code' END AS rejected FROM documents")
def screened_texts(spark: SparkSession, d: str) -> DataFrame:
    rules = {"short": lambda t: X.word_count(t["text"]) < 3, "asks": lambda t: F.contains(t["text"], F.lit("?")), "code": lambda t: t["source"] == "code"}
    return integrity.screened(documents(spark, d), rules).select("doc_id", "rejected")


@query(f"""WITH {_UNITS}, kk AS (SELECT domain, a, b, row_number() OVER (PARTITION BY domain ORDER BY md5(qid), qid) - 1 AS k FROM p), dr AS ({S.picks("sz", stats.BOOTSTRAP, "ratio", "domain")}),
v AS (SELECT rep, dr.domain, CASE WHEN sum(b) > 0 THEN sum(a) / sum(b) END AS value FROM dr JOIN kk ON kk.domain = dr.domain AND kk.k = dr.k GROUP BY 1, 2) SELECT domain, count(value) AS n, round(quantile_disc(value, 0.5), 6) AS middle FROM v GROUP BY domain""")
def ratio_replicates(spark: SparkSession, d: str) -> DataFrame:
    """Replicates of a statistic that the caller gives: the ratio of two sums."""
    r = stats.statistic_replicates(paired_scores(spark, d), "domain", "qid", ["a", "b"], lambda s, n: F.when(s["b"] > 0, s["a"] / s["b"]), stats.BOOTSTRAP, "ratio")
    return r.groupBy("domain").agg(F.count("value").alias("n"), F.round(F.expr("percentile_disc(0.5) within group (order by value)"), 6).alias("middle"))
