"""Queries on samples, splits, batches, vocabulary, sources, streams, and plain table analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import integrity, sampling, vocabulary
from millrace.session import scratch, stage, table
from millrace.sources import readers, sinks
from millrace.streaming import ingest

from . import sql as S
from .registry import query
from .retrieval import _KNN, _vector_run, documents


@query("""WITH h AS (SELECT DISTINCT source, qid, sha256(coalesce(source || ':', '') || qid) AS h FROM query_spec WHERE qid IS NOT NULL),
c AS (SELECT source, qid, list_transform(range(0, 8), lambda i: ('0x' || substr(h, 8 * i + 1, 8))::BIGINT) AS c FROM h)
SELECT source, qid, list_reduce(c, lambda a, x: (a * (4294967296 % 50) + x) % 50) % 50 = 0 AS held FROM c""")
def hash_holdout(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "query_spec").where("qid is not null").select("source", "qid").distinct()
    return sampling.held_out(x, "source", "qid")


@query("SELECT unit_id FROM (SELECT DISTINCT unit_id FROM documents WHERE unit_id IS NOT NULL) ORDER BY sha256('pick' || chr(31) || unit_id), unit_id LIMIT 100")
def lowest_hash_pick(spark: SparkSession, d: str) -> DataFrame:
    return sampling.lowest_hash(documents(spark, d), "unit_id", 100, "pick")


@query("SELECT doc_id FROM documents WHERE ('0x' || substr(sha256('unit' || chr(31) || doc_id), 1, 13))::BIGINT / 4503599627370496.0 < 0.1")
def threshold_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.threshold_sample(documents(spark, d), [F.lit("unit"), F.col("doc_id").cast("string")], 0.1).select("doc_id")


def _numbered(seed: str, key: str, group: str) -> str:
    return f"row_number() OVER (PARTITION BY {group} ORDER BY {S.order_key(seed, key)}, {key})"


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, {_numbered('quota', 'doc_id', 'source')} AS n FROM documents) WHERE n <= 20")
def quota_per_source(spark: SparkSession, d: str) -> DataFrame:
    return sampling.quota_cut(documents(spark, d).select("doc_id", "source"), ["source"], "doc_id", 20, "quota")


@query(f"""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n) AS t FROM s), q AS (SELECT source, n, floor(n * least(200, t) / t) AS q FROM s, t),
l AS (SELECT least(200, (SELECT t FROM t)) - sum(q) AS l FROM q), z AS (SELECT source, q + CASE WHEN row_number() OVER (ORDER BY n DESC, source) <= (SELECT l FROM l) THEN 1 ELSE 0 END AS quota FROM q),
r AS (SELECT doc_id, source, {_numbered('prop', 'doc_id', 'source')} AS n FROM documents) SELECT doc_id, r.source FROM r JOIN z ON z.source IS NOT DISTINCT FROM r.source WHERE n <= quota""")
def proportional_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.proportional(documents(spark, d).select("doc_id", "source"), "source", "doc_id", 200, "prop")


@query(f"""WITH n AS (SELECT greatest(1, floor(150 / count(DISTINCT coalesce(kind, '~')))) AS per FROM documents), r AS (SELECT doc_id, kind, {_numbered('eq', 'doc_id', 'kind')} AS n FROM documents),
a AS (SELECT doc_id, kind, row_number() OVER (ORDER BY CASE WHEN n <= per THEN 0 ELSE 1 END, {S.order_key('eq', 'doc_id')}, doc_id) AS m FROM r, n) SELECT doc_id, kind FROM a WHERE m <= 150""")
def equal_budget_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.equal_budget(documents(spark, d).select("doc_id", "kind"), "kind", "doc_id", 150, "eq")


@query(f"WITH g AS (SELECT artifact_id, (row_number() OVER (ORDER BY {S.order_key('fold', 'artifact_id')}, artifact_id) - 1) % 5 AS fold FROM (SELECT DISTINCT artifact_id FROM documents WHERE artifact_id IS NOT NULL)) SELECT doc_id, fold FROM documents JOIN g USING (artifact_id)")
def group_folds(spark: SparkSession, d: str) -> DataFrame:
    return sampling.k_folds(documents(spark, d).where("artifact_id is not null").select("doc_id", "artifact_id"), "artifact_id", 5, "fold").select("doc_id", "fold")


@query(f"""WITH a AS (SELECT domain, qid, max(added_at) AS t FROM query_spec WHERE domain IS NOT NULL AND qid IS NOT NULL GROUP BY 1, 2), b AS (SELECT *, floor((row_number() OVER (PARTITION BY domain ORDER BY t DESC NULLS LAST, qid DESC) - 1) / 10) AS b FROM a)
SELECT domain, qid, CASE WHEN row_number() OVER (PARTITION BY domain, b ORDER BY {S.order_key('c', 'qid')}, qid) <= 3 THEN 'confirmation' ELSE 'development' END AS part FROM b""")
def chronological_split(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "query_spec").where("domain is not null and qid is not null").groupBy("domain", "qid").agg(F.max("added_at").alias("t"))
    return sampling.chronological_split(x, "domain", "t", "qid").select("domain", "qid", "part")


@query(f"""WITH f AS (SELECT DISTINCT artifact_id, doc_id FROM documents WHERE artifact_id IS NOT NULL), n AS (SELECT artifact_id, row_number() OVER (ORDER BY {S.order_key('a', 'artifact_id')}, artifact_id) AS r FROM (SELECT DISTINCT artifact_id FROM f)),
m AS (SELECT *, {_numbered('a', 'doc_id', 'artifact_id')} AS k FROM f) SELECT artifact_id, doc_id, CASE WHEN r % 2 = 1 THEN 'a' ELSE 'b' END AS part FROM m JOIN n USING (artifact_id) WHERE k <= 3""")
def alternate_families(spark: SparkSession, d: str) -> DataFrame:
    return sampling.alternate_families(documents(spark, d).where("artifact_id is not null"), "artifact_id", "doc_id").select("artifact_id", "doc_id", "part")


@query(f"""WITH g AS (SELECT DISTINCT unit_id FROM documents WHERE kind = 'release_note'), i AS (SELECT DISTINCT unit_id FROM documents WHERE unit_id IS NOT NULL),
r AS (SELECT unit_id, row_number() OVER (ORDER BY {S.order_key('hold', 'unit_id')}, unit_id) AS n FROM i WHERE unit_id NOT IN (SELECT unit_id FROM g)) SELECT unit_id, CASE WHEN n <= 50 THEN 'held' ELSE 'train' END AS part FROM r UNION ALL SELECT unit_id, 'gate' FROM g""")
def partition_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).where("unit_id is not null").select("unit_id", "kind")
    return sampling.partition_ids(docs, "unit_id", docs.where("kind = 'release_note'").select("unit_id").distinct(), 50, "hold")


@query(f"""WITH p AS (SELECT DISTINCT kind, artifact_id FROM documents), r AS (SELECT *, {_numbered('doc', 'artifact_id', 'kind')} AS n FROM p), h AS (SELECT DISTINCT artifact_id FROM r WHERE n <= 5)
SELECT doc_id, artifact_id IN (SELECT artifact_id FROM h WHERE artifact_id IS NOT NULL) AS held FROM documents WHERE artifact_id IS NOT NULL""")
def document_holdout(spark: SparkSession, d: str) -> DataFrame:
    x = documents(spark, d).where("artifact_id is not null").select("doc_id", "kind", "artifact_id")
    return sampling.document_holdout(x, "kind", "artifact_id", 5, "doc").select("doc_id", "held")


@query(f"""WITH l AS (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, n, floor((row_number() OVER (ORDER BY n, {S.order_key('len', 'doc_id')}, doc_id) - 1) / 32)::BIGINT AS b FROM l),
o AS (SELECT b, row_number() OVER (ORDER BY {S.order_key('len', 'b')}, b) - 1 AS batch FROM (SELECT DISTINCT b FROM r)) SELECT doc_id, n, batch FROM r JOIN o USING (b)""")
def length_batches(spark: SparkSession, d: str) -> DataFrame:
    x = documents(spark, d).where("text is not null").select("doc_id", F.length("text").alias("n"))
    return sampling.length_batches(x, "n", "doc_id", 32, "len")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {S.order_key('epoch:2', 'doc_id')}, doc_id) - 1 AS pos FROM documents")
def epoch_order(spark: SparkSession, d: str) -> DataFrame:
    return sampling.epoch_order(documents(spark, d), "doc_id", 2, "epoch")


@query("SELECT step, ['a', 'a', 'b', 'c'][step % 4 + 1] AS kind, CASE step % 4 WHEN 0 THEN step // 4 * 2 WHEN 1 THEN step // 4 * 2 + 1 ELSE step // 4 END AS index FROM (SELECT unnest(range(0, (SELECT count(*) FROM region) * 20)) AS step)")
def mixed_pattern(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "region").count() * 20
    return sampling.mixed_pattern(spark.range(n).withColumnRenamed("id", "step"), ["a", "a", "b", "c"])


@query(f"""WITH r AS (SELECT kind, doc_id, {_numbered('fb', 'doc_id', 'kind')} AS rn, count(*) OVER (PARTITION BY kind) AS n FROM documents), f AS (SELECT kind, max(n) AS n FROM r GROUP BY kind), c AS (SELECT unnest(range(0, 4)) AS cycle),
o AS (SELECT cycle, kind, n, row_number() OVER (PARTITION BY cycle ORDER BY md5('fb' || chr(31) || cycle || chr(31) || kind), kind) AS form_pos FROM f, c), s AS (SELECT *, unnest(range(0, 8)) AS slot FROM o),
p AS (SELECT cycle, form_pos, kind, slot, {S.key60("'fb|' || cycle || '|' || kind || '|' || slot")} % n + 1 AS rn FROM s), b AS (SELECT p.kind FROM p JOIN r USING (kind, rn))
SELECT kind, count(*) AS presented, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM b GROUP BY kind""")
def form_balanced_shares(spark: SparkSession, d: str) -> DataFrame:
    return sampling.realized_shares(sampling.form_balanced(documents(spark, d), "kind", "doc_id", 4, 8, "fb"), "kind")


@query(f"""WITH r AS (SELECT source, doc_id, coalesce(len({S.plain_words("text")}), 0) AS t FROM documents WHERE source IN ('tracker', 'manual')),
b AS (SELECT source, doc_id, coalesce(sum(t) OVER (PARTITION BY source ORDER BY {S.order_key('tok', 'doc_id')}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
s AS (SELECT source, doc_id, floor(before / (20000.0 * CASE source WHEN 'tracker' THEN 0.7 ELSE 0.3 END / 20)) + 1 AS step FROM b) SELECT source, doc_id, step::BIGINT AS step FROM s WHERE step <= 20""")
def token_batches(spark: SparkSession, d: str) -> DataFrame:
    x = documents(spark, d).where(F.col("source").isin("tracker", "manual")).select("source", "doc_id", X.word_count(F.col("text")).alias("t"))
    return sampling.token_batches(x, "source", "doc_id", "t", 20, 20000, {"tracker": 0.7, "manual": 0.3}, "tok")


@query(f"""WITH r AS (SELECT CASE WHEN source = 'tracker' THEN 'tracker' ELSE 'other' END AS role, doc_id, coalesce(len({S.plain_words("text")}), 0) AS t FROM documents),
b AS (SELECT role, doc_id, coalesce(sum(t) OVER (PARTITION BY role ORDER BY {S.order_key('tok', 'doc_id')}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
s AS (SELECT role, doc_id, floor(before / (20000.0 * CASE role WHEN 'tracker' THEN 0.7 ELSE 0.3 END / 20)) + 1 AS step FROM b) SELECT role, doc_id, step::BIGINT AS step FROM s WHERE step <= 20""")
def role_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches by tokens over all documents, the tracker against all others."""
    x = documents(spark, d).select(F.when(F.col("source") == "tracker", "tracker").otherwise("other").alias("role"), "doc_id", X.word_count(F.col("text")).alias("t"))
    return sampling.token_batches(x, "role", "doc_id", "t", 20, 20000, {"tracker": 0.7, "other": 0.3}, "tok")


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, n, floor((row_number() OVER (ORDER BY n, {S.order_key('len', 'doc_id')}, doc_id) - 1) / 32)::BIGINT AS b FROM l),
o AS (SELECT b, row_number() OVER (ORDER BY {S.order_key('len', 'b')}, b) - 1 AS batch FROM (SELECT DISTINCT b FROM r)), i AS (SELECT batch, doc_id, n, row_number() OVER (PARTITION BY batch ORDER BY n, doc_id) AS i FROM r JOIN o USING (b)),
s(batch, doc_id, i, chunk, k) AS (SELECT batch, doc_id, i, 0, 1 FROM i WHERE i = 1 UNION ALL SELECT i.batch, i.doc_id, i.i, CASE WHEN (k + 1) * n > 8000 THEN chunk + 1 ELSE chunk END, CASE WHEN (k + 1) * n > 8000 THEN 1 ELSE k + 1 END FROM s JOIN i ON i.batch = s.batch AND i.i = s.i + 1)
SELECT batch, chunk, doc_id FROM s""")
def micro_chunks(spark: SparkSession, d: str) -> DataFrame:
    x = sampling.length_batches(documents(spark, d).where("text is not null").select("doc_id", F.length("text").alias("n")), "n", "doc_id", 32, "len")
    return sampling.micro_chunks(x, "batch", "doc_id", "n", 8000)


@query(f"""WITH RECURSIVE q AS (SELECT qid, list_distinct(list_filter(max(positive_ids), lambda x: x IS NOT NULL)) AS p, row_number() OVER (ORDER BY {S.order_key('bud', 'qid')}, qid) AS i FROM query_spec WHERE qid IS NOT NULL GROUP BY qid HAVING len(max(positive_ids)) > 0),
s(i, qid, have, ok) AS (SELECT 0::BIGINT, NULL::VARCHAR, []::VARCHAR[], false UNION ALL SELECT q.i, q.qid, CASE WHEN len(list_distinct(list_concat(have, p))) <= 200 THEN list_distinct(list_concat(have, p)) ELSE have END, len(list_distinct(list_concat(have, p))) <= 200 FROM s JOIN q ON q.i = s.i + 1)
SELECT qid FROM s WHERE ok""")
def budgeted_subset(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_spec").where("qid is not null").groupBy("qid").agg(F.max("positive_ids").alias("positive_ids"))
    return sampling.budgeted_subset(q, "qid", "positive_ids", 200, "bud")


@query(f"""WITH i AS (SELECT DISTINCT unit_id AS doc_id FROM documents WHERE unit_id IS NOT NULL), p AS (SELECT DISTINCT unnest(positive_ids) AS doc_id FROM query_spec), x AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM p WHERE doc_id IS NOT NULL) AS positive FROM i),
r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN positive THEN 0 ELSE 1 END, {S.order_key('top', 'doc_id')}, doc_id) AS n FROM x) SELECT doc_id, positive FROM r WHERE positive OR n <= 900""")
def topped_up_corpus(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).where("unit_id is not null").select(F.col("unit_id").alias("doc_id"))
    pos = table(spark, d, "query_spec").select(F.explode("positive_ids").alias("doc_id")).where("doc_id is not null").distinct()
    return sampling.topped_up(docs, pos, 900, "top")


@query("SELECT doc_id, unit_id, md5(text) AS text FROM documents WHERE unit_id IN (SELECT unit_id FROM (SELECT DISTINCT unit_id FROM documents WHERE unit_id IS NOT NULL) ORDER BY sha256('two' || chr(31) || unit_id), unit_id LIMIT 50)")
def two_pass_draw(spark: SparkSession, d: str) -> DataFrame:
    return sampling.two_pass_draw(documents(spark, d).select("unit_id", "doc_id", "text"), "unit_id", 50, "two").select("doc_id", "unit_id", F.md5("text").alias("text"))


@query("SELECT kind, doc_id, rn FROM (SELECT kind, doc_id, row_number() OVER (PARTITION BY kind ORDER BY length(text) DESC NULLS LAST, doc_id) AS rn FROM documents) WHERE rn <= 10")
def longest_per_kind(spark: SparkSession, d: str) -> DataFrame:
    x = documents(spark, d).select("kind", "doc_id", F.length("text").alias("n"))
    return sampling.best_first(x, "kind", "n", ["doc_id"], 10).select("kind", "doc_id", "rn")


_TERM = "[A-Za-z0-9][A-Za-z0-9._+#/-]*[A-Za-z0-9+#]|[A-Za-z0-9]"
_STATS = f"""q AS (SELECT text, qid, source_doc, length(text) / 100.0::DOUBLE AS residual, row_number() OVER (PARTITION BY text ORDER BY qid NULLS FIRST, source_doc NULLS FIRST) AS n FROM (SELECT DISTINCT text, qid, source_doc FROM query_spec WHERE text IS NOT NULL)),
t AS (SELECT qid, source_doc, residual, unnest(list_distinct(list_transform(regexp_extract_all(text, '{_TERM}'), lambda x: lower(x)))) AS term FROM q WHERE n = 1),
st AS (SELECT term, count(DISTINCT source_doc) AS docs, count(DISTINCT qid) AS contexts, round(avg(residual), 9) AS residual, round(avg(residual) * ln(1 + count(DISTINCT source_doc)), 9) AS score FROM t WHERE length(term) >= 2 GROUP BY term)"""


def _term_stats(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_spec").where("text is not null").select("text", "qid", "source_doc").distinct()
    w = Window.partitionBy("text").orderBy("qid", "source_doc")
    one = q.withColumn("k", F.row_number().over(w)).where("k = 1").withColumn("residual", F.length("text") / 100.0)
    return vocabulary.discover(one)


@query(f"WITH {_STATS} SELECT term, docs, contexts, round(residual, 6) AS residual, round(score, 6) AS score FROM st")
def term_discovery(spark: SparkSession, d: str) -> DataFrame:
    return _term_stats(spark, d).withColumn("residual", F.round("residual", 6)).withColumn("score", F.round("score", 6))


@query(f"WITH {_STATS} SELECT row_number() OVER (ORDER BY score DESC, docs DESC, term) AS pos, term FROM st ORDER BY pos LIMIT 100")
def term_ranking(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.ranked_terms(_term_stats(spark, d), 100).select("pos", "term")


@query(f"""WITH RECURSIVE {_STATS}, c AS (SELECT *, CASE WHEN regexp_matches(term, '[0-9]') THEN 'numeric' ELSE 'general' END AS domain FROM st), e AS (SELECT *, (term = 'k8s')::INT AS pin FROM c WHERE (docs >= 2 AND contexts >= 2 OR term = 'k8s')
  AND (term = 'k8s' OR docs >= 4 AND contexts >= 4 OR NOT (length(term) <= 6 AND (regexp_matches(term, '[0-9]') OR NOT regexp_matches(term, '[aeiouy]'))))),
d AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY pin DESC, score DESC, docs DESC, term) AS n FROM e), i AS (SELECT *, row_number() OVER (ORDER BY pin DESC, score DESC, docs DESC, term) AS i FROM d WHERE n <= 80),
s(i, term, domain, pin, g, m, took) AS (SELECT 0::BIGINT, '', '', 0, 0, 0, false UNION ALL SELECT i.i, i.term, i.domain, i.pin, g + (i.domain = 'general' AND g < 40 AND g + m < 60)::INT, m + (i.domain = 'numeric' AND m < 40 AND g + m < 60)::INT, g + m < 60 AND CASE i.domain WHEN 'general' THEN g < 40 ELSE m < 40 END FROM s JOIN i ON i.i = s.i + 1)
SELECT (row_number() OVER (ORDER BY i))::INT AS pos, term, domain, CASE pin WHEN 1 THEN 'pinned' ELSE 'ranked' END AS reason FROM s WHERE took""")
def vocabulary_selection(spark: SparkSession, d: str) -> DataFrame:
    s = _term_stats(spark, d).withColumn("domain", F.when(F.col("term").rlike("[0-9]"), "numeric").otherwise("general"))
    return vocabulary.select_terms(s, 2, 2, 60, 40, pinned=("k8s",))


@query(f"""WITH t AS (SELECT unnest(['timeout', 'index', 'vector', 'snapshot', 'k8s']) AS term), x AS (SELECT artifact_id, kind, md5(coalesce(title, '') || chr(31) || coalesce(text, '')) AS w, {S.lexical("title")} AS tt, unnest({S.lexical("concat_ws(' ', title, text)")}) AS term FROM documents)
SELECT term, count(*) AS occurrences, count(DISTINCT w) AS witnesses, count(DISTINCT artifact_id) AS artifacts, count(DISTINCT CASE WHEN list_contains(tt, term) THEN artifact_id END) AS titles, count(DISTINCT kind) AS kinds FROM x JOIN t USING (term) GROUP BY term""")
def term_inventory(spark: SparkSession, d: str) -> DataFrame:
    terms = spark.createDataFrame([(t,) for t in ("timeout", "index", "vector", "snapshot", "k8s")], "term string")
    return vocabulary.inventory(documents(spark, d), terms)


@query(f"""WITH q AS (SELECT qid, text, family, delivery FROM query_spec WHERE qid IS NOT NULL), v AS (SELECT delivery > 3 AS c, unnest(['id', 'text', 'signature', 'family']) AS kind, unnest([qid, {S.folded("text")}, array_to_string(list_sort(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9._+#/:-]*'), lambda t: lower(t))), ' '), family]) AS value FROM q WHERE delivery IS NOT NULL),
g AS (SELECT * FROM v WHERE value IS NOT NULL AND value <> '') SELECT 'repeated_' || kind AS problem, value, count(*) AS n FROM g WHERE kind <> 'family' GROUP BY kind, value HAVING count(*) > 1 UNION ALL SELECT 'shared_' || kind, value, 2 FROM g GROUP BY kind, value HAVING count(DISTINCT c) = 2""")
def split_problems(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_spec").select("qid", "text", "family", "delivery").where("qid is not null")
    return vocabulary.split_problems(q.where("delivery <= 3"), q.where("delivery > 3"))


@query("""SELECT 'id' AS rule, count(*) FILTER (WHERE doc_id IS NULL) AS violations FROM documents UNION ALL SELECT 'length', count(*) FILTER (WHERE NOT coalesce(n_chars = length(text), false)) FROM documents
UNION ALL SELECT 'lang', count(*) FILTER (WHERE NOT coalesce(regexp_full_match(lang, '[a-z]{2}'), false)) FROM documents UNION ALL SELECT 'order', count(*) FILTER (WHERE NOT coalesce(updated_at >= created_at, false)) FROM documents""")
def constraint_report(spark: SparkSession, d: str) -> DataFrame:
    rules = {"id": F.col("doc_id").isNotNull(), "length": F.col("n_chars") == F.length("text"), "lang": F.col("lang").rlike("^[a-z]{2}$"), "order": F.col("updated_at") >= F.col("created_at")}
    return integrity.constraint_report(documents(spark, d), rules)


@query("SELECT unit_id, count(*) AS n FROM documents GROUP BY unit_id HAVING count(*) > 1")
def duplicate_units(spark: SparkSession, d: str) -> DataFrame:
    return integrity.duplicate_keys(documents(spark, d), ["unit_id"])


@query("""WITH w AS (SELECT unit_id, md5(string_agg(coalesce(text, ''), '|' ORDER BY doc_id)) AS h FROM documents WHERE kind <> 'chat_line' GROUP BY 1), s AS (SELECT unit_id, md5(string_agg(coalesce(text, ''), '|' ORDER BY doc_id)) AS h FROM documents WHERE kind <> 'release_note' AND ingested_at < TIMESTAMPTZ '2025-06-01 00:00:00+00' GROUP BY 1)
SELECT unit_id, CASE WHEN s.h IS NULL THEN 'new' WHEN w.h IS NULL THEN 'gone' WHEN s.h = w.h THEN 'same' ELSE 'changed' END AS status FROM s FULL JOIN w USING (unit_id)""")
def log_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    def digest(df: DataFrame) -> DataFrame:
        parts = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x.t)  # deliveries of one unit
        return df.groupBy("unit_id").agg(F.md5(F.array_join(parts, "|")).alias("content_sha"))

    docs = documents(spark, d)
    stored = docs.where((F.col("kind") != "release_note") & (F.col("ingested_at") < F.lit("2025-06-01 00:00:00").cast("timestamp")))
    return integrity.reconcile(digest(stored), digest(docs.where("kind <> 'chat_line'")), "unit_id")


@query("SELECT DISTINCT q.p AS doc_id FROM (SELECT unnest(positive_ids) AS p FROM query_spec) q WHERE p IS NOT NULL AND p NOT IN (SELECT doc_id FROM bank WHERE doc_id IS NOT NULL)")
def encode_backlog(spark: SparkSession, d: str) -> DataFrame:
    want = table(spark, d, "query_spec").select(F.explode("positive_ids").alias("doc_id"))
    return integrity.missing_rows(want, table(spark, d, "bank").where("doc_id is not null").select("doc_id").distinct(), "doc_id")


@query("SELECT kind AS subject, count(*) AS looks, count(DISTINCT source) AS arms FROM documents GROUP BY kind")
def access_counts(spark: SparkSession, d: str) -> DataFrame:
    return integrity.access_counts(documents(spark, d).select(F.col("kind").alias("subject"), F.col("source").alias("arm")), "subject")


@query("""WITH b AS (SELECT phase AS arm, unnest(['batch', 'general_views']) AS key, unnest([max(batch)::VARCHAR, max(general_views)::VARCHAR]) AS value FROM run_cfg WHERE phase IS NOT NULL GROUP BY phase), f AS (SELECT key, value AS base_value FROM b WHERE arm = 'final')
SELECT arm, key, value, base_value FROM b JOIN f USING (key) WHERE arm <> 'final' AND value IS DISTINCT FROM base_value""")
def config_differences(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "run_cfg").where("phase is not null").groupBy(F.col("phase").alias("arm")).agg(F.max("batch").cast("string").alias("batch"), F.max("general_views").cast("string").alias("general_views"))
    long = g.select("arm", F.explode(F.create_map(F.lit("batch"), "batch", F.lit("general_views"), "general_views")).alias("key", "value"))
    return integrity.config_differences(stage(long, "arms"), "final")


@query("WITH s AS (SELECT DISTINCT source AS store, unit_id AS doc_id FROM documents WHERE source IS NOT NULL) SELECT store, doc_id, row_number() OVER (ORDER BY store, md5(doc_id), doc_id) - 1 AS row_id FROM s")
def row_index(spark: SparkSession, d: str) -> DataFrame:
    return readers.row_index(documents(spark, d).where("source is not null").select(F.col("source").alias("store"), F.col("unit_id").alias("doc_id")))


@query(f"WITH {_KNN} SELECT qid, doc_id, score, rank FROM r WHERE rank <= 10")
def run_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A run saved, its manifest checked and read back."""
    root = scratch(spark, "runs")
    m = sinks.save_run(_vector_run(spark, d, 10), root, "knn", "labels").first()
    return sinks.load_run(spark, f"{root}/dataset=labels/system=knn", m.digest, 10)


@query()
def table_identities(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t in ("documents", "query_spec", "term_stat"):
        x = sinks.table_identity(table(spark, d, t)).withColumn("table", F.lit(t))
        out = x if out is None else out.union(x)
    return out


def _streamed(spark: SparkSession, d: str, name: str, make) -> DataFrame:
    """Run a stream over what is at hand and read what it wrote."""
    schema = table(spark, d, name).schema
    root = scratch(spark, "stream")
    src = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d) if not _is_folder(spark, f"{d}/{name}.parquet") else ingest.append_log(spark, f"{d}/{name}.parquet", schema)
    q = make(src).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(make(table(spark, d, name)).schema).parquet(f"{root}/out")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("SELECT DISTINCT unit_id FROM documents WHERE ingested_at IS NOT NULL AND unit_id IS NOT NULL")
def stream_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """One row of each unit from the ingestion log, as a stream."""
    return _streamed(spark, d, "documents", lambda s: ingest.first_wins(s.where("ingested_at is not null and unit_id is not null"), "unit_id", "ingested_at", "3650 days").select("unit_id"))


@query("SELECT doc_id, created_at FROM documents WHERE created_at <= TIMESTAMPTZ '2025-06-01 00:00:00+00'")
def stream_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d, "documents", lambda s: ingest.admitted(s, "created_at", "2025-06-01 00:00:00").select("doc_id", "created_at"))


@query("""WITH e AS (SELECT user_id::VARCHAR AS job, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS after, max(ts) OVER () AS last FROM events)
SELECT job, 'up' AS status, ts AS at FROM e WHERE before IS NULL OR ts - before > INTERVAL 6 HOUR UNION ALL SELECT job, 'silent', ts + INTERVAL 6 HOUR FROM e WHERE after - ts > INTERVAL 6 HOUR OR after IS NULL AND last - ts > INTERVAL 6 HOUR""")
def heartbeats(spark: SparkSession, d: str) -> DataFrame:
    """Users as jobs that are to be heard of every six hours, as a stream with state."""
    return _streamed(spark, d, "events", lambda s: ingest.heartbeat_monitor(s, "user_id", "ts", 6 * 3600)).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    x = ingest.tumbling(table(spark, d, "events"), "ts", "1 day", "event_type", "value")
    return x.withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM k GROUP BY user_id, k""")
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sessions(table(spark, d, "events"), "ts", "6 hours", "user_id")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02 00:00:00").cast("timestamp"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)""")
def sales_rollup(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.rollup("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
