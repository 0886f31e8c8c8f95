"""Queries on roll-ups, paired statistics and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import aggregates, decisions, metrics, stats
from millrace.session import stage, table

from . import sql as S
from .registry import query
from .retrieval import _scores, documents, scores_sql


@query("""WITH u AS (SELECT n_nationkey AS unit, n_regionkey AS family FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)), m AS (SELECT s_nationkey AS unit, avg(s_acctbal) AS m FROM supplier GROUP BY 1),
f AS (SELECT family, avg(m) AS f FROM m JOIN u USING (unit) GROUP BY family) SELECT round(avg(f), 6) AS macro, count(*) AS families FROM f""")
def family_macro(spark: SparkSession, d: str) -> DataFrame:
    sup = table(spark, d, "supplier").select(F.col("s_nationkey").alias("unit"), F.col("s_acctbal").alias("value"))
    units = table(spark, d, "nation").select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("family")).join(sup.select("unit").distinct(), "unit", "left_semi")
    return metrics.family_macro(sup, units, "value", 6)


@query(f"WITH {scores_sql('dense', 's')}, t AS (SELECT domain, avg(ndcg) AS ndcg FROM s GROUP BY domain) SELECT 'ndcg' AS metric, round(avg(ndcg), 9) AS macro, count(*) AS terms FROM t")
def term_rollup(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.term_rollup(_scores(spark, d, "dense"), ["ndcg"], "domain")


@query("WITH v AS (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q) SELECT q::DOUBLE AS q, round((SELECT quantile_cont(o_totalprice, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) FROM orders)[row_number() OVER (ORDER BY q)], 6) AS value FROM v")
def price_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.quantiles(table(spark, d, "orders"), "o_totalprice").withColumn("value", F.round("value", 6))


@query("""WITH n AS (SELECT score, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS n FROM scored_point WHERE isfinite(score))
SELECT max(score) FILTER (WHERE i = greatest(1, ceil(n * 0.975))) AS value, max(score) FILTER (WHERE i = greatest(1, ceil(n * 0.975) - 1)) AS previous FROM n""")
def score_order_statistic(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scored_point").where("score is not null and not isnan(score) and abs(score) < double('infinity')")
    return aggregates.order_statistic(s, "score", 0.975)


@query("SELECT lower(trim(lang)) AS lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM documents GROUP BY 1")
def language_tally(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.tally(documents(spark, d), F.lower(F.trim("lang")), "lang")


_PAIRS = f"{scores_sql('dense', 'sa')}, {scores_sql('lexical', 'sb')}, p AS (SELECT sa.domain, sa.qid, sa.ndcg AS a, sb.ndcg AS b FROM sa JOIN sb USING (qid))"


def paired_scores(spark: SparkSession, d: str) -> DataFrame:
    """(domain, qid, a, b): nDCG of two systems for the same queries."""
    keys = ["domain", "qid"]
    a, b = (_scores(spark, d, s).select(*keys, F.col("ndcg").alias("value")) for s in ("dense", "lexical"))
    return stage(stats.align(a, b, keys), "pairs")


@query(f"WITH {_PAIRS} SELECT count(*) FILTER (WHERE a > b) AS wins, count(*) FILTER (WHERE a = b) AS ties, count(*) FILTER (WHERE a < b) AS losses, round(avg(a - b), 9) AS mean, round(median(a - b), 9) AS median, round(min(a - b), 9) AS least, round(max(a - b), 9) AS greatest FROM p")
def win_tie_loss(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.win_tie_loss(paired_scores(spark, d), "a", "b")


_UNITS = f"""{_PAIRS}, k AS (SELECT domain, a - b AS d, row_number() OVER (PARTITION BY domain ORDER BY md5(qid), qid) - 1 AS k FROM p), sz AS (SELECT domain, count(*) AS n FROM k GROUP BY domain)"""


@query(f"""WITH {_UNITS}, dr AS ({S.picks("sz", stats.BOOTSTRAP, "b", "domain")}), m AS (SELECT rep, dr.domain, avg(d) AS m FROM dr JOIN k ON k.domain = dr.domain AND k.k = dr.k GROUP BY rep, dr.domain),
de AS (SELECT rep, round(avg(m), 12) AS delta FROM m GROUP BY rep), ob AS (SELECT avg(m) AS o FROM (SELECT avg(a - b) AS m FROM p GROUP BY domain))
SELECT round(o, 6) AS delta, round(quantile_cont(delta, 0.025), 6) AS ci_low, round(quantile_cont(delta, 0.975), 6) AS ci_high, round(avg((delta <= 0)::INT), 6) AS tail FROM de, ob GROUP BY o""")
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    x = stats.paired_bootstrap(paired_scores(spark, d), "domain", "qid", stats.BOOTSTRAP, "b")
    return x.select(*[F.round(c, 6).alias(c) for c in ("delta", "ci_low", "ci_high", "tail")])


@query(f"""WITH {_PAIRS}, u AS (SELECT {S.half32("md5(domain || '|' || qid)", 1)} AS a, {S.half32("md5(domain || '|' || qid)", 9)} AS b, (a - b) / (count(*) OVER (PARTITION BY domain) * (SELECT count(DISTINCT domain) FROM p)) AS x FROM p),
bl AS (SELECT block, {S.half32("h", 1)} AS one, {S.half32("h", 9)} AS two FROM (SELECT block, md5('s|' || block) AS h FROM (SELECT unnest(range(0, {-(-stats.FLIPS // 32)})) AS block))),
h AS ({S.mixed32(f"SELECT block, w, xor(xor(h, b), two) AS h FROM ({S.mixed32('SELECT block, x AS w, b, two, xor(a, one) AS h FROM u, bl', 'h')})", "h")}),
t AS (SELECT block * 32 + i AS rep, round(s, 12) AS t FROM (SELECT block, unnest(range(0, 32)) AS i, unnest([{", ".join(f"sum(w * (1 - 2 * ((h >> {i}) & 1)::INT))" for i in range(32))}]) AS s FROM h GROUP BY block) WHERE block * 32 + i < {stats.FLIPS}),
o AS (SELECT round(avg(m), 12) AS o FROM (SELECT avg(a - b) AS m FROM p GROUP BY domain))
SELECT round(o, 6) AS delta, round((1 + count(*) FILTER (WHERE abs(t) >= abs(o))) / (1 + count(*)), 6) AS p FROM t, o GROUP BY o""")
def sign_flip(spark: SparkSession, d: str) -> DataFrame:
    x = stats.sign_flip(paired_scores(spark, d), "domain", "qid", stats.FLIPS, "s")
    return x.select(F.round("delta", 6).alias("delta"), F.round("p", 6).alias("p"))


@query(f"""WITH {_PAIRS}, sg AS (SELECT qid, string_agg(DISTINCT domain, '+' ORDER BY domain) AS sig FROM p GROUP BY qid), un AS (SELECT sig, qid, row_number() OVER (PARTITION BY sig ORDER BY md5(qid), qid) - 1 AS k FROM sg), sz AS (SELECT sig, count(*) AS n FROM un GROUP BY sig),
dr AS ({S.picks("sz", stats.BOOTSTRAP, "d", "sig")}), m AS (SELECT rep, p.domain, avg(a - b) AS m FROM dr JOIN un ON un.sig = dr.sig AND un.k = dr.k JOIN p ON p.qid = un.qid GROUP BY rep, p.domain)
SELECT rep, round(round(avg(m), 12), 9) AS delta FROM m GROUP BY rep""")
def shared_unit_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return stats.shared_bootstrap(paired_scores(spark, d), "domain", "qid", stats.BOOTSTRAP).withColumn("delta", F.round("delta", 9))


@query(f"""WITH {_PAIRS}, fa AS (SELECT domain, coalesce(s.source, '') AS source, sum(a - b) AS s, count(*) AS c FROM p JOIN (SELECT qid, min(source) AS source FROM query_spec GROUP BY qid) s USING (qid) GROUP BY 1, 2),
un AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY md5(source), source) - 1 AS k FROM fa), sz AS (SELECT domain, count(*) AS n FROM un GROUP BY domain),
dr AS ({S.picks("sz", stats.BOOTSTRAP, "f", "domain")}), m AS (SELECT rep, dr.domain, sum(s) / sum(c) AS m FROM dr JOIN un ON un.domain = dr.domain AND un.k = dr.k GROUP BY rep, dr.domain)
SELECT rep, round(round(avg(m), 12), 9) AS delta FROM m GROUP BY rep""")
def family_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    fam = table(spark, d, "query_spec").groupBy("qid").agg(F.min("source").alias("source"))
    p = paired_scores(spark, d).join(fam, "qid").withColumn("source", F.coalesce("source", F.lit("")))
    return stats.family_bootstrap(p, "domain", "source", stats.BOOTSTRAP).withColumn("delta", F.round("delta", 9))


@query()
def weighted_contrast(spark: SparkSession, d: str) -> DataFrame:
    p = paired_scores(spark, d).withColumnRenamed("domain", "unit")
    units = p.select("unit").distinct().withColumn("family", F.when(F.col("unit") < "m", "first").otherwise("second"))
    return stats.weighted_contrast(p, units, stats.CONTRAST)


@query(f"WITH {_PAIRS}, g AS (SELECT domain, var_samp(a - b) / count(*) AS v FROM p GROUP BY domain) SELECT round(sqrt(sum(v)) / count(*), 9) AS se, round(sqrt(sum(v)) / count(*) * (1.959963985 + 0.841621234), 9) AS mde FROM g")
def macro_se(spark: SparkSession, d: str) -> DataFrame:
    return stats.macro_se(paired_scores(spark, d), "domain")


_TESTS = f"""WITH {_PAIRS}, t AS (SELECT domain AS test, round(2 * (1 - least(1.0, abs(avg(a - b)) / (2 * (stddev_samp(a - b) / sqrt(count(*)) + 1e-9)))), 9) AS p0, round(avg(a - b) - stddev_samp(a - b) / sqrt(count(*)), 9) AS lower FROM p GROUP BY domain), tt AS (SELECT test, least(1.0, greatest(0.0, p0 / 20)) AS p, lower FROM t)"""


def _tests(spark: SparkSession, d: str) -> DataFrame:
    diff = F.col("a") - F.col("b")
    se = F.stddev_samp(diff) / F.sqrt(F.count(F.lit(1)))
    t = paired_scores(spark, d).groupBy(F.col("domain").alias("test")).agg(F.round(2 * (1 - F.least(F.lit(1.0), F.abs(F.avg(diff)) / (2 * (se + 1e-9)))), 9).alias("p0"), F.round(F.avg(diff) - se, 9).alias("lower"))
    return t.select("test", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p0") / 20)).alias("p"), "lower")


@query(f"""{_TESTS}, i AS (SELECT test, p, 0.05 / (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1) AS th, row_number() OVER (ORDER BY p, test) AS i FROM tt)
SELECT test, round(p, 6) AS p, round(th, 9) AS threshold, min((p <= th)::INT) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS rejected FROM i""")
def holm(spark: SparkSession, d: str) -> DataFrame:
    return stats.holm(_tests(spark, d)).withColumn("p", F.round("p", 6))


@query(f"""{_TESTS}, o AS (SELECT row_number() OVER (ORDER BY test) AS pos, test, lower, p, (lower > 0 AND p <= 0.05) AS ok FROM tt), b AS (SELECT *, coalesce(min(ok::INT) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before FROM o)
SELECT pos, test, CASE WHEN before = 0 THEN 'NOT_TESTED' WHEN lower IS NULL OR p IS NULL THEN 'UNSCORABLE' WHEN ok THEN 'REJECTED' ELSE 'NOT_REJECTED' END AS verdict FROM b""")
def gatekeeping(spark: SparkSession, d: str) -> DataFrame:
    t = _tests(spark, d)
    pos = t.select("test").alias("x").join(t.select(F.col("test").alias("u")), F.col("u") <= F.col("test")).groupBy("test").agg(F.count(F.lit(1)).alias("pos"))
    return decisions.gatekeeping(t.join(pos, "test"))


@query("""WITH c AS (SELECT n_regionkey AS r, c_mktsegment AS s, round(avg(c_acctbal), 6) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), g AS (SELECT avg(v) AS g, count(DISTINCT r) AS nr, count(DISTINCT s) AS ns FROM c),
a AS (SELECT c.*, avg(v) OVER (PARTITION BY r) AS ra, avg(v) OVER (PARTITION BY s) AS sa, g, nr, ns FROM c, g),
m AS (SELECT sum((ra - g) * (ra - g)) / (max(nr) - 1) AS msr, sum((sa - g) * (sa - g)) / (max(ns) - 1) AS msc, sum((v - ra - sa + g) * (v - ra - sa + g)) / ((max(nr) - 1) * (max(ns) - 1)) AS mse, max(nr) AS nr, max(ns) AS ns FROM a)
SELECT round(greatest(0, (msr - mse) / ns), 3) AS var_row, round(greatest(0, (msc - mse) / nr), 3) AS var_col, round(greatest(0, mse), 3) AS var_resid FROM m""")
def two_way_variance(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cells = c.groupBy("n_regionkey", "c_mktsegment").agg(F.round(F.avg("c_acctbal"), 6).alias("v"))
    x = aggregates.two_way_variance(cells, "n_regionkey", "c_mktsegment", "v")
    return x.select(*[F.round(k, 3).alias(k) for k in x.columns])


@query("""WITH g AS (SELECT l_returnflag, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy FROM lineitem GROUP BY 1)
SELECT l_returnflag, n, round(b, 4) AS slope, round(a, 2) AS intercept, round(sqrt((syy - b * b * sxx) / (n - 2) / sxx), 4) AS se FROM g""")
def price_regression(spark: SparkSession, d: str) -> DataFrame:
    x = aggregates.ols(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return x.select("l_returnflag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("se", 4).alias("se"))


@query("""WITH m AS (SELECT month(o_orderdate)::DOUBLE AS x, avg(o_totalprice) AS y FROM orders GROUP BY 1), g AS (SELECT (unnest(range(1, 21)) / 10)::DOUBLE AS exponent), u AS (SELECT exponent, pow(x, -exponent) AS u, y FROM m, g),
f AS (SELECT exponent, regr_intercept(y, u) AS a, regr_slope(y, u) AS b, round(regr_syy(y, u) - regr_slope(y, u) * regr_slope(y, u) * regr_sxx(y, u), 9) AS sse FROM u GROUP BY exponent) SELECT exponent, round(a, 6) AS a, round(b, 6) AS b, round(sse, 6) AS sse FROM f ORDER BY f.sse, exponent LIMIT 1""")
def learning_curve(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").groupBy(F.month("o_orderdate").alias("m")).agg(F.avg("o_totalprice").alias("y"))
    return aggregates.power_fit(x, "m", "y")


@query("""WITH g AS (SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, avg(l_quantity) AS mx FROM lineitem),
h AS (SELECT a + b * 60 AS p, 2.0 * sqrt((syy - b * b * sxx) / (n - 2)) * sqrt(1 + 1 / n + (60 - mx) * (60 - mx) / sxx) AS h FROM g) SELECT round(p, 2) AS predicted, round(p - h, 2) AS low, round(p + h, 2) AS high FROM h""")
def price_prediction(spark: SparkSession, d: str) -> DataFrame:
    x = stats.prediction_interval(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", 60.0)
    return x.select(*[F.round(c, 2).alias(c) for c in x.columns])


@query("""WITH c AS (SELECT artifact_id, lower(trim(lang)) AS lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2), t AS (SELECT artifact_id, max(n) AS top, sum(n) AS total FROM c GROUP BY 1),
w AS (SELECT c.artifact_id, count(*) AS k, min(lang) AS l, max(top) AS top, max(total) AS total FROM c JOIN t ON t.artifact_id IS NOT DISTINCT FROM c.artifact_id AND n = top GROUP BY 1)
SELECT d.artifact_id, coalesce(CASE WHEN k = 1 AND top * 2 > total THEN l ELSE 'general' END, 'general') AS lang FROM (SELECT DISTINCT artifact_id FROM documents WHERE artifact_id IS NOT NULL) d LEFT JOIN w USING (artifact_id)""")
def majority_language(spark: SparkSession, d: str) -> DataFrame:
    x = documents(spark, d).where("artifact_id is not null").select("artifact_id", F.lower(F.trim("lang")).alias("lang"))
    return aggregates.majority(x, "artifact_id", "lang")


@query(f"""WITH w AS (SELECT {S.words("text")} AS w FROM documents), o AS (SELECT array_to_string(list_slice(w, 1, 4), ' ') AS o, count(*) AS n FROM w WHERE len(w) > 0 GROUP BY 1), t AS (SELECT sum(n) AS s FROM (SELECT n FROM o ORDER BY n DESC, o LIMIT 10)),
b AS (SELECT unnest({S.kgrams("w", 2)}) AS b FROM w) SELECT (SELECT sum(n)::BIGINT FROM o) AS texts, round((SELECT s FROM t) / (SELECT sum(n) FROM o), 9) AS top_share, round(count(DISTINCT b) / count(*), 9) AS distinct_2 FROM b""")
def opener_concentration(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.opener_concentration(documents(spark, d), X.fingerprint_words(F.col("text")))


@query("""SELECT source AS endpoint, count(*) AS raw, count(*) FILTER (WHERE created_at <= TIMESTAMP '2025-06-01') AS included, count(*) FILTER (WHERE created_at > TIMESTAMP '2025-06-01') AS after_cutoff,
count(*) FILTER (WHERE created_at <= TIMESTAMP '2025-06-01' AND updated_at > TIMESTAMP '2025-06-01') AS updated_after, count(DISTINCT unit_id) FILTER (WHERE created_at <= TIMESTAMP '2025-06-01') AS unique_ids,
count(*) FILTER (WHERE created_at <= TIMESTAMP '2025-06-01') - count(DISTINCT unit_id) FILTER (WHERE created_at <= TIMESTAMP '2025-06-01') AS duplicates FROM documents GROUP BY source""".replace("TIMESTAMP '", "TIMESTAMPTZ '").replace("06-01'", "06-01 00:00:00+00'"))
def cutoff_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.cutoff_counts(documents(spark, d), "source", "unit_id", "created_at", "updated_at", "2025-06-01 00:00:00")


@query("""WITH q AS (SELECT lower(trim(domain)) AS domain, count(DISTINCT qid) AS queries FROM query_spec WHERE domain IS NOT NULL GROUP BY 1), k AS (SELECT kind AS domain, count(*) AS docs FROM documents GROUP BY 1), d AS (SELECT domain FROM q UNION SELECT domain FROM k UNION SELECT 'none')
SELECT domain, coalesce(docs, 0) AS docs, coalesce(queries, 0)::BIGINT AS queries, coalesce(docs, 0) + coalesce(queries, 0) = 0 AS gap FROM d LEFT JOIN k USING (domain) LEFT JOIN q USING (domain)""")
def domain_rollup(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select(F.col("kind").alias("domain"))
    q = table(spark, d, "query_spec").where("domain is not null").groupBy(F.lower(F.trim("domain")).alias("domain")).agg(F.count_distinct("qid").alias("queries"))
    domains = docs.union(q.select("domain")).distinct().union(spark.createDataFrame([("none",)], "domain string"))
    return aggregates.domain_rollup(docs, q, domains)


@query("""WITH dr AS (SELECT source AS stream, unit_id AS key FROM documents WHERE length(text) < 40), f AS (SELECT key, min(stream) AS stream FROM dr GROUP BY key)
SELECT s.stream, s.streamed, coalesce(d.dropped, 0) AS dropped, coalesce(n.new_drops, 0) AS new_drops FROM (SELECT source AS stream, count(*) AS streamed FROM documents WHERE source IS NOT NULL GROUP BY 1) s
LEFT JOIN (SELECT stream, count(DISTINCT key) AS dropped FROM dr GROUP BY 1) d USING (stream) LEFT JOIN (SELECT stream, count(*) AS new_drops FROM f GROUP BY 1) n USING (stream)""")
def stream_screen(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select(F.col("source").alias("stream"), F.col("unit_id").alias("key"), "text")
    return aggregates.stream_counts(docs.where("stream is not null"), docs.where("length(text) < 40"))


@query(f"""WITH {scores_sql('dense', 'sa')}, {scores_sql('lexical', 'sb')}, a AS (SELECT domain, avg(ndcg) AS s FROM sa GROUP BY 1), b AS (SELECT domain, avg(ndcg) AS t FROM sb GROUP BY 1)
SELECT 'all' AS "group", round(CASE WHEN count(*) FILTER (WHERE s IS NULL OR t IS NULL) = 0 AND avg(t) <> 0 THEN avg(s) / avg(t) END, 9) AS retention FROM a FULL JOIN b USING (domain)""")
def retention(spark: SparkSession, d: str) -> DataFrame:
    parts = None
    for s in ("dense", "lexical"):
        x = _scores(spark, d, s).select(F.lit(s).alias("system"), F.col("domain").alias("component"), F.col("ndcg").alias("value"))
        parts = x if parts is None else parts.union(x)
    parts = stage(parts, "scores")
    return metrics.retention(parts, "dense", "lexical", parts.select(F.lit("all").alias("group"), "component").distinct())


@query(f"""WITH {scores_sql('dense', 'sa')}, {scores_sql('lexical', 'sb')}, a AS (SELECT domain AS component, avg(ndcg) AS x FROM sa GROUP BY 1), b AS (SELECT domain AS component, avg(ndcg) AS y FROM sb GROUP BY 1)
SELECT component, round(x - y, 9) AS delta, x - y >= -0.01 AS ok FROM a JOIN b USING (component)""")
def no_regression(spark: SparkSession, d: str) -> DataFrame:
    a, b = (_scores(spark, d, s).select(F.col("domain").alias("component"), F.col("ndcg").alias("value")) for s in ("dense", "lexical"))
    return decisions.no_regression(a, b, 0.01)
