"""Queries on texts: functions, extraction, duplicates, decontamination, families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import hashing as H
from millrace.functions import text as X
from millrace.operators import decontam, dedup, graph, harvest, joins, vocabulary
from millrace.session import stage, table

from . import sql as S
from .registry import query
from .retrieval import documents

#: Word ranges of the forms that titles and headings are routed to.
RANGES = {"keyword": (2, 5), "title": (6, 12)}
KEYWORDS = {
    "storage": {"segment": 2, "snapshot": 2, "payload": 2, "disk": 1, "wal": 1, "replica": 1},
    "search": {"query": 1, "index": 1, "scorer": 2, "filter": 2, "vector": 1, "beam": 2},
    "operations": {"restart": 2, "deploy": 2, "timeout": 2, "error": 1, "log": 1, "cluster": 1},
}

#: Records that may share a positive before it ties none of them, as in the engine being matched.
HUB = 50


def items(spark: SparkSession, d: str, role: str | None = None) -> DataFrame:
    x = table(spark, d, "eval_item")
    return x if role is None else x.where(F.col("role") == role)


@query(f"WITH w AS (SELECT doc_id, {S.words('text')} AS w FROM documents) SELECT doc_id, len(w) AS n_words, {S.key60(chr(39) + chr(39) + ' || array_to_string(w, ' + chr(39) + ' ' + chr(39) + ')')} AS text_key FROM w")
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    w = X.fingerprint_words(F.col("text"))
    return documents(spark, d).select("doc_id", F.size(w).alias("n_words"), H.text_key(w).alias("text_key"))


@query(f"SELECT doc_id, len({S.lexical('text')}) AS tokens, array_to_string(list_sort(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9._+#/:-]*'), lambda t: lower(t))), ' ') AS signature FROM documents")
def lexical_signatures(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.size(X.lexical_tokens(F.col("text"))).alias("tokens"), X.lexical_signature(F.col("text")).alias("signature"))


@query()
def normalized_groups(spark: SparkSession, d: str) -> DataFrame:
    n = documents(spark, d).where("text is not null").select("doc_id", X.nfkc_casefold("text").alias("n"))
    return n.groupBy(X.group_id(F.col("n")).alias("group_id")).agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"))


@query(f"SELECT doc_id, len(s)::INT AS sentences, len(list_filter(s, lambda x: {S.is_claim('x')}))::INT AS claims FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents)")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    s = X.sentences(F.col("text"))
    return documents(spark, d).select("doc_id", F.coalesce(F.size(s), F.lit(0)).alias("sentences"), F.coalesce(F.size(F.filter(s, X.is_claim)), F.lit(0)).alias("claims"))


_RED = "SELECT doc_id, {}, md5(t5) AS redacted FROM (" + "SELECT *, regexp_replace(t4, '(?i)\\b(password|passwd|secret|api[_-]?key|token)\\s*[:=]\\s*[''\"]?[^\\s''\"]{{8,}}', '<REDACTED_ASSIGNED_SECRET>', 'g') AS t5 FROM (SELECT *, regexp_replace(t3, '(?i)\\bBearer\\s+[A-Za-z0-9._~+/=-]{{16,}}', '<REDACTED_BEARER>', 'g') AS t4 FROM (SELECT *, regexp_replace(t2, '\\bAKIA[0-9A-Z]{{16}}\\b', '<REDACTED_AWS_KEY>', 'g') AS t3 FROM (SELECT *, regexp_replace(t1, '\\b(?:gh[pousr]_[A-Za-z0-9]{{20,}}|github_pat_[A-Za-z0-9_]{{20,}})\\b', '<REDACTED_GITHUB_TOKEN>', 'g') AS t2 FROM (SELECT doc_id, text, regexp_replace(text, '(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----', '<REDACTED_PRIVATE_KEY>', 'g') AS t1 FROM documents)))))"
_RED = _RED.format("len(regexp_extract_all(t3, '(?i)\\bBearer\\s+[A-Za-z0-9._~+/=-]{{16,}}')) AS bearer, len(regexp_extract_all(t4, '(?i)\\b(password|passwd|secret|api[_-]?key|token)\\s*[:=]\\s*[''\"]?[^\\s''\"]{{8,}}')) AS assigned_secret").replace("{{", "{").replace("}}", "}")


_RED_TEXT = "SELECT doc_id, author, t5 FROM (" + _RED[_RED.index("FROM (") + 6 :].replace("SELECT doc_id, text, regexp", "SELECT doc_id, author, text, regexp", 1)


@query(_RED)
def redaction(spark: SparkSession, d: str) -> DataFrame:
    x = documents(spark, d).select("doc_id", X.redaction_counts(F.col("text")).alias("c"), F.md5(X.redact(F.col("text"))).alias("redacted"))
    return x.select("doc_id", F.when(F.col("redacted").isNotNull(), F.col("c.bearer")).alias("bearer"), F.when(F.col("redacted").isNotNull(), F.col("c.assigned_secret")).alias("assigned_secret"), "redacted")


@query(r"""WITH l AS (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x, '^[ \t\n\x0B\f\r]*>'))) AS quoted, len(list_filter(l, lambda x: NOT regexp_matches(x, '^[ \t\n\x0B\f\r]*>'))) AS kept FROM l""")
def quoted_lines(spark: SparkSession, d: str) -> DataFrame:
    x = documents(spark, d).where("text is not null")
    return x.select("doc_id", X.quoted_lines(F.col("text")).alias("quoted"), (F.size(X.lines(F.col("text"))) - X.quoted_lines(F.col("text"))).alias("kept"))


@query(rf"""WITH r AS ({_RED_TEXT}), b AS (SELECT doc_id, CASE WHEN ends_with(author, '[bot]') THEN regexp_replace(regexp_replace(t5, '(?is)<!--.*?-->', '', 'g'), '(?im)^[ \t\n\x0B\f\r]*(?:please fill|checklist|generated by|this is an automated)[^\n\r]*$', '', 'g') ELSE t5 END AS t FROM r),
l AS (SELECT doc_id, array_to_string(list_transform(list_filter(string_split_regex(t, '\r\n|\r|\n'), lambda x: NOT regexp_matches(x, '^[ \t\n\x0B\f\r]*>')), lambda x: regexp_replace(x, '[ \t\n\x0B\f\r]+$', '')), chr(10)) AS b FROM b)
SELECT doc_id, regexp_replace(b, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS body FROM l""")
def clean_bodies(spark: SparkSession, d: str) -> DataFrame:
    bot = F.coalesce(F.col("author").endswith("[bot]"), F.lit(False))
    return documents(spark, d).select("doc_id", X.clean_body(F.col("text"), bot).alias("body"))


@query("""WITH u AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, 'https?://[^\\s)>"''\\]]+'))) AS u FROM documents) SELECT doc_id, array_to_string(u, ' ') AS urls, len(u) AS n FROM u WHERE len(u) > 0""")
def outbound_links(spark: SparkSession, d: str) -> DataFrame:
    x = documents(spark, d).select("doc_id", X.urls(F.col("text")).alias("u")).where("size(u) > 0")
    return x.select("doc_id", F.array_join("u", " ").alias("urls"), F.size("u").alias("n"))


@query()
def placeholder_forms(spark: SparkSession, d: str) -> DataFrame:
    p = X.placeholders(F.col("text"))
    return documents(spark, d).select("doc_id", p.alias("p"), F.col("text")).where("p <> text").select("doc_id", "p")


@query()
def placeholder_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Normalised forms that several distinct texts of several artifacts share."""
    return harvest.placeholder_collisions(documents(spark, d), "text", "artifact_id")


@query(r"""SELECT doc_id, kind || ':' || unit_id AS stable_id, CASE WHEN regexp_matches(artifact_id, '^.+v[0-9]+$') THEN regexp_replace(artifact_id, 'v[0-9]+$', '') ELSE artifact_id END AS base_id,
trim(CASE WHEN trim(coalesce(title, '')) = '' THEN coalesce(text, '') WHEN text IS NULL THEN trim(title) ELSE trim(title) || ' ' || text END) AS titled,
trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '\b(?:v?\d+(?:\.\d+){1,3}|backport|cherry[- ]pick)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), '\s+', ' ', 'g')) AS shape FROM documents""")
def unit_identities(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", X.stable_id(F.col("kind"), F.col("unit_id")).alias("stable_id"), X.strip_version(F.col("artifact_id")).alias("base_id"), X.titled_text(F.col("title"), F.col("text")).alias("titled"), X.title_shape(F.col("title")).alias("shape"))


@query("SELECT doc_id, substr(text, CASE WHEN instr(lower(text), 'timeout') > 0 THEN greatest(1, instr(lower(text), 'timeout') - 40) ELSE 1 END, 80) AS snippet FROM documents WHERE text IS NOT NULL")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("text is not null").select("doc_id", X.snippet(F.col("text"), F.lit("timeout"), 80).alias("snippet"))


@query("SELECT stratum, count(*) AS docs, min(doc_id) AS first_doc FROM (SELECT doc_id, CASE WHEN text IS NULL THEN NULL " + " ".join(f"WHEN regexp_matches(text, '{S.edged(p)}') THEN '{n}'" for n, p in X.STRATA) + " ELSE 'concept_howto' END AS stratum FROM documents) GROUP BY stratum")
def strata(spark: SparkSession, d: str) -> DataFrame:
    x = documents(spark, d).select("doc_id", X.stratum(F.col("text")).alias("stratum"))
    return x.groupBy("stratum").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"))


@query(r"SELECT doc_id, contains(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '`[^`]*`', ' ', 'g'), '?') AS asks FROM documents WHERE text IS NOT NULL")
def prose_questions(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("text is not null").select("doc_id", X.prose_question(F.col("text")).alias("asks"))


@query(f"SELECT doc_id, CASE WHEN n BETWEEN 2 AND 5 THEN 'keyword' WHEN n BETWEEN 6 AND 12 THEN 'title' END AS form, n FROM (SELECT doc_id, len({S.plain_words('title')}) AS n FROM documents WHERE title IS NOT NULL)")
def title_routes(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("title is not null").select("doc_id", X.route_by_length(F.col("title"), RANGES).alias("form"), X.word_count(F.col("title")).alias("n"))


_TOPIC = r"(?i)\b(?:filters?|quer(?:y|ies)|index(?:es)?|vectors?)\b"


@query(f"""WITH w AS (SELECT doc_id, text, array_to_string(list_slice({S.plain_words("text")}, 1, 25), ' ') AS h FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (len(list_distinct(list_transform(regexp_extract_all(text, '{_TOPIC}'), lambda x: lower(x)))) + 2 * len(list_distinct(list_transform(regexp_extract_all(h, '{_TOPIC}'), lambda x: lower(x)))))::INT AS score FROM w""")
def topicality(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("text is not null").select("doc_id", X.topicality(F.col("text"), _TOPIC).alias("score"))


def _keyword_sql() -> str:
    low = r"replace(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')), 'ß', 'ss')"
    score = ", ".join("(" + " + ".join(f"CASE WHEN contains(t, '{w}') THEN {n} ELSE 0 END" for w, n in k.items()) + f") AS {dom}" for dom, k in KEYWORDS.items())
    cases = " ".join(f"WHEN {a} >= 4 AND " + " AND ".join(f"{a} > {b}" for b in KEYWORDS if b != a) + f" THEN '{a}'" for a in KEYWORDS)
    return f"SELECT doc_id, CASE {cases} ELSE 'general' END AS domain FROM (SELECT doc_id, {score} FROM (SELECT doc_id, {low} AS t FROM documents))"


@query(_keyword_sql())
def keyword_domains(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.keyword_domain(documents(spark, d).withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "text", KEYWORDS)


@query(rf"""WITH m AS (SELECT doc_id AS id, unnest(string_split(regexp_replace(chr(10) || regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'), '\n(#{{1,6}}[ \t\n\x0B\f\r]+[^ \t\n\x0B\f\r])', chr(57344) || '\1', 'g'), chr(57344))) AS s, generate_subscripts(string_split(regexp_replace(chr(10) || regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'), '\n(#{{1,6}}[ \t\n\x0B\f\r]+[^ \t\n\x0B\f\r])', chr(57344) || '\1', 'g'), chr(57344)), 1) AS sec FROM documents WHERE text IS NOT NULL),
n AS (SELECT id, sec, regexp_replace(s, '^\n', '') AS s FROM m), w AS (SELECT id, sec, s, {S.plain_words("s")} AS w, CASE WHEN regexp_matches(s, '^#{{1,6}}[ \t\n\x0B\f\r]+[^ \t\n\x0B\f\r]') THEN trim(regexp_replace(string_split_regex(s, '\r\n|\r|\n')[1], '^[# ]+', '')) ELSE '' END AS heading FROM n WHERE regexp_replace(s, '[ \t\n\x0B\f\r]+', '', 'g') <> ''),
c AS (SELECT id, sec, heading, 0 AS a, regexp_replace(s, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS text FROM w WHERE len(w) <= 384 UNION ALL SELECT id, sec, heading, a, array_to_string(list_slice(w, a + 1, a + 384), ' ') FROM (SELECT *, unnest(range(0, greatest(1, len(w) - 48), 336)) AS a FROM w WHERE len(w) > 384))
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY sec, a) - 1)::INT AS chunk, heading, text FROM c""")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    return harvest.chunks(documents(spark, d))


@query(rf"""WITH RECURSIVE p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: len({S.plain_words("x")})), lambda n: n > 0)) AS n, generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda x: len({S.plain_words("x")})), lambda n: n > 0), 1) AS i FROM documents WHERE text IS NOT NULL),
st(doc_id, i, open, e, whole, rest, start) AS (SELECT DISTINCT doc_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM p UNION ALL
  SELECT st.doc_id, p.i, CASE WHEN (st.e + n - st.open) % 60 >= 20 THEN st.e + n ELSE st.e + n - (st.e + n - st.open) % 60 END, st.e + n, (st.e + n - st.open) // 60, (st.e + n - st.open) % 60, st.open FROM st JOIN p ON p.doc_id = st.doc_id AND p.i = st.i + 1),
c AS (SELECT doc_id, start + unnest(range(0, whole)) * 60 AS at, 60 AS n FROM st WHERE whole > 0 UNION ALL SELECT doc_id, start + whole * 60, rest FROM st WHERE rest >= 20), w AS (SELECT doc_id, {S.plain_words("text")} AS w FROM documents)
SELECT doc_id AS id, (row_number() OVER (PARTITION BY doc_id ORDER BY c.at) - 1)::INT AS chunk, array_to_string(list_slice(w, c.at + 1, c.at + n), ' ') AS text FROM c JOIN w USING (doc_id)""")
def packed_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return harvest.packed_paragraphs(documents(spark, d), low=20, high=60)


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) AS line, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, pos, trim(regexp_replace(trim(line), '^//[/!]?', '')) AS body, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS isl FROM l WHERE starts_with(trim(line), '//')),
g AS (SELECT doc_id AS id, min(pos) AS block, string_agg(body, chr(10) ORDER BY pos) AS text, count(*) AS n, length(string_agg(body, ' ' ORDER BY pos)) AS len FROM c GROUP BY doc_id, isl)
SELECT id, block::INT AS block, text FROM g WHERE n >= 2 AND len >= 80""")
def comment_blocks(spark: SparkSession, d: str) -> DataFrame:
    return harvest.comment_blocks(documents(spark, d), "doc_id", "text")


_HEADS = rf"""l AS (SELECT doc_id, regexp_replace(unnest(string_split_regex(text, '\r\n|\r|\n')), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS s, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
x AS (SELECT *, lag(s) OVER w AS b, lead(s) OVER w AS a, max(CASE WHEN s <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
h AS (SELECT doc_id AS id, pos::INT AS pos, s AS heading FROM x WHERE s <> '' AND len({S.plain_words("s")}) <= 12 AND NOT regexp_matches(s, '[.!?"'')\]”’]$') AND NOT contains(s, '. ') AND NOT contains(s, '; ') AND regexp_matches(s, '^[\p{{Lu}}\p{{Nd}}]') AND b = '' AND a = '' AND above = 1
  AND lower(s) NOT IN ('references', 'see also', 'external links', 'notes', 'further reading', 'bibliography', 'sources', 'citations'))"""


@query(f"WITH {_HEADS}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM h) SELECT id, pos, heading FROM n WHERE n <= 12")
def headings(spark: SparkSession, d: str) -> DataFrame:
    return harvest.headings(documents(spark, d))


@query()
def leads(spark: SparkSession, d: str) -> DataFrame:
    x = harvest.lead_and_body(documents(spark, d))
    return x.select("id", harvest.lead_sentence(F.col("lead")).alias("lead_sentence"), F.length("body").alias("body_chars"))


@query(f"""WITH {_HEADS}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM h), s AS (SELECT doc_id, {S.sentences("text")} AS s FROM documents),
f AS (SELECT doc_id, 'title' AS rule, trim(title) AS text, len({S.plain_words("title")}) AS n FROM documents WHERE trim(title) <> '' UNION ALL SELECT id, 'heading', heading, len({S.plain_words("heading")}) FROM n WHERE n <= 12)
SELECT doc_id, rule, CASE WHEN n BETWEEN 2 AND 5 THEN 'keyword' ELSE 'title' END AS form, text FROM f WHERE n BETWEEN 2 AND 12
UNION ALL SELECT doc_id, 'claim', 'claim', unnest(list_slice(list_filter(list_slice(s, 1, 3), lambda x: {S.is_claim("x")}), 1, 1)) FROM s
UNION ALL SELECT doc_id, 'ask', 'question', unnest(list_slice(list_filter(s, lambda x: ends_with(x, '?') AND len({S.plain_words("x")}) BETWEEN 3 AND 40), 1, 3)) FROM s""")
def harvested(spark: SparkSession, d: str) -> DataFrame:
    return harvest.harvest(documents(spark, d), RANGES)


@query(rf"""WITH w AS (SELECT doc_id, title, {S.plain_words("text")} AS w, list_filter(string_split_regex(coalesce(text, ''), '\r\n|\r|\n'), lambda x: starts_with(x, '#')) AS hd, ('0x' || substr(sha256('span' || chr(31) || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
o AS (SELECT *, floor(u * (len(w) - 48))::INT + 24 AS f FROM w),
v AS (SELECT doc_id, 0 AS o, 'title' AS kind, title AS t FROM o UNION ALL SELECT doc_id, 1, 'heading', trim(regexp_replace(hd[1], '^[# ]+', '')) FROM o WHERE len(hd) > 0 UNION ALL SELECT doc_id, 2, 'span_head', array_to_string(list_slice(w, 1, 24), ' ') FROM o UNION ALL SELECT doc_id, 3, 'span_mid', array_to_string(list_slice(w, f + 1, f + 24), ' ') FROM o WHERE len(w) >= 60),
g AS (SELECT doc_id, o, kind, {S.collapsed("t")} AS text FROM v WHERE len({S.plain_words("t")}) >= 3), d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, {S.folded("text")} ORDER BY o) AS k FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS view FROM d WHERE k = 1) SELECT doc_id, view::INT AS view, kind, text FROM r WHERE view < 3""")
def document_views(spark: SparkSession, d: str) -> DataFrame:
    return harvest.document_views(documents(spark, d))


@query()
def definitions(spark: SparkSession, d: str) -> DataFrame:
    return harvest.alias_lexicon(harvest.definitions(documents(spark, d)))


@query()
def alias_carriers(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return harvest.carrier_pairs(docs, harvest.alias_lexicon(harvest.definitions(docs)))


@query(f"""WITH s AS (SELECT doc_id, {S.sentences("text")} AS s, {S.key60("'pseudo|' || doc_id")} AS h FROM documents), k AS (SELECT doc_id, s[1] AS f, {S.plain_words("array_to_string(list_slice(s, (h % len(s)) + 1, len(s)), ' ')")} AS w, CASE WHEN (h >> 20) % 2 = 0 THEN 'short' ELSE 'long' END AS kind FROM s WHERE len(s) > 0)
SELECT doc_id AS id, kind, CASE kind WHEN 'short' THEN f ELSE array_to_string(list_slice(w, 1, 320), ' ') END AS text FROM k WHERE CASE kind WHEN 'short' THEN len({S.plain_words("f")}) BETWEEN 4 AND 32 ELSE len(w) >= 64 END""")
def pseudo_queries(spark: SparkSession, d: str) -> DataFrame:
    return harvest.pseudo_queries(documents(spark, d), "pseudo")


@query(rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(57344), 'g'), chr(57344)), lambda x: x), lambda x: x <> '') AS s FROM documents), w AS (SELECT doc_id, {S.plain_words("s[1]")} AS w FROM s)
SELECT doc_id, CASE WHEN len(w) >= 4 THEN array_to_string(list_slice(w, 1, 32), ' ') END AS span FROM w""")
def first_spans(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", X.first_span(F.col("text")).alias("span"))


@query(f"""WITH o AS (SELECT artifact_id, created_at AS t, doc_id, row_number() OVER (PARTITION BY artifact_id ORDER BY created_at NULLS FIRST, doc_id) AS n FROM documents WHERE kind = 'issue_opening' AND artifact_id IS NOT NULL),
a AS (SELECT d.artifact_id, d.doc_id, o.doc_id AS opening, row_number() OVER (PARTITION BY d.artifact_id ORDER BY d.created_at, d.doc_id) AS n FROM documents d JOIN o ON o.artifact_id = d.artifact_id AND o.n = 1
  WHERE d.kind IN ('issue_comment', 'review_comment') AND len({S.plain_words("d.text")}) >= 16 AND d.created_at > o.t)
SELECT artifact_id, opening, doc_id AS answer FROM a WHERE n = 1""")
def reply_answers(spark: SparkSession, d: str) -> DataFrame:
    return harvest.reply_answers(documents(spark, d), ["issue_opening"], ["issue_comment", "review_comment"])


@query("""WITH l AS (SELECT artifact_id, max(created_at) AS l FROM documents WHERE kind = 'release_note' OR regexp_matches(text, '(?i)\\b(?:fixed|resolved|closed|merged)\\b') GROUP BY 1)
SELECT doc_id, artifact_id FROM documents JOIN l USING (artifact_id) WHERE kind = 'issue_comment' AND l >= created_at""")
def answers_with_evidence(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    events = docs.where((F.col("kind") == "release_note") | F.col("text").rlike(r"(?i)\b(?:fixed|resolved|closed|merged)\b"))
    return harvest.later_evidence(docs.where("kind = 'issue_comment'").select("doc_id", "artifact_id", "created_at"), events).select("doc_id", "artifact_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY array_to_string({S.words('text')}, ' ') ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_dedup(documents(spark, d), "text", ["doc_id"]).select("doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY artifact_id, array_to_string({S.words('text')}, ' ') ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def scoped_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_dedup(documents(spark, d), "text", ["doc_id"], ["artifact_id"]).select("doc_id")


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS m FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY unit_id ORDER BY doc_id) AS n FROM documents) WHERE n = 1) WHERE m = 1""")
def two_key_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.two_key_first(documents(spark, d), "unit_id", "text", ["doc_id"]).select("doc_id")


@query("""WITH u AS (SELECT doc_id, unit_id, CASE WHEN source = 'manual' THEN 0 ELSE 1 END AS segment FROM documents) SELECT doc_id, segment FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY segment, doc_id) AS n FROM u) WHERE n = 1""")
def segment_union(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "unit_id", "source")
    manual = F.coalesce(F.col("source") == "manual", F.lit(False))
    return dedup.union_in_order([docs.where(manual), docs.where(~manual)], "unit_id", ["doc_id"]).select("doc_id", "segment")


_SETS = f"""g AS (SELECT doc_id, {S.gram_keys("w", 5)} AS g FROM (SELECT doc_id, {S.words("text")} AS w FROM documents)),
s AS (SELECT list_sort(g) AS g, min(doc_id) AS id FROM g WHERE len(g) > 0 GROUP BY 1),
x AS (SELECT id, len(g) AS n, unnest(g) AS k FROM s),
p AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.k = b.k AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= (a.n + b.n - count(*)) * 0.8 - 1e-9)"""


@query(f"""WITH RECURSIVE {_SETS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT id, id FROM s),
r(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a), c AS (SELECT x, min(y) AS class_id FROM r GROUP BY x),
l AS (SELECT i, count(*) AS links FROM (SELECT a AS i FROM p UNION ALL SELECT b FROM p) GROUP BY i)
SELECT g.doc_id AS id, coalesce(c.class_id, g.doc_id) AS class_id, coalesce(l.links, 0) AS links FROM g LEFT JOIN s ON s.g = list_sort(g.g) LEFT JOIN c ON c.x = s.id LEFT JOIN l ON l.i = s.id""")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_duplicate_classes(documents(spark, d))


_GATE = f"""w AS (SELECT doc_id AS id, {S.words("text")} AS w FROM documents), f AS (SELECT *, min(id) OVER (PARTITION BY array_to_string(w, ' ')) AS first FROM w), o AS (SELECT id, w, list_sort({S.gram_keys("w")})[1:32] AS g FROM f WHERE id = first),
gx AS (SELECT id, unnest(g) AS k FROM o), ln AS (SELECT DISTINCT id FROM (SELECT a.id FROM gx a JOIN gx b ON a.k = b.k AND b.id < a.id GROUP BY a.id, b.id HAVING count(*) >= 16)),
sx AS (SELECT id, len(g) AS n, unnest(g) AS k FROM (SELECT id, {S.gram_keys("w", 4)} AS g FROM o WHERE len(w) < 39))"""


def _gate_sql(share: str) -> str:
    """CTE ``st`` (id, status)."""
    return f"""{_GATE}, sn AS (SELECT DISTINCT id FROM (SELECT a.id FROM sx a JOIN sx b ON a.k = b.k AND b.id < a.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= least(a.n, b.n) * {share})),
st AS (SELECT id, CASE WHEN id <> first THEN 'exact' WHEN id IN (SELECT id FROM ln) OR id IN (SELECT id FROM sn) THEN 'near' ELSE 'kept' END AS status FROM f)"""


def _gate(spark: SparkSession, d: str, share: float = dedup.SHORT_SHARE) -> DataFrame:
    return dedup.diversity_gate(documents(spark, d), "doc_id", "text", share=share)


@query(f"""WITH {_gate_sql("0.5")}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE status = 'exact') AS exact, count(*) FILTER (WHERE status = 'near') AS near FROM st), r AS (SELECT *, n - exact AS d, near / greatest(n - exact, 1) AS rate FROM c)
SELECT n, exact, near, round(rate, 5) AS rate, CASE WHEN rate > 0.25 THEN 'representatives' ELSE 'distinct' END AS action, CASE WHEN rate > 0.25 THEN d - near ELSE d END AS kept, CASE WHEN rate > 0.25 THEN d - near ELSE d END < 50000 AS dropped FROM r""")
def diversity_gate(spark: SparkSession, d: str) -> DataFrame:
    return dedup.gate_report(_gate(spark, d))


#: First texts at which the rate of near duplicates is read, and shares of common 4-grams at which it is told, as in the engine being matched.
CURVE, SHARES = (200, 500, 1000, 2000), (0.4, 0.5, 0.6)


@query(f"WITH {_gate_sql('0.5')}, i AS (SELECT status, row_number() OVER (ORDER BY id) AS i FROM st WHERE status <> 'exact') SELECT n::INT AS n, round(avg((status = 'near')::INT), 9) AS rate FROM i JOIN (SELECT unnest([200, 500, 1000, 2000]) AS n) ON i.i <= n GROUP BY n")
def diversity_curve(spark: SparkSession, d: str) -> DataFrame:
    return dedup.diversity_curve(stage(_gate(spark, d), "gate"), list(CURVE))


@query(" UNION ALL ".join(f"SELECT {x}::DOUBLE AS share, (WITH {_gate_sql(str(x))} SELECT round(count(*) FILTER (WHERE status = 'near') / count(*) FILTER (WHERE status <> 'exact'), 9) FROM st) AS rate" for x in SHARES))
def diversity_shares(spark: SparkSession, d: str) -> DataFrame:
    """The rate of near duplicates by the share of 4-grams that short texts must have in common."""
    out = None
    for x, gate in zip(SHARES, dedup.diversity_gates(documents(spark, d), "doc_id", "text", list(SHARES)), strict=True):
        c = gate.agg((F.count_if(F.col("status") == "near") / F.count_if(F.col("status") != "exact")).alias("r"))
        one = c.select(F.lit(x).alias("share"), F.round("r", 9).alias("rate"))
        out = one if out is None else out.union(one)
    return out


_QI = f"""pw AS (SELECT {S.words("text")} AS w FROM eval_item WHERE role = 'query'), 
ie AS (SELECT DISTINCT {S.key60("array_to_string(w, ' ')")} AS k FROM pw WHERE len(w) > 0),
ig AS (SELECT DISTINCT unnest({S.query_gram_keys("w")}) AS k FROM pw WHERE len(w) > 0),
iw AS (SELECT DISTINCT {S.key60("array_to_string(w, ' ')")} AS k FROM pw WHERE len(w) BETWEEN 4 AND 7)"""
_WHOLE = "list_concat(" + ", ".join(S.kgrams("w", k) for k in (4, 5)) + ")", "list_concat(" + ", ".join(S.kgrams("w", k) for k in (6, 7)) + ")"


def _hits_sql(rows: str, ident: str) -> str:
    """CTE ``hit`` (id, o) of query hits."""
    return f"""rw AS (SELECT {ident} AS id, {S.words("text")} AS w FROM {rows}),
hit AS (SELECT id, min(o) AS o FROM (
  SELECT id, 1 AS o FROM rw WHERE len(w) > 0 AND {S.key60("array_to_string(w, ' ')")} IN (SELECT k FROM ie)
  UNION ALL SELECT id, 2 FROM (SELECT id, unnest({S.query_gram_keys("w")}) AS k FROM rw WHERE len(w) > 0) WHERE k IN (SELECT k FROM ig)
  UNION ALL SELECT id, 3 FROM (SELECT id, unnest(list_transform(list_concat({_WHOLE[0]}, {_WHOLE[1]}), lambda g: {S.key60("g")})) AS k FROM rw WHERE len(w) > 0) WHERE k IN (SELECT k FROM iw)) GROUP BY id)"""


@query(f"WITH {_QI}, {_hits_sql('documents', 'doc_id')} SELECT id, CASE o WHEN 1 THEN 'exact' WHEN 2 THEN 'near' ELSE 'contains' END AS reason FROM hit")
def protected_query_hits(spark: SparkSession, d: str) -> DataFrame:
    return decontam.query_hits(documents(spark, d), decontam.query_index(items(spark, d, "query")), "doc_id")


_DI = f"""dw AS (SELECT item_id, {S.words("text")} AS w FROM eval_item WHERE role = 'passage'),
de AS (SELECT item_id, {S.key60("array_to_string(w, ' ')")} AS e, unnest(list_sort({S.gram_keys("w")})[1:32]) AS k FROM dw WHERE len(w) > 0),
pd AS (SELECT doc_id AS id, {S.words("text")} AS w FROM documents),
dx AS (SELECT id FROM pd WHERE len(w) > 0 AND {S.key60("array_to_string(w, ' ')")} IN (SELECT e FROM de)),
dn AS (SELECT DISTINCT id FROM (SELECT id, item_id FROM (SELECT id, unnest(list_sort({S.gram_keys("w")})[1:32]) AS k FROM pd WHERE len(w) > 0) JOIN de USING (k) GROUP BY id, item_id HAVING count(*) >= 8)),
dh AS (SELECT id, id IN (SELECT id FROM dx) AS exact, id IN (SELECT id FROM dn) AS near FROM (SELECT id FROM dx UNION SELECT id FROM dn))"""


@query(f"WITH {_DI} SELECT * FROM dh")
def protected_document_hits(spark: SparkSession, d: str) -> DataFrame:
    return decontam.document_hits(documents(spark, d), decontam.document_index(items(spark, d, "passage"), "item_id"), "doc_id")


@query(f"WITH {_DI}, c AS (SELECT count(*) FILTER (WHERE exact) AS exact, count(*) FILTER (WHERE near) AS near, count(*) AS either FROM dh), n AS (SELECT count(*) AS n FROM documents) SELECT n, exact, near, either, round(either / n, 9) AS rate FROM c, n")
def overlap_disclosure(spark: SparkSession, d: str) -> DataFrame:
    return decontam.overlap_disclosure(documents(spark, d), decontam.document_index(items(spark, d, "passage"), "item_id"), "doc_id")


@query(f"WITH {_QI}, {_hits_sql('documents', 'doc_id')}, {_DI}, a AS (SELECT id, CASE WHEN exact THEN 1 ELSE 2 END AS o FROM dh UNION ALL SELECT id, CASE WHEN o = 3 THEN 4 ELSE 3 END FROM hit) SELECT id, ['doc_exact', 'doc_near', 'query_gram', 'contains'][min(o)] AS reason FROM a GROUP BY id")
def pool_bans(spark: SparkSession, d: str) -> DataFrame:
    return decontam.ban_mask(documents(spark, d), decontam.document_index(items(spark, d, "passage"), "item_id"), decontam.query_index(items(spark, d, "query")), "doc_id")


@query(f"""WITH {_QI}, {_hits_sql("(SELECT qid, max(text) AS text FROM query_spec GROUP BY qid)", "qid")}, {_DI},
p AS (SELECT q.qid FROM (SELECT qid, unnest(positive_ids) AS u FROM query_spec) q JOIN documents d ON d.unit_id = q.u JOIN dh ON dh.id = d.doc_id),
a AS (SELECT id AS pair_id, 1 AS o FROM hit WHERE id IS NOT NULL UNION ALL SELECT qid, 2 FROM p) SELECT pair_id, CASE min(o) WHEN 1 THEN 'query' ELSE 'positive' END AS reason FROM a GROUP BY pair_id""")
def leaked_pairs(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_spec")
    text = q.groupBy("qid").agg(F.max("text").alias("text"))
    pos = q.select("qid", F.explode("positive_ids").alias("u")).join(documents(spark, d).select(F.col("unit_id").alias("u"), "doc_id"), "u").groupBy("qid").agg(F.collect_set("doc_id").alias("positive_ids"))
    pairs = text.join(pos, "qid", "left").withColumnRenamed("qid", "pair_id")
    return decontam.remove_leaked_pairs(pairs, documents(spark, d), items(spark, d, "query"), items(spark, d, "passage").withColumnRenamed("item_id", "doc_id"))


@query(f"""WITH {_QI}, {_hits_sql("(SELECT qid, max(text) AS text FROM query_spec GROUP BY qid)", "qid")}, {_DI},
a AS (SELECT source AS slice, count(*) AS docs, count(dh.id) AS dups FROM documents d LEFT JOIN dh ON dh.id = d.doc_id WHERE source IS NOT NULL GROUP BY 1),
l AS (SELECT split_part(min(source), '/', 1) AS slice, q.qid FROM query_spec q GROUP BY q.qid), b AS (SELECT slice, count(hit.id) AS leaked FROM l LEFT JOIN hit ON hit.id = l.qid GROUP BY 1)
SELECT slice, docs, dups, round(dups / docs, 9) AS dup_rate, coalesce(leaked, 0) AS leaked, CASE WHEN dups / docs > 0.005 OR coalesce(leaked, 0) > 0 THEN 'DROP' ELSE 'KEEP' END AS verdict FROM a LEFT JOIN b USING (slice)""")
def slice_verdicts(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_spec").groupBy("qid").agg(F.max("text").alias("text"), F.split_part(F.min("source"), F.lit("/"), F.lit(1)).alias("source"))
    return decontam.slice_verdicts(documents(spark, d).where("source is not null"), q, "source", decontam.document_index(items(spark, d, "passage"), "item_id"), decontam.query_index(items(spark, d, "query")))


@query(f"""WITH {_QI}, {_hits_sql("(SELECT qid, max(text) AS text FROM query_spec GROUP BY qid)", "qid")}, {_DI}, bd AS (SELECT DISTINCT unit_id FROM documents JOIN dh ON dh.id = doc_id),
u AS (SELECT DISTINCT unit_id FROM documents), q AS (SELECT DISTINCT qid FROM query_spec), kq AS (SELECT qid FROM q WHERE qid NOT IN (SELECT id FROM hit)), kd AS (SELECT unit_id FROM u WHERE unit_id NOT IN (SELECT unit_id FROM bd)),
rel AS (SELECT DISTINCT qid, unnest(positive_ids) AS doc_id FROM query_spec), kr AS (SELECT * FROM rel WHERE qid IN (SELECT qid FROM kq) AND doc_id IN (SELECT unit_id FROM kd))
SELECT 1 AS pos, 'documents' AS step, (SELECT count(*) FROM u WHERE unit_id IN (SELECT unit_id FROM bd)) AS dropped UNION ALL SELECT 2, 'queries', (SELECT count(*) FROM q WHERE qid IN (SELECT id FROM hit))
UNION ALL SELECT 3, 'judgements', (SELECT count(*) FROM (SELECT * FROM rel WHERE doc_id IS NOT NULL EXCEPT SELECT * FROM kr)) UNION ALL SELECT 4, 'queries_without_positive', (SELECT count(*) FROM kq WHERE qid NOT IN (SELECT qid FROM kr))""")
def decontamination_cascade(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    dup = decontam.document_hits(docs, decontam.document_index(items(spark, d, "passage"), "item_id"), "doc_id").select(F.col("id").alias("doc_id"))
    units = docs.select(F.col("unit_id").alias("doc_id")).distinct()
    banned = docs.join(dup, "doc_id", "left_semi").select(F.col("unit_id").alias("doc_id")).distinct()
    spec = table(spark, d, "query_spec")
    q = spec.groupBy("qid").agg(F.max("text").alias("text"))
    leaked = decontam.query_hits(q, decontam.query_index(items(spark, d, "query")), "qid").select(F.col("id").alias("qid"))
    rel = spec.select("qid", F.explode("positive_ids").alias("doc_id")).where("doc_id is not null")
    return decontam.cascade(units, q, rel, stage(banned, "banned"), stage(leaked, "leaked"))


@query(f"""WITH i AS (SELECT item_id, {S.words("text")} AS w FROM eval_item), d AS (SELECT DISTINCT {S.words("text")} AS w FROM documents), ex AS (SELECT item_id FROM i WHERE len(w) > 0 AND array_to_string(w, ' ') IN (SELECT array_to_string(w, ' ') FROM d)),
a AS (SELECT item_id, unnest({S.query_gram_keys("w")}) AS k FROM i WHERE len(w) > 0), b AS (SELECT array_to_string(w, ' ') AS s, unnest({S.query_gram_keys("w")}) AS k FROM d WHERE len(w) > 0), ne AS (SELECT DISTINCT item_id FROM (SELECT item_id, s FROM a JOIN b USING (k) GROUP BY 1, 2 HAVING count(*) >= 4))
SELECT label, count(*) AS items FROM (SELECT DISTINCT item_id, CASE WHEN item_id IN (SELECT item_id FROM ex) THEN 'exact' WHEN item_id IN (SELECT item_id FROM ne) THEN 'near' ELSE 'clean' END AS label FROM i) GROUP BY label""")
def exposure(spark: SparkSession, d: str) -> DataFrame:
    return decontam.exposure(items(spark, d), documents(spark, d), "item_id").groupBy("label").agg(F.count(F.lit(1)).alias("items"))


@query(f"""WITH s AS (SELECT item_id, {S.key60("array_to_string(w, ' ')")} AS k FROM (SELECT item_id, list_slice({S.words("text")}, 1, 6) AS w FROM eval_item) WHERE len(w) BETWEEN 4 AND 7),
p AS (SELECT doc_id, unnest(list_transform(list_concat({_WHOLE[0]}, {_WHOLE[1]}), lambda g: {S.key60("g")})) AS k FROM (SELECT doc_id, {S.words("text")} AS w FROM documents))
SELECT DISTINCT doc_id AS id, item_id AS short_id FROM p JOIN s USING (k)""")
def short_containment(spark: SparkSession, d: str) -> DataFrame:
    return decontam.contains_short(documents(spark, d), items(spark, d).select(F.col("item_id").alias("short_id"), "text"), "doc_id")


def copied_spans_sql() -> str:
    q, p = S.kgrams("q", 5), S.kgrams("p", 5)
    return f"SELECT qid, len(list_intersect({q}, {p})) > 0 AS copied FROM (SELECT qid, {S.words('qt')} AS q, {S.words('pt')} AS p FROM (SELECT q.qid, max(q.text) AS qt, max(d.text) AS pt FROM query_spec q JOIN documents d ON d.unit_id = q.source_doc WHERE q.qid IS NOT NULL GROUP BY q.qid))"


@query(copied_spans_sql())
def copied_spans(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_spec").where("qid is not null").select("qid", F.col("text").alias("qt"), F.col("source_doc").alias("unit_id"))
    x = q.join(documents(spark, d).select("unit_id", F.col("text").alias("pt")), "unit_id").groupBy("qid").agg(F.max("qt").alias("qt"), F.max("pt").alias("pt"))
    return x.select("qid", decontam.copied_span(F.col("qt"), F.col("pt")).alias("copied"))


_CC = """k AS (SELECT doc_id AS n, 'a:' || artifact_id AS k FROM documents WHERE artifact_id IS NOT NULL UNION SELECT doc_id, 't:' || md5(text) FROM documents WHERE trim(text) <> ''),
e AS (SELECT DISTINCT a.k AS x, b.k AS y FROM k a JOIN k b USING (n)), r(x, y) AS (SELECT k, k FROM k UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x), m AS (SELECT DISTINCT n, y FROM k JOIN c ON c.x = k.k), root AS (SELECT y, min(n::VARCHAR) AS root FROM m GROUP BY y),
fam AS (SELECT d.doc_id::VARCHAR AS node, coalesce(root.root, d.doc_id::VARCHAR) AS root FROM documents d LEFT JOIN m ON m.n = d.doc_id LEFT JOIN root USING (y))"""


def _families(spark: SparkSession, d: str) -> DataFrame:
    x = documents(spark, d).select("doc_id", "artifact_id", F.when(F.trim("text") != "", F.md5("text")).alias("t"))
    return graph.families(x, "doc_id", ["artifact_id", "t"])


@query(f"WITH RECURSIVE {_CC} SELECT node, root, 'fam:' || substr(sha256(root), 1, 20) AS family_id FROM fam")
def document_families(spark: SparkSession, d: str) -> DataFrame:
    return graph.family_ids(_families(spark, d))


@query(f"WITH RECURSIVE {_CC}, s AS (SELECT root, count(*) AS n FROM fam GROUP BY root) SELECT count(*) AS components, sum(n)::BIGINT AS nodes, max(n) AS largest, count(*) FILTER (WHERE n = 1) AS singletons, count(*) FILTER (WHERE n > 50) AS above, (SELECT string_agg(n::VARCHAR, ',' ORDER BY n DESC) FROM (SELECT n FROM s ORDER BY n DESC LIMIT 10)) AS top_sizes FROM s")
def family_statistics(spark: SparkSession, d: str) -> DataFrame:
    return graph.component_stats(stage(_families(spark, d), "families"), large=50)


@query("""WITH RECURSIVE x AS (SELECT DISTINCT qid AS n, unnest(positive_ids) AS k FROM query_spec WHERE qid IS NOT NULL), f AS (SELECT k, count(*) AS c FROM x WHERE k IS NOT NULL GROUP BY k), g AS (SELECT x.* FROM x JOIN f USING (k) WHERE c BETWEEN 2 AND 8),
e AS (SELECT DISTINCT a.n AS a, b.n AS b FROM g a JOIN g b USING (k)), q AS (SELECT DISTINCT qid AS n FROM query_spec WHERE qid IS NOT NULL), r(x, y) AS (SELECT n, n FROM q UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y)
SELECT x AS node, min(y) AS root FROM r GROUP BY x""")
def hub_pruned_families(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "query_spec").select("qid", F.explode_outer("positive_ids").alias("p"))
    return graph.families(x, "qid", ["p"], hub=HUB)


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY created_at DESC NULLS LAST, doc_id DESC) AS n FROM documents) SELECT artifact_id, doc_id FROM n WHERE n = 1""")
def newest_of_family(spark: SparkSession, d: str) -> DataFrame:
    return graph.newest_of_family(documents(spark, d).select("artifact_id", "created_at", "doc_id"), "artifact_id", "created_at", "doc_id").select("artifact_id", "doc_id")


@query()
def fuzzy_titles(spark: SparkSession, d: str) -> DataFrame:
    return joins.fuzzy_pairs(documents(spark, d).where("title is not null"), "doc_id", X.title_shape(F.col("title")))


_NAMED = """n AS (SELECT p_partkey AS id, string_split(p_type || ' ' || p_name, ' ') AS w, p_partkey % 3 AS form FROM part), t AS (SELECT id, form, w, upper(array_to_string(list_transform(w, lambda x: substr(x, 1, 1)), '')) AS short FROM n)"""
_DENIED = ", ".join(f"'{x}'" for x in harvest.ABBREVIATION_DENY)


def _named_parts(spark: SparkSession, d: str) -> DataFrame:
    """Texts that define an abbreviation of a part's type and name: plainly, with function words, or wrongly."""
    w = F.split(F.concat_ws(" ", "p_type", "p_name"), " ")
    short = F.upper(F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), ""))
    plain, loose = F.array_join(w, " "), F.concat(F.element_at(w, 1), F.lit(" of the "), F.array_join(F.slice(w, 2, F.size(w)), " "))
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat(plain, F.lit(" ("), short)).when(F.col("p_partkey") % 3 == 1, F.concat(loose, F.lit(" ( "), short)).otherwise(F.concat(plain, F.lit(" (Q"), short))
    tail = F.concat(F.lit("). Later the "), plain, F.lit(" was moved to another shelf again."))
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("Order 7 holds one "), said, tail).alias("text"))


@query(f"WITH {_NAMED} SELECT id, CASE form WHEN 0 THEN array_to_string(w, ' ') ELSE w[1] || ' of the ' || array_to_string(w[2:], ' ') END AS expansion, short AS abbreviation FROM t WHERE form < 2 AND lower(short) NOT IN ({_DENIED})")
def definition_pairs(spark: SparkSession, d: str) -> DataFrame:
    return harvest.definitions(_named_parts(spark, d))


_LEXICON = f"""{_NAMED}, x AS (SELECT DISTINCT id, lower(CASE form WHEN 0 THEN array_to_string(w, ' ') ELSE w[1] || ' of the ' || array_to_string(w[2:], ' ') END) AS expansion, short AS abbreviation FROM t WHERE form < 2 AND lower(short) NOT IN ({_DENIED})),
lx AS (SELECT expansion, abbreviation, count(DISTINCT id) AS docs FROM x WHERE abbreviation IN (SELECT abbreviation FROM x GROUP BY 1 HAVING count(DISTINCT expansion) = 1) AND expansion IN (SELECT expansion FROM x GROUP BY 1 HAVING count(DISTINCT abbreviation) = 1) GROUP BY 1, 2)"""


@query(f"WITH {_LEXICON} SELECT * FROM lx")
def definition_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return harvest.alias_lexicon(harvest.definitions(_named_parts(spark, d)))


_CODES = """c AS (SELECT o_orderkey AS id, o_orderstatus AS kind, o_custkey % 50 AS grp, md5(o_orderkey::VARCHAR) AS h, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS moment, o_orderkey % 4 AS form FROM orders)"""


def _coded_orders(spark: SparkSession, d: str) -> DataFrame:
    """Log lines that differ in ids, times and addresses only, but for their status."""
    h = F.md5(F.col("o_orderkey").cast("string"))
    part = lambda i, n: F.substring(h, i, n)
    ident = F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(13, 3), F.lit("-a"), part(16, 3), F.lit("-"), part(19, 12))
    form = F.col("o_orderkey") % 4
    what = F.when(form == 0, ident).when(form == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(form == 2, F.concat(F.lit("0x"), part(1, 10))).otherwise(h)
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("grp"), F.concat(F.lit("state "), "o_orderstatus", F.lit(" of "), what, F.lit(" noted")).alias("text"))


@query(f"WITH {_CODES} SELECT id AS o_orderkey, 'state ' || kind || ' of <v_' || CASE form WHEN 0 THEN 'uuid' WHEN 1 THEN 'timestamp' WHEN 2 THEN 'address' ELSE 'hash' END || '> noted' AS form FROM c")
def placeholder_lines(spark: SparkSession, d: str) -> DataFrame:
    return _coded_orders(spark, d).select("o_orderkey", X.placeholders(F.col("text")).alias("form"))


@query(f"""WITH {_CODES}, f AS (SELECT 'state ' || kind || ' of <v_' || CASE form WHEN 0 THEN 'uuid' WHEN 1 THEN 'timestamp' WHEN 2 THEN 'address' ELSE 'hash' END || '> noted' AS form, CASE form WHEN 1 THEN moment ELSE h END AS v, grp FROM c)
SELECT md5(form) AS form, count(DISTINCT v) AS texts, count(DISTINCT grp) AS groups, count(*) AS n, count(*) >= 5 AS fails FROM f GROUP BY f.form HAVING count(DISTINCT v) > 1 AND count(DISTINCT grp) > 1""")
def placeholder_audit(spark: SparkSession, d: str) -> DataFrame:
    return harvest.placeholder_collisions(_coded_orders(spark, d), "text", "grp")


@query(f"""WITH s AS (SELECT doc_id, {S.key60("array_to_string(w, ' ')")} AS k FROM (SELECT doc_id, {S.words("title")} AS w FROM documents) WHERE len(w) BETWEEN 4 AND 7), p AS (SELECT doc_id, unnest(list_transform(list_concat({_WHOLE[0]}, {_WHOLE[1]}), lambda g: {S.key60("g")})) AS k FROM (SELECT doc_id, {S.words("text")} AS w FROM documents))
SELECT DISTINCT p.doc_id AS id, s.doc_id AS short_id FROM p JOIN s USING (k)""")
def title_containment(spark: SparkSession, d: str) -> DataFrame:
    """Titles of 4 to 7 words that a text holds whole."""
    docs = documents(spark, d)
    return decontam.contains_short(docs, docs.select(F.col("doc_id").alias("short_id"), F.col("title").alias("text")), "doc_id")
