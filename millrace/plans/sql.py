"""SQL fragments that repeat the functions of ``millrace.functions``."""

from __future__ import annotations

import re

from millrace.functions import text as X


def words(col: str) -> str:
    """``fingerprint_words``."""
    return rf"list_filter(string_split(regexp_replace(lower(coalesce({col}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"


def plain_words(col: str) -> str:
    """``words``."""
    return rf"list_filter(string_split(regexp_replace(coalesce({col}, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '), lambda w: w <> '')"


def lexical(col: str) -> str:
    """``lexical_tokens``."""
    return rf"list_transform(regexp_extract_all(coalesce({col}, ''), '[A-Za-z0-9][A-Za-z0-9_./:+#-]*'), lambda t: lower(t))"


def key60(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 15))::BIGINT"


def kgrams(w: str, k: int, short_whole: bool = False) -> str:
    short = f"CASE WHEN len({w}) > 0 THEN [array_to_string({w}, ' ')] ELSE [] END" if short_whole else "[]"
    return f"CASE WHEN len({w}) >= {k} THEN list_transform(range(1, len({w}) - {k} + 2), lambda i: array_to_string(list_slice({w}, i, i + {k} - 1), ' ')) ELSE {short} END"


def gram_keys(w: str, k: int = 8, short_whole: bool = True) -> str:
    return f"list_distinct(list_transform({kgrams(w, k, short_whole)}, lambda g: {key60('g')}))"


def query_gram_keys(w: str) -> str:
    return f"CASE WHEN len({w}) BETWEEN 4 AND 7 THEN list_distinct(list_concat({gram_keys(w)}, {gram_keys(w, 4, False)})) ELSE {gram_keys(w)} END"


def order_key(seed: str, expr: str) -> str:
    return f"md5('{seed}' || chr(31) || ({expr})::VARCHAR)"


#: A run of one system: the highest finite score of each document.
RUN = "SELECT qid, doc_id, max(score) + 0.0 AS score FROM scored_point WHERE system = '{0}' AND isfinite(score) AND qid IS NOT NULL AND doc_id IS NOT NULL GROUP BY qid, doc_id"
QRELS = "SELECT DISTINCT qid, unnest(positive_ids) AS doc_id, 1 AS grade FROM query_spec WHERE qid IS NOT NULL"


def ranked(inner: str, group: str = "qid", item: str = "doc_id") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, {item}) AS rank FROM ({inner})"


def metrics(run: str, qrels: str, k: int = 10, deep: int = 100) -> str:
    """Query of ``metrics.per_query``; ``run`` and ``qrels`` are names."""
    return f"""
SELECT i.qid, round(coalesce(dcg / idcg, 0), 9) AS ndcg, round(coalesce(n / relevant, 0), 9) AS recall, round(coalesce(n_deep / relevant, 0), 9) AS recall_deep,
  round(coalesce(1 / first, 0), 9) AS mrr, round(coalesce(n / {k}.0, 0), 9) AS precision, coalesce((first <= {k // 2})::INT, 0) AS success
FROM (
  SELECT qid, sum(CASE WHEN i <= {k} THEN grade / log2(i + 1) END) AS idcg, count(*) AS relevant
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc_id) AS i FROM {qrels} WHERE grade > 0 AND doc_id IS NOT NULL) GROUP BY qid) i
LEFT JOIN (
  SELECT r.qid, sum(CASE WHEN rank <= {k} THEN grade / log2(rank + 1) END) AS dcg, count(*) FILTER (WHERE rank <= {k}) AS n, count(*) AS n_deep, min(CASE WHEN rank <= {k} THEN rank END) AS first
  FROM {run} r JOIN {qrels} q ON q.qid = r.qid AND q.doc_id = r.doc_id WHERE rank <= {deep} AND grade > 0 GROUP BY r.qid) g ON g.qid = i.qid
"""


def mixed32(source: str, x: str = "x") -> str:
    """``stats.mixed32`` of column ``x`` of a query, other columns kept."""
    out = source
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        out = f"SELECT * REPLACE ((xor({x}, {x} >> {shift}) * {factor}) & 4294967295 AS {x}) FROM ({out})"
    return f"SELECT * REPLACE (xor({x}, {x} >> 16) AS {x}) FROM ({out})"


def half32(md5: str, at: int) -> str:
    return f"('0x' || substr({md5}, {at}, 8))::UBIGINT"


def picks(sizes: str, reps: int, seed: str, stratum: str) -> str:
    """(rep, stratum, k): the unit that each slot of each replicate takes; ``sizes`` is (stratum, n)."""
    keys = f"SELECT rep, {stratum}, n, {half32('h', 1)} AS one, {half32('h', 9)} AS two FROM (SELECT rep, {stratum}, n, md5('{seed}|' || rep || '|' || {stratum}) AS h FROM {sizes}, (SELECT unnest(range(0, {reps})) AS rep))"
    slots = f"SELECT rep, {stratum}, n, two, (unnest(range(0, n))::UBIGINT + one) & 4294967295 AS x FROM ({keys})"
    return f"SELECT rep, {stratum}, ((x * n::UBIGINT) >> 32)::BIGINT AS k FROM ({mixed32(f'SELECT * REPLACE (xor(x, two) AS x) FROM ({mixed32(slots)})')})"


#: A boundary of words of letters, digits and _, before and after; other engines have none for all letters.
EDGE = (r"(?:^|[^\p{L}\p{Nd}_])", r"(?:$|[^\p{L}\p{Nd}_])")
_SPACE = r"[ \t\n\x0B\f\r]"


def edged(pattern: str) -> str:
    """A pattern for RE2 whose word boundaries stand at the ends of alternatives."""
    out = re.sub(r"(^|\(\?i\)|\(\?:|\|)\\b", lambda m: m[1] + EDGE[0], pattern)
    return out.replace(r"\b", EDGE[1]).replace("'", "''")


def collapsed(col: str) -> str:
    """``collapse_space``."""
    return rf"trim(regexp_replace({col}, '{_SPACE}+', ' ', 'g'))"


def sentences(col: str) -> str:
    """``sentences``; a private character marks the breaks."""
    marked = rf"""regexp_replace({collapsed(f"coalesce({col}, '')")}, '([.!?]) +([A-Z0-9"''(])', '\1' || chr(57344) || '\2', 'g')"""
    return f"list_filter(list_transform(string_split({marked}, chr(57344)), lambda s: trim(s)), lambda s: s <> '')"


def is_claim(s: str) -> str:
    first, verb = edged(X.FIRST_PERSON), edged(X.FINITE_VERB)
    return f"(len({plain_words(s)}) BETWEEN 8 AND 40 AND NOT ends_with({s}, '?') AND NOT regexp_matches({s}, '{first}') AND regexp_matches({s}, '{verb}'))"


def folded(col: str) -> str:
    """``fold_case_space``."""
    return f"replace({collapsed(f'lower({col})')}, 'ß', 'ss')"
