"""Removal of training data that overlaps protected texts.

Protected texts are indexed by keys: exact text, 8-grams (a shorter text is one
gram), 4-grams of texts of 4 to 7 words on the query side, whole texts of 4 to 7
words for containment, and sketches of 32 keys for documents. Every test is an
equi-join on a key; the protected side is broadcast only when it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import hashing as H
from millrace.functions import text as X
from millrace.session import BROADCAST_BYTES, UNPACKED, bounded_broadcast, stage

from .dedup import SHARED_DECONTAM, SHARED_SCREEN, SKETCH

SHORT_LOW, SHORT_HIGH = 4, 7


def _words(rows: DataFrame, ident: str, text: str) -> DataFrame:
    return rows.select(F.col(ident).alias("id"), X.fingerprint_words(F.col(text)).alias("w")).where(F.size("w") > 0)


def _whole_keys(words: Column, lengths: list[int]) -> Column:
    """Keys of all windows of so many words."""
    parts = [A.kgrams(words, k) for k in lengths]
    return F.array_distinct(F.transform(F.concat(*parts), H.key60)) if parts else F.array().cast("array<bigint>")


def query_index(protected: DataFrame, text: str = "text") -> DataFrame:
    """(kind, key) of protected queries: exact, gram, and whole with its number of words."""
    w = protected.select(X.fingerprint_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    exact = w.select(F.lit("exact").alias("kind"), H.text_key(F.col("w")).alias("key"))
    gram = w.select(F.lit("gram"), F.explode(A.query_gram_keys(F.col("w"))))
    whole = w.where(F.size("w").between(SHORT_LOW, SHORT_HIGH)).select(F.concat(F.lit("whole"), F.size("w").cast("string")), H.text_key(F.col("w")))
    return exact.union(gram).union(whole).distinct()


def query_hits(rows: DataFrame, index: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """(id, reason): 'exact', 'near' or 'contains', the first that holds; rows without a hit are absent.

    Windows are looked up only of lengths that a protected text has.
    """
    index = stage(index, "index")
    lengths = [k for k in range(SHORT_LOW, SHORT_HIGH + 1) if (f"whole{k}",) in {tuple(r) for r in index.where(F.startswith("kind", F.lit("whole"))).select("kind").distinct().collect()}]  # 4 at most
    w = _words(rows, ident, text)
    kinds = [("exact", F.array(H.text_key(F.col("w")))), ("gram", A.query_gram_keys(F.col("w"))), *[(f"whole{k}", _whole_keys(F.col("w"), [k])) for k in lengths]]
    keys = F.array(*[F.struct(F.lit(n).alias("kind"), k.alias("k")) for n, k in kinds])
    probe = w.select("id", F.explode(keys).alias("e")).select("id", "e.kind", F.explode("e.k").alias("key"))
    hit = probe.join(bounded_broadcast(index, BROADCAST_BYTES // UNPACKED), ["kind", "key"], "left_semi")
    order = F.when(F.col("kind") == "exact", 1).when(F.col("kind") == "gram", 2).otherwise(3)
    best = hit.groupBy("id").agg(F.min(order).alias("o"))
    return best.select("id", F.when(F.col("o") == 1, "exact").when(F.col("o") == 2, "near").otherwise("contains").alias("reason"))


def contains_short(rows: DataFrame, short: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """(id, short_id): texts that hold a whole text of 4 to 7 words; ``short`` is (short_id, text)."""
    s = short.select("short_id", X.fingerprint_words(F.col("text")).alias("w")).where(F.size("w").between(SHORT_LOW, SHORT_HIGH)).select("short_id", H.text_key(F.col("w")).alias("key"))
    probe = _words(rows, ident, text).select("id", F.explode(_whole_keys(F.col("w"), list(range(SHORT_LOW, SHORT_HIGH + 1)))).alias("key"))
    return probe.join(bounded_broadcast(s), "key").select("id", "short_id").distinct()


def document_index(protected: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """(item, exact, key): the exact key and the sketch keys of protected documents."""
    w = _words(protected, ident, text)
    return w.select(F.col("id").alias("item"), H.text_key(F.col("w")).alias("exact"), F.explode(A.bottom(A.gram_keys(F.col("w")), SKETCH)).alias("key"))


def document_hits(rows: DataFrame, index: DataFrame, ident: str, text: str = "text", shared: int = SHARED_DECONTAM) -> DataFrame:
    """(id, exact, near): documents equal to a protected one, or sharing at least ``shared`` sketch keys with a single one."""
    index = stage(index, "index")
    w = _words(rows, ident, text)
    items = index.select("exact").distinct()
    exact = w.select("id", H.text_key(F.col("w")).alias("exact")).join(bounded_broadcast(items, BROADCAST_BYTES // UNPACKED), "exact", "left_semi").select("id", F.lit(1).alias("e"), F.lit(0).alias("n"))
    probe = w.select("id", F.explode(A.bottom(A.gram_keys(F.col("w")), SKETCH)).alias("key"))
    near = probe.join(bounded_broadcast(index.select("item", "key"), BROADCAST_BYTES // UNPACKED), "key").groupBy("id", "item").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= shared).select("id", F.lit(0).alias("e"), F.lit(1).alias("n")).distinct()
    return exact.union(near).groupBy("id").agg((F.max("e") == 1).alias("exact"), (F.max("n") == 1).alias("near"))


def remove_leaked_pairs(pairs: DataFrame, docs: DataFrame, protected_queries: DataFrame, protected_docs: DataFrame) -> DataFrame:
    """(pair_id, reason) of pairs (pair_id, text, positive_ids) to drop: 'query' if the query leaks, else 'positive' if any positive repeats a protected document."""
    q = query_hits(pairs, query_index(protected_queries), "pair_id").select(F.col("id").alias("pair_id"), F.lit(1).alias("o"))
    d = document_hits(docs, document_index(protected_docs, "doc_id"), "doc_id").select(F.col("id").alias("doc_id"))
    p = pairs.select("pair_id", F.explode("positive_ids").alias("doc_id")).join(d, "doc_id", "left_semi").select("pair_id", F.lit(2).alias("o"))
    return q.union(p).groupBy("pair_id").agg(F.min("o").alias("o")).select("pair_id", F.when(F.col("o") == 1, "query").otherwise("positive").alias("reason"))


def overlap_disclosure(rows: DataFrame, index: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """One row: rows, exact, near and either, and the rate; nothing is removed."""
    h = document_hits(rows, index, ident, text)
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    c = h.agg(F.count_if("exact").alias("exact"), F.count_if("near").alias("near"), F.count(F.lit(1)).alias("either"))
    return n.crossJoin(c).select("n", "exact", "near", "either", F.round(F.col("either") / F.greatest("n", F.lit(1)), 9).alias("rate"))  # one row each


def ban_mask(pool: DataFrame, doc_index: DataFrame, q_index: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """(id, reason): the first of doc_exact, doc_near, query_gram, contains for banned rows of a pool."""
    d = document_hits(pool, doc_index, ident, text).select("id", F.when(F.col("exact"), 1).otherwise(2).alias("o"))
    q = query_hits(pool, q_index, ident, text).select("id", F.when(F.col("reason") == "contains", 4).otherwise(3).alias("o"))
    names = F.element_at(F.array(*[F.lit(x) for x in ("doc_exact", "doc_near", "query_gram", "contains")]), F.col("o"))
    return d.union(q).groupBy("id").agg(F.min("o").alias("o")).select("id", names.alias("reason"))


def slice_verdicts(docs: DataFrame, queries: DataFrame, slice_col: str, doc_index: DataFrame, q_index: DataFrame, max_dup_rate: float = 0.005) -> DataFrame:
    """(slice, docs, dups, dup_rate, leaked, verdict): DROP above the duplicate rate or with any leaked query."""
    s = slice_col
    dup = document_hits(docs, doc_index, "doc_id").select(F.col("id").alias("doc_id"), F.lit(1).alias("d"))
    per_doc = docs.select("doc_id", s).join(dup, "doc_id", "left").groupBy(s).agg(F.count(F.lit(1)).alias("docs"), F.count("d").alias("dups"))
    leak = query_hits(queries, q_index, "qid").select(F.col("id").alias("qid"), F.lit(1).alias("l"))
    per_q = queries.select("qid", s).join(leak, "qid", "left").groupBy(s).agg(F.count("l").alias("leaked"))
    j = per_doc.join(per_q, s, "left").withColumn("leaked", F.coalesce("leaked", F.lit(0)))
    rate = F.col("dups") / F.col("docs")
    return j.select(F.col(s).alias("slice"), "docs", "dups", F.round(rate, 9).alias("dup_rate"), "leaked", F.when((rate > max_dup_rate) | (F.col("leaked") > 0), "DROP").otherwise("KEEP").alias("verdict"))


def cascade(docs: DataFrame, queries: DataFrame, qrels: DataFrame, banned_docs: DataFrame, leaked_queries: DataFrame) -> DataFrame:
    """(step, dropped): duplicate documents, leaked queries, judgements left without either, queries left without a positive."""
    d = docs.select("doc_id").join(banned_docs.select("doc_id"), "doc_id", "left_semi")
    kept_docs = docs.select("doc_id").join(banned_docs.select("doc_id"), "doc_id", "left_anti")
    q = queries.select("qid").join(leaked_queries.select("qid"), "qid", "left_semi")
    kept_q = queries.select("qid").join(leaked_queries.select("qid"), "qid", "left_anti")
    rel = qrels.select("qid", "doc_id").distinct()
    kept_rel = rel.join(kept_q, "qid", "left_semi").join(kept_docs, "doc_id", "left_semi")
    lost = kept_q.join(kept_rel.select("qid"), "qid", "left_anti")
    count = lambda df, name, pos: df.agg(F.lit(pos).alias("pos"), F.lit(name).alias("step"), F.count(F.lit(1)).alias("dropped"))
    gone = rel.join(kept_rel, ["qid", "doc_id"], "left_anti")
    return count(d, "documents", 1).union(count(q, "queries", 2)).union(count(gone, "judgements", 3)).union(count(lost, "queries_without_positive", 4))


def exposure(items: DataFrame, streams: DataFrame, ident: str, text: str = "text", shared: int = SHARED_SCREEN) -> DataFrame:
    """(id, label): 'exact' if a stream text (stream, text) equals it, 'near' if one shares ``shared`` query grams with it, else 'clean'."""
    i = _words(items, ident, text)
    s = streams.select(X.fingerprint_words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    ex = i.select("id", H.text_key(F.col("w")).alias("k")).join(s.select(H.text_key(F.col("w")).alias("k")).distinct(), "k", "left_semi").select("id", F.lit(1).alias("o"))
    a = i.select("id", F.explode(A.query_gram_keys(F.col("w"))).alias("k"))
    b = s.select(F.md5(F.array_join("w", " ")).alias("sid"), F.explode(A.query_gram_keys(F.col("w"))).alias("k"))
    near = b.join(bounded_broadcast(a), "k").groupBy("id", "sid").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= shared).select("id", F.lit(2).alias("o"))
    best = ex.union(near).groupBy("id").agg(F.min("o").alias("o"))
    return items.select(F.col(ident).alias("id")).distinct().join(best, "id", "left").select("id", F.when(F.col("o") == 1, "exact").when(F.col("o") == 2, "near").otherwise("clean").alias("label"))


def leakage_shares(items: DataFrame, streams: DataFrame, ident: str, group: str, text: str = "text") -> DataFrame:
    """(group, items, exact, near): the shares of each group of held-out items that ``exposure`` labels exact and near."""
    e = exposure(items, streams, ident, text)
    j = items.select(F.col(ident).alias("id"), group).join(e, "id")
    share = lambda n: F.round(F.count_if(F.col("label") == n) / F.count(F.lit(1)), 9).alias(n)
    return j.groupBy(group).agg(F.count(F.lit(1)).alias("items"), share("exact"), share("near"))


def keep_mask(pool: DataFrame, doc_index: DataFrame, q_index: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """(id, keep) for every row of a pool: not banned by ``ban_mask``."""
    banned = ban_mask(pool, doc_index, q_index, ident, text).select("id", F.lit(True).alias("__b"))
    return pool.select(F.col(ident).alias("id")).join(banned, "id", "left").select("id", F.col("__b").isNull().alias("keep"))


def mask_identity(pool: DataFrame, protected: DataFrame) -> str:
    """A name for the mask of a pool by protected texts: another pool or other texts have another name."""
    from millrace.sources.sinks import table_identity  # noqa: PLC0415

    return "-".join(table_identity(x).first().identity[:16] for x in (pool, protected))


def copied_span(query: Column, source: Column, k: int = 5, excluded: Column | None = None) -> Column:
    """Whether the query shares a k-gram of words with its source.

    Windows of the source that lie wholly inside an occurrence of the excluded
    span are left out by position, not by value.
    """
    q, s = A.kgrams(X.fingerprint_words(query), k), X.fingerprint_words(source)
    if excluded is None:
        return F.coalesce(F.arrays_overlap(q, A.kgrams(s, k)), F.lit(False))

    def outside(s: Column, e: Column) -> Column:
        n = F.size(e)
        starts = F.when((n > 0) & (F.size(s) >= n), F.filter(F.sequence(F.lit(1), F.size(s) - n + 1), lambda i: F.slice(s, i, n) == e)).otherwise(F.array().cast("array<int>"))
        return A.let(starts, lambda at: F.filter(A.kgrams(s, k), lambda g, i: ~F.exists(at, lambda a: (i + 1 >= a) & (i + k <= a + n - 1))))

    grams = A.let(s, lambda s: A.let(X.fingerprint_words(excluded), lambda e: outside(s, e)))
    return F.coalesce(F.arrays_overlap(q, grams), F.lit(False))
