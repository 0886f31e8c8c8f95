"""Terms worth a row of their own: support, ranking, selection, rosters, domains."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.session import bounded_broadcast


def discover(queries: DataFrame, min_length: int = 2, set_aside: DataFrame | None = None) -> DataFrame:
    """(term, docs, contexts, residual, score) of (qid, text, source_doc, domain, residual).

    Texts count once; support is distinct source documents and queries; the
    residual is a mean; score = residual * ln(1 + docs). Terms in ``set_aside``
    (those a tokenizer keeps whole) are left out.
    """
    q = queries.where(F.col("text").isNotNull())
    w = Window.partitionBy("text").orderBy("qid")
    q = q.withColumn("n", F.row_number().over(w)).where("n = 1")
    x = q.select("qid", "source_doc", F.col("residual").alias("r"), F.explode(X.terms(F.col("text"))).alias("term")).where(F.length("term") >= min_length)
    if set_aside is not None:
        x = x.join(set_aside.select("term"), "term", "left_anti")
    g = x.groupBy("term").agg(F.count_distinct("source_doc").alias("docs"), F.count_distinct("qid").alias("contexts"), F.coalesce(F.avg("r"), F.lit(0.0)).alias("residual"))
    return g.select("term", "docs", "contexts", F.round("residual", 9).alias("residual"), F.round(F.col("residual") * F.log1p("docs"), 9).alias("score"))


def domain_votes(rows: DataFrame) -> DataFrame:
    """One vote for each (term, source_doc): the domain of the document, the smallest if rows differ."""
    return rows.groupBy("term", "source_doc").agg(F.min("domain").alias("domain"))


def ranked_terms(stats: DataFrame, top: int) -> DataFrame:
    """(pos, term, ...): score descending, documents descending, term; the best ``top``."""
    best = stats.orderBy(F.desc("score"), F.desc("docs"), "term").limit(top)
    return best.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("docs"), "term")))


def select_terms(stats: DataFrame, min_docs: int, min_contexts: int, total: int, per_domain: int, expansions: DataFrame | None = None, pinned: tuple[str, ...] = (), look_ahead: int = 20) -> DataFrame:
    """(pos, term, domain, reason) of stats (term, docs, contexts, score, domain).

    Pinned terms first, then by rank, under a cap in all and for each domain.
    Abbreviations need twice the minima or are replaced in place by their
    expansion. The caps are applied in order by one task that gets the best
    ``total`` of each domain only, since no domain can place more.
    """
    ok = (F.col("docs") >= min_docs) & (F.col("contexts") >= min_contexts)
    twice = (F.col("docs") >= 2 * min_docs) & (F.col("contexts") >= 2 * min_contexts)
    x = stats.where(ok | F.col("term").isin(*pinned))
    if expansions is not None:
        x = x.join(expansions.select(F.lower("abbreviation").alias("term"), F.lower("expansion").alias("expansion")), "term", "left")
    else:
        x = x.withColumn("expansion", F.lit(None).cast("string"))
    short = X.is_abbreviation(F.col("term")) & ~twice & ~F.col("term").isin(*pinned)
    x = x.where(~short | F.col("expansion").isNotNull()).select(F.when(short, F.col("expansion")).otherwise(F.col("term")).alias("term"), F.when(short, "expanded").when(F.col("term").isin(*pinned), "pinned").otherwise("ranked").alias("reason"), "docs", "score", "domain")
    w = Window.partitionBy("domain").orderBy(F.desc(F.col("reason") == "pinned"), F.desc("score"), F.desc("docs"), "term")
    x = x.withColumn("n", F.row_number().over(w)).where(F.col("n") <= total + look_ahead)

    def caps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(pin=(pdf["reason"] == "pinned").astype(int)).sort_values(["pin", "score", "docs", "term"], ascending=[False, False, False, True])
        out, seen, by = [], set(), {}
        for t, r, d in zip(pdf["term"], pdf["reason"], pdf["domain"], strict=True):
            if len(out) >= total:
                break
            if t in seen or by.get(d, 0) >= per_domain:
                continue
            seen.add(t)
            by[d] = by.get(d, 0) + 1
            out.append((len(out) + 1, t, d, r))
        return pd.DataFrame(out, columns=["pos", "term", "domain", "reason"])

    return x.groupBy(F.lit(0).alias("one")).applyInPandas(lambda pdf: caps(pdf), "pos int, term string, domain string, reason string")


def inventory(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, occurrences, witnesses, artifacts, titles, kinds) of given terms in (doc_id, artifact_id, kind, title, text).

    A witness is a distinct title and text. Terms meet texts by an equi-join on
    lexical tokens; the texts are never the side that is broadcast.
    """
    toks = X.lexical_tokens(F.concat_ws(" ", "title", "text"))
    x = docs.select("doc_id", "artifact_id", "kind", F.md5(F.concat_ws("\u001f", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))).alias("witness"), X.lexical_tokens(F.col("title")).alias("t"), F.explode(toks).alias("term"))
    x = x.join(bounded_broadcast(terms.select(F.lower("term").alias("term")).distinct()), "term")
    return x.groupBy("term").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("witness").alias("witnesses"), F.count_distinct("artifact_id").alias("artifacts"), F.count_distinct(F.when(F.array_contains("t", F.col("term")), F.col("artifact_id"))).alias("titles"), F.count_distinct("kind").alias("kinds"))


def roster(found: DataFrame, least: int, most: int, min_artifacts: int) -> DataFrame:
    """The ``most`` best supported terms; fewer than ``least`` is an error."""
    x = found.where(F.col("artifacts") >= min_artifacts).orderBy(F.desc("artifacts"), F.desc("witnesses"), "term").limit(most)
    n = x.agg(F.count(F.lit(1)).alias("__n"))
    return x.crossJoin(n).withColumn("ok", F.assert_true(F.col("__n") >= least, F.lit("too few terms"))).where("ok is null").drop("ok", "__n")


def keyword_domain(rows: DataFrame, ident: str, text: str, keywords: Mapping[str, Mapping[str, int]], least: int = 4, default: str = "general") -> DataFrame:
    """(ident, domain): the domain of the greatest keyword score if it is ``least`` or more and strictly above the next one."""
    scores = F.array(*[F.struct(X.keyword_score(F.col(text), k).alias("s"), F.lit(d).alias("d")) for d, k in keywords.items()])
    top = F.sort_array(scores, asc=False)
    x = rows.select(ident, top.alias("t"))
    best, second = F.get("t", F.lit(0)), F.coalesce(F.get("t", F.lit(1)).s, F.lit(0))
    return x.select(ident, F.when((best.s >= least) & (best.s > second), best.d).otherwise(default).alias("domain"))


def new_rows(terms: DataFrame, lookup: DataFrame) -> DataFrame:
    """(term, vector): sum of sqrt(count) * row over the pieces (term, piece) of each term; ``lookup`` is (piece, vector)."""
    c = terms.groupBy("term", "piece").agg(F.sqrt(F.count(F.lit(1))).alias("w"))
    x = c.join(lookup, "piece").select("term", "w", F.posexplode("vector").alias("i", "v")).groupBy("term", "i").agg(F.sum(F.col("w") * F.col("v").cast("double")).alias("v"))
    return x.groupBy("term").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda e: e.v).alias("vector"))  # one element a dimension


def split_problems(dev: DataFrame, confirm: DataFrame) -> DataFrame:
    """(problem, value, n): repeated ids, texts and signatures, and those in both splits; empty if the splits are sound."""

    def seen(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array(F.struct(F.lit("id").alias("kind"), F.col("qid").alias("value")), *[F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in (("text", X.fold_case_space(F.col("text"))), ("signature", X.lexical_signature(F.col("text"))), ("family", F.col("family")))])).alias("e")).select("e.kind", "e.value").where("value is not null and value <> ''")

    d, c = seen(dev), seen(confirm)
    rep = d.union(c).where("kind <> 'family'").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.concat(F.lit("repeated_"), "kind").alias("problem"), "value", "n")
    both = d.distinct().join(c.distinct(), ["kind", "value"], "left_semi").select(F.concat(F.lit("shared_"), "kind").alias("problem"), "value", F.lit(2).cast("long").alias("n"))
    return rep.union(both)
