"""Ranking metrics per query and their roll-ups.

Runs carry (qid, doc_id, rank), judgements (qid, doc_id, grade). A document
without a judgement has grade 0; a query without a run scores 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import hashing as H

from .ranking import range_numbers


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10, deep: int = 100, digits: int = 9) -> DataFrame:
    """(qid, ndcg, recall, recall_deep, mrr, precision, success) of every judged query with a positive grade.

    nDCG has linear gain and its ideal from all judgements; precision divides by
    k always; success looks at half of k.
    """
    ideal = qrels.where("grade > 0").withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "doc_id")))
    ideal = ideal.groupBy("qid").agg(F.sum(F.when(F.col("i") <= k, F.col("grade") / F.log2(F.col("i") + 1))).alias("idcg"), F.count(F.lit(1)).alias("relevant"))
    hit = run.where(F.col("rank") <= deep).join(qrels.where("grade > 0"), ["qid", "doc_id"])
    top = F.col("rank") <= k
    got = hit.groupBy("qid").agg(
        F.sum(F.when(top, F.col("grade") / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.count_if(top).alias("n"),
        F.count(F.lit(1)).alias("n_deep"),
        F.min(F.when(top, F.col("rank"))).alias("first"),
    )
    x = ideal.join(got, "qid", "left")
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), digits)
    return x.select(
        "qid",
        z(F.col("dcg") / F.col("idcg")).alias("ndcg"),
        z(F.col("n") / F.col("relevant")).alias("recall"),
        z(F.col("n_deep") / F.col("relevant")).alias("recall_deep"),
        z(1 / F.col("first")).alias("mrr"),
        z(F.col("n") / F.lit(float(k))).alias("precision"),
        F.coalesce((F.col("first") <= k // 2).cast("int"), F.lit(0)).alias("success"),
    )


def macro(scores: DataFrame, component: str, value: str, digits: int = 9) -> DataFrame:
    """One row: the mean of the components' means. Components weigh the same whatever their size."""
    return scores.groupBy(component).agg(F.avg(value).alias("m")).agg(F.round(F.avg("m"), digits).alias("macro"), F.count(F.lit(1)).alias("components"))


def subset_macro(scores: DataFrame, component: str, value: str, named: Sequence[str], digits: int = 9) -> DataFrame:
    """``macro`` over the named components that have scores; null with 0 components if none has."""
    return macro(scores.where(F.col(component).isin(*named)), component, value, digits)


def half_macros(scores: DataFrame, component: str, value: str, digits: int = 9) -> DataFrame:
    """(half, macro, components): ``macro`` over the queries of each half, by the parity of the hash of the qid."""
    m = scores.groupBy(H.half(F.col("qid").cast("string")).alias("half"), component).agg(F.avg(value).alias("m"))
    return m.groupBy("half").agg(F.round(F.avg("m"), digits).alias("macro"), F.count(F.lit(1)).alias("components"))


def family_macro(scores: DataFrame, units: DataFrame, value: str, digits: int = 9) -> DataFrame:
    """One row: families weigh the same, units the same within a family. ``units`` is (unit, family); a unit without scores or without a family is an error."""
    per_unit = scores.groupBy("unit").agg(F.avg(value).alias("m"))
    both = per_unit.join(units, "unit", "full")
    ok = F.assert_true(F.col("m").isNotNull() & F.col("family").isNotNull(), F.lit("units of scores and of families differ"))
    return both.select("family", "m", ok.alias("ok")).where("ok is null").groupBy("family").agg(F.avg("m").alias("f")).agg(F.round(F.avg("f"), digits).alias("macro"), F.count(F.lit(1)).alias("families"))


def stratum_aggregate(scores: DataFrame, stratum: str, value: str, digits: int = 9) -> DataFrame:
    """(stratum, mean, n) and two further rows, the mean over all queries ('*query') and over strata ('*macro')."""
    by = scores.groupBy(F.col(stratum).cast("string").alias("stratum")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    overall = scores.agg(F.lit("*query").alias("stratum"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    over = by.agg(F.lit("*macro").alias("stratum"), F.avg("mean").alias("mean"), F.count(F.lit(1)).alias("n"))
    return by.union(overall).union(over).withColumn("mean", F.round("mean", digits))


def overlap(a: DataFrame, b: DataFrame, k: int = 10, digits: int = 9) -> DataFrame:
    """One row: the mean share of the first k that two runs have in common."""
    x, y = (r.where(F.col("rank") <= k).select("qid", "doc_id") for r in (a, b))
    both = x.join(y, ["qid", "doc_id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    q = x.select("qid").union(y.select("qid")).distinct()
    return q.join(both, "qid", "left").agg(F.round(F.avg(F.coalesce("n", F.lit(0)) / k), digits).alias("overlap"), F.count(F.lit(1)).alias("queries"))


def spearman(a: DataFrame, b: DataFrame, digits: int = 9) -> DataFrame:
    """(qid, shared, rho): rank correlation among the documents both runs hold, at least 2."""
    j = a.select("qid", "doc_id", F.col("rank").alias("ra")).join(b.select("qid", "doc_id", F.col("rank").alias("rb")), ["qid", "doc_id"])
    # a query's list may be of any size: ranks among the shared documents come from ranges
    j = range_numbers(j, ["qid"], [F.col("qid"), F.col("ra"), F.col("doc_id")], "xa")
    j = range_numbers(j, ["qid"], [F.col("qid"), F.col("rb"), F.col("doc_id")], "xb")
    return j.groupBy("qid").agg(F.count(F.lit(1)).alias("shared"), F.round(F.corr(F.col("xa").cast("double"), F.col("xb").cast("double")), digits).alias("rho")).where("shared >= 2")


def unjudged(run: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(qid, doc_id) of the first k that have no judgement; empty when the coverage contract holds."""
    return run.where(F.col("rank") <= k).select("qid", "doc_id").join(judged.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")


def with_missing(scores: DataFrame, queries: DataFrame, value: str) -> DataFrame:
    """A score for every query: 0 where there is none. A value outside [0, 1] is an error."""
    x = queries.select("qid").distinct().join(scores.select("qid", value), "qid", "left").withColumn(value, F.coalesce(value, F.lit(0.0)))
    return x.withColumn("ok", F.assert_true(F.col(value).between(0.0, 1.0))).where("ok is null").drop("ok")


def retention(scores: DataFrame, system: str, teacher: str, groups: DataFrame) -> DataFrame:
    """(group, retention): macro of a system over macro of the teacher for (group, component); null if their components differ."""
    m = scores.groupBy("system", "component").agg(F.avg("value").alias("m"))
    s = m.where(F.col("system") == system).select("component", F.col("m").alias("s"))
    t = m.where(F.col("system") == teacher).select("component", F.col("m").alias("t"))
    j = groups.join(s, "component", "left").join(t, "component", "left")
    return j.groupBy("group").agg(F.round(F.when(F.count_if(F.col("s").isNull() | F.col("t").isNull()) == 0, F.try_divide(F.avg("s"), F.avg("t"))), 9).alias("retention"))
