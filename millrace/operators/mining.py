"""Hard negatives and candidate lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import hashing as H

from .fusion import ranked
from .ranking import distributed_row_number


def padded(run: DataFrame, k: int) -> DataFrame:
    """(qid, slot, doc_id): k slots for each query of (qid, doc_id, rank); missing ones repeat the last document."""
    last = Window.partitionBy("qid")
    x = run.withColumn("n", F.max("rank").over(last))
    slots = F.when(F.col("rank") == F.col("n"), F.sequence(F.col("rank"), F.lit(k))).otherwise(F.array("rank"))
    return x.select("qid", F.explode(slots).alias("slot"), "doc_id")


def hard_negatives(run: DataFrame, positives: DataFrame, banned: DataFrame, k: int) -> DataFrame:
    """(qid, slot, doc_id): the k best of the run that are neither positive nor banned, padded with the last."""
    clean = run.select("qid", "doc_id", "score").join(positives.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti").join(banned.select("doc_id").distinct(), "doc_id", "left_anti")
    return padded(ranked(clean).where(F.col("rank") <= k), k)


def fallback_row(docs: DataFrame, banned: DataFrame) -> DataFrame:
    """One row: the smallest document id that is not banned."""
    return docs.select("doc_id").join(banned.select("doc_id"), "doc_id", "left_anti").agg(F.min("doc_id").alias("doc_id"))


def candidate_mix(positives: DataFrame, teacher: DataFrame, second: DataFrame, pool: DataFrame, teacher_k: int, second_k: int, uniform_k: int, seed: str) -> DataFrame:
    """(qid, source, slot, doc_id): one positive, then the best of two runs and uniform draws, all distinct within a query.

    Each list is filled past what earlier lists hold. ``positives`` is (qid,
    doc_id), the smallest counts. Uniform draws come from ``pool`` (doc_id): each
    query scans the pool's seeded order from a start of its own, so only a
    bounded stretch of the pool meets a query.
    """
    first = positives.groupBy("qid").agg(F.min("doc_id").alias("doc_id")).select("qid", F.lit("positive").alias("source"), F.lit(1).alias("slot"), "doc_id")

    def fill(run: DataFrame, have: DataFrame, name: str, k: int) -> DataFrame:
        new = run.select("qid", "doc_id", "score").join(have.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
        return ranked(new).where(F.col("rank") <= k).select("qid", F.lit(name).alias("source"), F.col("rank").alias("slot"), "doc_id")

    got = first.union(fill(teacher.join(first.select("qid"), "qid", "left_semi"), first, "teacher", teacher_k))
    got = got.union(fill(second.join(first.select("qid"), "qid", "left_semi"), got, "second", second_k))
    if uniform_k <= 0:
        return got
    # as many tries as could collide with what is already chosen
    tries = uniform_k + 1 + teacher_k + second_k
    order = distributed_row_number(pool.select("doc_id").distinct().withColumn("h", H.order_key(seed, F.col("doc_id"))), [], [], "h", ["doc_id"])
    size = order.agg(F.count(F.lit(1)).alias("n"))
    q = first.select("qid").crossJoin(F.broadcast(size))  # one row
    start = F.pmod(H.key60(F.concat_ws("|", F.lit(seed), F.col("qid").cast("string"))), F.col("n"))
    q = q.select("qid", F.explode(F.sequence(F.lit(0), F.least(F.lit(tries), F.col("n").cast("int")) - 1)).alias("i"), start.alias("s"), "n")
    drawn = q.select("qid", "i", (F.pmod(F.col("s") + F.col("i"), F.col("n")) + 1).alias("rn")).join(order.select("rn", "doc_id"), "rn")
    return got.union(fill(drawn.select("qid", "doc_id", (-F.col("i")).alias("score")), got, "uniform", uniform_k))


def shortfalls(candidates: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """(source, wanted, filled, short): slots over all queries of ``candidates``."""
    n = candidates.select("qid").distinct().agg(F.count(F.lit(1)).alias("q"))
    spark = candidates.sparkSession
    w = spark.createDataFrame(list(wanted.items()), "source string, k int")
    f = candidates.groupBy("source").agg(F.count(F.lit(1)).alias("filled"))
    return w.crossJoin(F.broadcast(n)).join(f, "source", "left").select("source", (F.col("k") * F.col("q")).alias("wanted"), F.coalesce("filled", F.lit(0)).alias("filled"), (F.col("k") * F.col("q") - F.coalesce("filled", F.lit(0))).alias("short"))


def list_overlap(a: DataFrame, b: DataFrame, depth: int) -> DataFrame:
    """(qid, shared): share of the shorter list, both cut to ``depth``."""
    x, y = (r.where(F.col("rank") <= depth).select("qid", "doc_id") for r in (a, b))
    both = x.join(y, ["qid", "doc_id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    nx, ny = x.groupBy("qid").agg(F.count(F.lit(1)).alias("nx")), y.groupBy("qid").agg(F.count(F.lit(1)).alias("ny"))
    return nx.join(ny, "qid").join(both, "qid", "left").select("qid", F.round(F.coalesce("n", F.lit(0)) / F.least("nx", "ny"), 9).alias("shared"))


def false_negative_mask(candidates: DataFrame, positive_scores: DataFrame, margin: float) -> DataFrame:
    """``masked``: a candidate scores above its query's positive minus the margin."""
    return candidates.join(positive_scores.select("qid", F.col("score").alias("pos")), "qid").withColumn("masked", F.col("score") > F.col("pos") - margin)


def positives_outside(positives: DataFrame, bank: DataFrame) -> DataFrame:
    """(qid, doc_id) of positives that the bank does not hold; the contract is that there are none."""
    return positives.select("qid", "doc_id").join(bank.select("doc_id"), "doc_id", "left_anti").select("qid", "doc_id")


def entropy(candidates: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(qid, entropy, p_max) of the softmax of (qid, score) at a temperature, in nats; null scores are empty slots."""
    w = Window.partitionBy("qid")
    x = candidates.where(F.col("score").isNotNull()).withColumn("e", F.exp((F.col("score") - F.max("score").over(w)) / temperature))
    x = x.withColumn("p", F.col("e") / F.sum("e").over(w))
    return x.groupBy("qid").agg(F.round(-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0)), 9).alias("entropy"), F.round(F.max("p"), 9).alias("p_max"))
