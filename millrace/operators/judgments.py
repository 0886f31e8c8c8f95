"""Judgement pools, audits, agreement and frozen labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import hashing as H

from .ranking import distributed_row_number

TOP, PASSAGES, TEXT_CHARS = 10, 3, 1200


def pool(routes: DataFrame, cap: int | None = None, top: int = TOP) -> DataFrame:
    """(item_id, qid, artifact_id, routes, best_rank): distinct artifacts of the first ``top`` of all routes (route, qid, artifact_id, rank), with the routes that hold them. More than ``cap`` items is an error."""
    g = routes.where(F.col("rank") <= top).groupBy("qid", "artifact_id").agg(F.array_join(F.sort_array(F.collect_set("route")), ",").alias("routes"), F.min("rank").alias("best_rank"))
    g = g.select(F.substring(F.sha2(F.concat_ws("|", F.col("qid").cast("string"), F.col("artifact_id").cast("string")), 256), 1, 24).alias("item_id"), "*")
    if cap is not None:
        n = g.agg(F.count(F.lit(1)).alias("__n"))
        g = g.crossJoin(F.broadcast(n)).withColumn("ok", F.assert_true(F.col("__n") <= cap, F.lit("the pool is above its cap"))).where("ok is null").drop("ok", "__n")
    return g


def evidence(passages: DataFrame, most: int = PASSAGES, chars: int = TEXT_CHARS) -> DataFrame:
    """(qid, artifact_id, slot, passage_id, text, text_sha): the best ``most`` passages by least rank over routes, then id; texts cut."""
    best = passages.groupBy("qid", "artifact_id", "passage_id").agg(F.min("rank").alias("r"), F.max("text").alias("text"))
    w = Window.partitionBy("qid", "artifact_id").orderBy("r", "passage_id")
    x = best.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= most)
    return x.select("qid", "artifact_id", "slot", "passage_id", F.substring("text", 1, chars).alias("text"), F.sha2("text", 256).alias("text_sha"))


def blinded(packet: DataFrame, forbidden: tuple[str, ...] = ("route", "routes", "rank", "best_rank", "score", "system")) -> DataFrame:
    """The packet; a column that shows where an item comes from is an error."""
    bad = sorted(set(packet.columns) & set(forbidden))
    if bad:
        raise ValueError(f"the packet shows {bad}")
    return packet


def presentation_order(packet: DataFrame, seed: str) -> DataFrame:
    """``key``: the order in which items are shown."""
    return packet.withColumn("key", H.order_key(seed, F.col("item_id")))


def audit_sample(items: DataFrame, fraction_percent: int = 20, seed: str = "audit") -> DataFrame:
    """(item_id, reason) of (item_id, qid, term, label): all that are not 0, one negative for each query and each term, then negatives in seeded order up to the fraction."""
    neg = items.where("label = 0").withColumn("h", H.order_key(seed, F.col("item_id")))
    first = lambda c: neg.groupBy(c).agg(F.min(F.struct("h", "item_id")).alias("m")).select("m.item_id")
    must = items.where("label is null or label <> 0").select("item_id", F.lit("label").alias("reason"))
    cover = first("qid").union(first("term")).distinct().select("item_id", F.lit("cover").alias("reason"))
    base = must.union(cover)
    total = items.agg(F.ceil(F.count(F.lit(1)) * fraction_percent / 100).alias("target"))
    have = base.agg(F.count(F.lit(1)).alias("have"))
    rest = neg.join(base.select("item_id"), "item_id", "left_anti")
    r = distributed_row_number(rest.select("item_id", "h"), [], [], "h", ["item_id"])
    fill = r.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(have)).where(F.col("rn") <= F.col("target") - F.col("have")).select("item_id", F.lit("fill").alias("reason"))
    return base.union(fill)


def agreement(primary: DataFrame, auditor: DataFrame, least: float = 0.90) -> DataFrame:
    """One row: (audited, agreements, rate, ok) over the audited items; an audited item without a primary label is an error."""
    j = auditor.select("item_id", F.col("label").alias("a")).join(primary.select("item_id", F.col("label").alias("p"), F.lit(1).alias("h")), "item_id", "left")
    j = j.withColumn("ok", F.assert_true(F.col("h").isNotNull(), F.lit("an audited item has no primary label"))).where("ok is null")
    same = F.col("a").eqNullSafe(F.col("p"))
    return j.agg(F.count(F.lit(1)).alias("audited"), F.count_if(same).alias("agreements"), F.round(F.avg(same.cast("double")), 9).alias("rate"), (F.avg(same.cast("double")) >= least).alias("ok"))


def freeze_labels(primary: DataFrame, auditor: DataFrame, adjudicated: DataFrame, reviewers: tuple[str, str], authors: DataFrame) -> DataFrame:
    """(item_id, label): adjudicated where the two differ or the primary is null, else the primary.

    The adjudicated items must be exactly those; reviewers must differ from each
    other and from all authors; every final label must be 0 or 1.
    """
    if reviewers[0] == reviewers[1]:
        raise ValueError("the two reviewers are one person")
    clash = authors.where(F.col("author").isin(*reviewers)).limit(1).count()
    if clash:
        raise ValueError("a reviewer wrote one of the queries")
    j = primary.select("item_id", F.col("label").alias("p")).join(auditor.select("item_id", F.col("label").alias("a"), F.lit(1).alias("ha")), "item_id", "left")
    j = j.join(adjudicated.select("item_id", F.col("label").alias("d"), F.lit(1).alias("hd")), "item_id", "full")
    open_ = F.col("p").isNull() | (F.col("ha").isNotNull() & ~F.col("p").eqNullSafe(F.col("a")))
    label = F.when(open_, F.col("d")).otherwise(F.col("p"))
    ok = F.assert_true((open_ == F.col("hd").isNotNull()) & F.coalesce(label.isin(0, 1), F.lit(False)), F.lit("adjudications do not cover exactly what is open"))
    return j.withColumn("label", label).withColumn("ok", ok).where("ok is null").select("item_id", "label")


def align_sheet(sheet: DataFrame, rows: DataFrame, ident: str) -> DataFrame:
    """Rows with the sheet's judgement of the same line; an id that differs at its line is an error."""
    j = rows.select("line", F.col(ident).alias("__r")).join(sheet.select("line", F.col(ident).alias("__s"), "judgement"), "line", "full")
    ok = F.assert_true(F.col("__r").eqNullSafe(F.col("__s")), F.lit("sheet and rows differ"))
    return j.withColumn("ok", ok).where("ok is null").select(F.col("__r").alias(ident), "judgement")


def newest_per_family(rows: DataFrame, family: str, stratum: str, time: str, ident: str, cap: int) -> DataFrame:
    """The newest row of each family, then the newest ``cap`` of each stratum."""
    w = Window.partitionBy(family).orderBy(F.desc_nulls_last(time), F.desc(ident))
    one = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    s = Window.partitionBy(stratum).orderBy(F.desc_nulls_last(time), F.desc(ident))
    return one.withColumn("__n", F.row_number().over(s)).where(F.col("__n") <= cap).drop("__n")


def apply_adjudications(rows: DataFrame, decisions: DataFrame, ident: str, content: Column) -> DataFrame:
    """Rows decided 'clear'. Decisions must cover the rows exactly, and their content hash must still be the row's."""
    j = rows.withColumn("__h", F.sha2(content, 256)).withColumn("__r", F.lit(1)).join(decisions.select(ident, "decision", "content_sha"), ident, "full")
    ok = F.assert_true(F.col("__r").isNotNull() & F.col("decision").isNotNull() & F.col("__h").eqNullSafe(F.col("content_sha")), F.lit("decisions are missing, extra or stale"))
    return j.withColumn("ok", ok).where("ok is null and decision = 'clear'").select(*rows.columns)
