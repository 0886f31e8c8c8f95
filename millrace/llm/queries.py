"""The pN_ queries: each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import spread, table

from . import leakage, look_alikes, mixing, neighbours, related_splits, stable_sample, term_frequency, tokens, top_items

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return related_splits.tied_pairs(table(spark, d, "query_spec"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return related_splits.split_records(table(spark, d, "query_spec"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, d, "bank"))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "bank"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return top_items.top_banked(table(spark, d, "scored_point"), table(spark, d, "bank")).select("system", "qid", "doc_id")


def p3_top(spark: SparkSession, d: str) -> DataFrame:
    return top_items.top_banked(table(spark, d, "scored_point"), table(spark, d, "bank"))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return stable_sample.stable_sample(table(spark, d, "query_spec"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return term_frequency.marked_terms(table(spark, d, "term_stat"))


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_frequency.term_frequency(table(spark, d, "term_stat")).drop("doc_reports", "context_reports")


def p5_reports(spark: SparkSession, d: str) -> DataFrame:
    """Each element once for each shard that reported it."""
    return term_frequency.term_frequency(table(spark, d, "term_stat")).select("term", "docs", "contexts", "doc_reports", "context_reports")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.overdrawn(table(spark, d, "query_spec"), table(spark, d, "run_cfg"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixed_runs(table(spark, d, "query_spec"), table(spark, d, "run_cfg"))


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_shares(_mix(spark, d)[1]).withColumnsRenamed({"mix": "run_id", "source": "bucket"})


def p6_draws(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_draws(*_mix(spark, d)).withColumnsRenamed({"mix": "run_id", "source": "bucket"})


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(spread(table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(spread(table(spark, d, "documents")), table(spark, d, "eval_item"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alikes.same_looking(spread(table(spark, d, "documents")))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents")).select("doc_id", "text")
    return look_alikes.consistent_texts(docs).select("doc_id", F.col("form").alias("text"))


def queries() -> dict[str, Query]:
    found = [p1_found, p1_splits, p2_found, p2_neighbours, p3_found, p3_top, p4_sample, p5_found, p5_terms, p5_reports, p6_found, p6_shares, p6_draws, p7_ids, p8_found, p9_found, p9_forms]
    return {f.__name__: f for f in found}
