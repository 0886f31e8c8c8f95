"""Ranking, truncation, fusion of runs and collapse of passages.

A run is (qid, doc_id, score). Every rank is by score descending, then doc_id.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import hashing as H
from millrace.session import salted_join

from .ranking import range_numbers


def ranked(run: DataFrame, group: str = "qid", item: str = "doc_id") -> DataFrame:
    """The run with ``rank`` from 1 within each query."""
    return run.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), F.col(item))))


def truncate(run: DataFrame, depth: int, group: str = "qid", item: str = "doc_id") -> DataFrame:
    """The best ``depth`` of each query; Spark cuts each partition before the shuffle."""
    return ranked(run, group, item).where(F.col("rank") <= depth)


def _union(runs: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, run in runs.items():
        x = run.select(F.lit(name).alias("route"), "qid", "doc_id", F.col("score").cast("double").alias("score"))
        out = x if out is None else out.unionByName(x)
    return out


def _fused(parts: DataFrame, value: Column, depth: int | None = None) -> DataFrame:
    out = parts.groupBy("qid", "doc_id").agg(F.round(F.sum(value), 12).alias("score"))
    return ranked(out) if depth is None else truncate(out, depth)


def _by_route(runs: Mapping[str, DataFrame], depth: int | None = None) -> DataFrame:
    """``pos`` of each row in its route and query; with ``depth`` only the first ones, which Spark cuts before the shuffle. Without, a query's run may be of any size."""
    if depth is None:
        return range_numbers(_union(runs), ["route", "qid"], [F.col("route"), F.col("qid"), F.desc("score"), F.col("doc_id")], "pos")
    w = Window.partitionBy("route", "qid").orderBy(F.desc("score"), "doc_id")
    return _union(runs).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= depth)


def _weight(weights: Mapping[str, float] | None, names: list[str]) -> Column:
    out = F.when(F.lit(False), 0.0)
    for n in names:
        out = out.when(F.col("route") == n, float((weights or {}).get(n, 1.0)))
    return out


def rrf(runs: Mapping[str, DataFrame], k: int = 60, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion: sum of w / (k + rank), rank from 1."""
    return _fused(_by_route(runs), _weight(weights, list(runs)) / (k + F.col("pos")))


def rrf_server(runs: Mapping[str, DataFrame], k: int = 2, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion as servers write it: 1 / ((position + 1) / w + k - 1), position from 0; w <= 0 adds nothing. k must be above 0."""
    if k <= 0:
        raise ValueError("k must be positive")
    w = _weight(weights, list(runs))
    return _fused(_by_route(runs), F.when(w > 0, 1.0 / (F.col("pos") / w + (k - 1))).otherwise(0.0))


def dbsf_normalized(parts: DataFrame, by: list[str]) -> DataFrame:
    """``norm``: (score - (mean - 3 sd)) / (6 sd) with the sample deviation; 0.5 for one score or equal scores. Not clamped."""
    w = Window.partitionBy(*by)
    flat = (F.min("score").over(w) == F.max("score").over(w)) | (F.count(F.lit(1)).over(w) < 2)
    mean, sd = F.avg("score").over(w), F.stddev_samp("score").over(w)
    return parts.withColumn("norm", F.when(flat, 0.5).otherwise((F.col("score") - (mean - 3 * sd)) / (6 * sd)))


def dbsf(runs: Mapping[str, DataFrame], prefetch: int = 100) -> DataFrame:
    """Distribution-based fusion: each run is cut to ``prefetch`` first, then normalised; an absent document adds 0."""
    return _fused(dbsf_normalized(_by_route(runs, prefetch), ["route", "qid"]), F.col("norm"))


def min_max(parts: DataFrame, eps: float, floor_zero: bool = False) -> DataFrame:
    """``norm``: (score - lo) / (hi - lo + eps) within each route and query; lo is 0 with ``floor_zero``."""
    # a query may hold very many rows: its bounds are aggregated and joined back, not windowed
    bounds = parts.groupBy("route", "qid").agg(F.min("score").alias("__lo"), F.max("score").alias("__hi"))
    lo = F.lit(0.0) if floor_zero else F.col("__lo")
    return salted_join(parts, bounds, ["route", "qid"], ["doc_id"]).withColumn("norm", (F.col("score") - lo) / (F.col("__hi") - lo + eps)).drop("__lo", "__hi")


def convex(a: DataFrame, b: DataFrame, w: float = 0.5, eps: float = 1e-9, floor_zero: bool = False) -> DataFrame:
    """w * a + (1 - w) * b of min-max normalised scores."""
    parts = min_max(_union({"a": a, "b": b}), eps, floor_zero)
    return _fused(parts, F.when(F.col("route") == "a", w).otherwise(1 - w) * F.col("norm"))


def linear_hybrid(a: DataFrame, b: DataFrame, w_a: float = 0.7, w_b: float = 0.3, eps: float = 1e-8) -> DataFrame:
    """Weighted sum of min-max normalised scores."""
    return _fused(min_max(_union({"a": a, "b": b}), eps), F.when(F.col("route") == "a", w_a).otherwise(w_b) * F.col("norm"))


def rrf_grid(a: DataFrame, b: DataFrame, ks: tuple[int, ...] = (10, 20, 30, 60, 100), weights: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)) -> DataFrame:
    """(k, w, grid_pos, qid, doc_id, score, rank): every setting of the grid in one pass over both runs."""
    spark = a.sparkSession
    grid = spark.createDataFrame([(i, k, w) for i, (k, w) in enumerate((k, w) for k in ks for w in weights)], "grid_pos int, k int, w double")
    parts = _by_route({"a": a, "b": b}).join(F.broadcast(grid))  # the grid is fixed
    value = F.when(F.col("route") == "a", F.col("w")).otherwise(1 - F.col("w")) / (F.col("k") + F.col("pos"))
    fused = parts.groupBy("grid_pos", "k", "w", "qid", "doc_id").agg(F.round(F.sum(value), 12).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("grid_pos", "qid").orderBy(F.desc("score"), "doc_id")))


def select_setting(macro: DataFrame) -> DataFrame:
    """The row of (grid_pos, k, w, macro) with the best macro; exact ties prefer w = 1, then the grid order."""
    return macro.orderBy(F.desc("macro"), F.desc(F.col("w") == 1.0), "grid_pos").limit(1)


def split_half(scores: DataFrame, prefer: Column | None = None) -> DataFrame:
    """(fitted_on, grid_pos, fitted, scored) of (grid_pos, qid, value): the setting that is best on one half of the queries, and its mean on the other.

    Halves are the parity of the hash of a query's id. Means weigh queries the
    same; equal settings go to the preferred, then to the smaller position.
    """
    x = scores.withColumn("half", H.half(F.col("qid").cast("string")))
    m = x.groupBy("half", "grid_pos").agg(F.round(F.avg("value"), 9).alias("m"))
    first = F.coalesce(prefer.cast("int"), F.lit(0)) if prefer is not None else F.lit(0)
    best = m.groupBy("half").agg(F.max_by(F.struct("grid_pos", "m"), F.struct("m", first.alias("p"), (-F.col("grid_pos")).alias("o"))).alias("b"))
    other = m.select((1 - F.col("half")).alias("half"), F.col("grid_pos").alias("g"), F.col("m").alias("scored"))
    j = best.select("half", F.col("b.grid_pos").alias("grid_pos"), F.col("b.m").alias("fitted"))
    return j.join(other, (j.half == other.half) & (F.col("grid_pos") == F.col("g")), "left").select(j.half.alias("fitted_on"), "grid_pos", "fitted", "scored")


def collapse_passages(scores: DataFrame, passages: DataFrame, excluded_artifacts: DataFrame | None = None, excluded_hashes: DataFrame | None = None, passage_depth: int = 500, artifact_depth: int = 100) -> DataFrame:
    """(qid, artifact_id, passage_id, score, rank): the best passage of each artifact.

    ``scores`` is (qid, passage_id, score), ``passages`` (passage_id, artifact_id,
    text_hash). Excluded artifacts and copies of excluded texts, (qid,
    artifact_id) and (qid, text_hash), leave before the cut to ``passage_depth``.
    """
    x = scores.join(passages, "passage_id")
    if excluded_artifacts is not None:
        x = x.join(excluded_artifacts.select("qid", "artifact_id"), ["qid", "artifact_id"], "left_anti")
    if excluded_hashes is not None:
        x = x.join(excluded_hashes.select("qid", "text_hash"), ["qid", "text_hash"], "left_anti")
    top = truncate(x, passage_depth, item="passage_id").drop("rank")
    best = Window.partitionBy("qid", "artifact_id").orderBy(F.desc("score"), "passage_id")
    one = top.withColumn("n", F.row_number().over(best)).where("n = 1")
    return truncate(one.select("qid", "artifact_id", "passage_id", "score"), artifact_depth, item="artifact_id")


def dbsf_artifacts(routes: DataFrame, limit: int = 10, artifact_depth: int = 100) -> DataFrame:
    """(qid, artifact_id, score, rank, support) from (route, qid, artifact_id, passage_id, score).

    ``support`` lists route, raw score, contribution and passage of each route
    that holds the artifact, by route.
    """
    w = Window.partitionBy("route", "qid").orderBy(F.desc("score"), "artifact_id")
    cut = routes.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= artifact_depth)
    n = dbsf_normalized(cut, ["route", "qid"])
    s = F.struct("route", F.col("score").alias("raw"), F.round("norm", 9).alias("contribution"), "passage_id")
    fused = n.groupBy("qid", "artifact_id").agg(F.round(F.sum("norm"), 12).alias("score"), F.sort_array(F.collect_list(s)).alias("support"))  # one element a route
    return truncate(fused, limit, item="artifact_id")


def exclude_sources(run: DataFrame, query_sources: DataFrame, doc_objects: DataFrame) -> DataFrame:
    """The run without any unit of the query's own object: (qid, object_id) against (doc_id, object_id).

    The rows of the run get the objects of their unit, which are few; a query's
    object is never spread to all its units, as it may have any number of them.
    """
    of = run.select("qid", "doc_id").join(doc_objects.select("doc_id", "object_id"), "doc_id")
    own = of.join(query_sources.select("qid", "object_id"), ["qid", "object_id"], "left_semi").select("qid", "doc_id")
    return run.join(own, ["qid", "doc_id"], "left_anti")


def rank_comparison(a: DataFrame, b: DataFrame, cut: int = 10) -> DataFrame:
    """One row comparing two runs: queries whose order or set changes in the first ``cut`` and the greatest difference of a score."""
    x = a.where(F.col("rank") <= cut).select("qid", "rank", F.col("doc_id").alias("da"), F.col("score").alias("sa"))
    y = b.where(F.col("rank") <= cut).select("qid", "rank", F.col("doc_id").alias("db"), F.col("score").alias("sb"))
    order = x.join(y, ["qid", "rank"], "full").groupBy("qid").agg(F.max((~F.col("da").eqNullSafe(F.col("db"))).cast("int")).alias("moved"), F.max(F.abs(F.col("sa") - F.col("sb"))).alias("dev"))
    sets = x.select("qid", F.col("da").alias("d"), F.lit(1).alias("a")).join(y.select("qid", F.col("db").alias("d"), F.lit(1).alias("b")), ["qid", "d"], "full")
    sets = sets.groupBy("qid").agg(F.max((F.col("a").isNull() | F.col("b").isNull()).cast("int")).alias("differ"))
    return order.join(sets, "qid").agg(F.count(F.lit(1)).alias("queries"), F.sum("moved").alias("order_changes"), F.sum("differ").alias("set_changes"), F.max("dev").alias("max_score_dev"))
