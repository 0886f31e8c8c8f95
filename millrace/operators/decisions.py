"""Decision rules over small tables of results: one row for a test, arm or query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gatekeeping(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(pos, test, verdict) of (pos, test, lower, p): REJECTED while lower > 0 and p <= alpha in order of ``pos``; NOT_REJECTED stops, later ones are NOT_TESTED. A null lower or p is UNSCORABLE and stops too."""
    bad = F.col("lower").isNull() | F.col("p").isNull()
    own = F.when(bad, "UNSCORABLE").when((F.col("lower") > 0) & (F.col("p") <= alpha), "REJECTED").otherwise("NOT_REJECTED")
    x = tests.withColumn("own", own)
    before = F.min((F.col("own") == "REJECTED").cast("int")).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return x.select("pos", "test", F.when(F.coalesce(before, F.lit(1)) == 1, F.col("own")).otherwise("NOT_TESTED").alias("verdict"))


def veto(results: DataFrame, margin: float) -> DataFrame:
    """``vetoed``: both the point and the upper bound are below -margin."""
    return results.withColumn("vetoed", (F.col("delta") < -margin) & (F.col("upper") < -margin))


def family_decision(legs: DataFrame) -> DataFrame:
    """(family, ships, worst): every leg rejected by Holm, with an interval and a corrected bound above 0; the least delta."""
    ok = F.col("rejected") & (F.col("ci_low") > 0) & (F.col("lower") > 0)
    return legs.groupBy("family").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("ships"), F.round(F.min("delta"), 9).alias("worst"))


def no_regression(a: DataFrame, b: DataFrame, margin: float) -> DataFrame:
    """(component, delta, ok) of component means: none falls by more than the margin."""
    j = a.groupBy("component").agg(F.avg("value").alias("x")).join(b.groupBy("component").agg(F.avg("value").alias("y")), "component")
    d = F.col("x") - F.col("y")
    return j.select("component", F.round(d, 9).alias("delta"), (d >= -margin).alias("ok"))


def winner(arms: DataFrame) -> DataFrame:
    """One row: the resolving arm with the greatest estimate; null if none resolves or two tie."""
    r = arms.where("resolves")
    top = r.agg(F.max("estimate").alias("top"))
    return r.crossJoin(F.broadcast(top)).where("estimate = top").agg(F.when(F.count(F.lit(1)) == 1, F.min("arm")).alias("winner"))


def cheapest(arms: DataFrame, preferred: str) -> DataFrame:
    """One row: the arm of least (params, layers), the preferred one first among equals."""
    return arms.agg(F.min_by("arm", F.struct("params", "layers", (F.col("arm") != preferred).alias("o"), "arm")).alias("winner"))


def confirmation_stands(pairs: DataFrame) -> DataFrame:
    """One row of (seed, winner, default_score, fresh): every difference is above 0 and the fresh ones reach half of the others' mean."""
    d = F.col("winner") - F.col("default_score")
    return pairs.agg((F.bool_and(d > 0) & (F.avg(F.when(F.col("fresh"), d)) >= F.avg(F.when(~F.col("fresh"), d)) / 2)).alias("stands"))


def eligibility(checks: DataFrame) -> DataFrame:
    """(eligible, failed): all of (name, value, threshold, strict) hold; names of those that do not, sorted."""
    ok = F.when(F.col("strict"), F.col("value") > F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    ok = F.coalesce(ok, F.lit(False))
    return checks.agg(F.bool_and(ok).alias("eligible"), F.array_join(F.sort_array(F.collect_list(F.when(~ok, F.col("name")))), ",").alias("failed"))


def threshold_status(bounds: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """``status`` of (low, high): robust_pass, robust_fail or label_sensitive."""
    passes = lambda c: F.col(c) > threshold if strict else F.col(c) >= threshold
    return bounds.withColumn("status", F.when(passes("low"), "robust_pass").when(~passes("high"), "robust_fail").otherwise("label_sensitive"))


def label_bounds(items: DataFrame, k: int = 10, max_unknown: int = 20) -> DataFrame:
    """(qid, known, unknown, low, high): attainable precision at k in tenths, exactly, when labels may be null.

    Each null may turn out either way, so the bounds are the known positives and
    those plus all unknown ones. More than ``max_unknown`` unknown is an error.
    """
    top = items.where(F.col("rank") <= k)
    g = top.groupBy("qid").agg(F.count_if(F.col("label") == 1).alias("known"), F.count_if(F.col("label").isNull()).alias("unknown"))
    g = g.withColumn("ok", F.assert_true(F.col("unknown") <= max_unknown, F.lit("too many unknown labels"))).where("ok is null").drop("ok")
    return g.select("qid", "known", "unknown", (F.col("known") * 10 / k).cast("decimal(18,6)").alias("low"), ((F.col("known") + F.col("unknown")) * 10 / k).cast("decimal(18,6)").alias("high"))


def label_states(items: DataFrame, a: str, b: str, k: int = 10, max_unknown: int = 20) -> DataFrame:
    """(qid, state, diff): every assignment of a query's unknown labels and the difference of hits between two rankings in the first k.

    ``items`` is (qid, doc_id, label, rank_a, rank_b). 2^unknown rows a query, at
    most 2^``max_unknown``.
    """
    x = items.withColumn("u", F.when(F.col("label").isNull(), F.row_number().over(Window.partitionBy("qid", F.col("label").isNull()).orderBy("doc_id")) - 1))
    x = x.withColumn("gain", (F.coalesce((F.col(a) <= k).cast("int"), F.lit(0)) - F.coalesce((F.col(b) <= k).cast("int"), F.lit(0))))
    fixed = x.groupBy("qid").agg(F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("gain"))), F.lit(0)).alias("base"), F.count("u").alias("n"), F.map_from_entries(F.collect_list(F.when(F.col("u").isNotNull(), F.struct("u", "gain")))).alias("g"))  # the judged items of a query
    fixed = fixed.withColumn("ok", F.assert_true(F.col("n") <= max_unknown, F.lit("too many unknown labels"))).where("ok is null")
    s = fixed.withColumn("state", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), F.col("n")).cast("long") - 1)))
    add = F.aggregate(F.map_entries("g"), F.lit(0), lambda acc, e: acc + F.when(F.col("state").bitwiseAND(F.pow(F.lit(2), e.key).cast("long")) > 0, e.value).otherwise(0))
    return s.select("qid", "state", (F.col("base") + add).cast("long").alias("diff"))


def contrast_bounds(states: DataFrame) -> DataFrame:
    """One row: the least and the greatest sum over queries, each taking one of its states."""
    return states.groupBy("qid").agg(F.min("diff").alias("lo"), F.max("diff").alias("hi")).agg(F.sum("lo").alias("low"), F.sum("hi").alias("high"))


def kill_rule(evals: DataFrame, drop: float) -> DataFrame:
    """(run, at, reason) of evaluations (run, step, kind, value): the first step at which a run is to be stopped; runs that go on are absent.

    A value that is null or not finite stops at once; else two scheduled
    evaluations in a row, each more than ``drop`` below the best one before of its own kind.
    """
    by = Window.partitionBy("run").orderBy("step")
    kind = Window.partitionBy("run", "kind").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    v = F.col("value")
    broken = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    x = evals.withColumn("broken", broken).withColumn("bad", F.coalesce(~broken & (v < F.max("value").over(kind) - drop), F.lit(False)))
    x = x.withColumn("again", F.col("bad") & F.coalesce(F.lag("bad").over(by), F.lit(False)))
    hit = x.where("broken or again").groupBy("run").agg(F.min(F.struct("step", "broken")).alias("m"))
    return hit.select("run", F.col("m.step").alias("at"), F.when(F.col("m.broken"), "not finite").otherwise("two in a row").alias("reason"))


def plateau_rule(evals: DataFrame, min_gain: float, from_cycle: int) -> DataFrame:
    """(run, at): the first cycle from ``from_cycle`` on whose value gains less than ``min_gain`` over the best before, of (run, cycle, value) with cycles from 1."""
    before = Window.partitionBy("run").orderBy("cycle").rowsBetween(Window.unboundedPreceding, -1)
    x = evals.withColumn("gain", F.col("value") - F.max("value").over(before))
    return x.where((F.col("cycle") >= from_cycle) & (F.col("gain") < min_gain)).groupBy("run").agg(F.min("cycle").alias("at"))
