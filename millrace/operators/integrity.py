"""Constraints as queries that return violations, and content-addressed increments."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def constraint_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of every rule in one pass; a null result violates."""
    one = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("e")).select("e.*")


def screened(df: DataFrame, predicates: Mapping[str, Callable[[DataFrame], Column]]) -> DataFrame:
    """``rejected``: the name of the first predicate of the caller that holds for a row, else null; a null result does not hold."""
    out = F.when(F.lit(False), None)
    for name, holds in predicates.items():
        out = out.when(F.coalesce(holds(df), F.lit(False)), name)
    return df.withColumn("rejected", out)


def config_differences(arms: DataFrame, base: str, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(arm, key, value, base_value) of (arm, key, value) where an arm differs from the base on a key that may not."""
    b = arms.where(F.col("arm") == base).select("key", F.col("value").alias("base_value"))
    a = arms.where(F.col("arm") != base)
    names = a.select("arm").distinct()
    full = names.crossJoin(F.broadcast(b))  # keys of one configuration
    j = a.join(full, ["arm", "key"], "full")
    out = j.where(~F.col("value").eqNullSafe(F.col("base_value")) & ~F.col("key").isin(*allowed))
    return out.select("arm", "key", "value", "base_value")


def missing_rows(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct keys that a content-addressed table does not hold yet."""
    return wanted.where(F.col(key).isNotNull()).dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def reconcile(stored: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """(key, status): same, changed, gone or new, by the key and a content hash; changed bodies are tolerated and shown."""
    s, n = stored.select(key, F.col("content_sha").alias("a"), F.lit(1).alias("ha")), listed.select(key, F.col("content_sha").alias("b"), F.lit(1).alias("hb"))
    j = s.join(n, key, "full")
    return j.select(key, F.when(F.col("ha").isNull(), "new").when(F.col("hb").isNull(), "gone").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed").alias("status"))


def projection(done_rows: int, seconds: float, total_rows: int, least: int, cap_seconds: float) -> float | None:
    """Seconds until all rows are done at the present rate, null before ``least`` rows; above the cap it raises."""
    if done_rows < least or seconds <= 0:
        return None
    left = (total_rows - done_rows) * seconds / done_rows
    if seconds + left > cap_seconds:
        raise TimeoutError(f"{seconds + left:.0f} s projected, {cap_seconds:.0f} allowed")
    return left


def ledger_chain(events: DataFrame) -> DataFrame:
    """(seq, ok) of a ledger (seq, payload, previous_sha, sha): each row names the hash of the one before, the first names ''."""
    own = F.sha2(F.concat_ws("|", "previous_sha", "payload"), 256) == F.col("sha")
    before = events.select((F.col("seq") + 1).alias("seq"), F.col("sha").alias("__p"))
    j = events.join(before, "seq", "left")
    return j.select("seq", (own & (F.coalesce("__p", F.lit("")) == F.col("previous_sha"))).alias("ok"))


def access_counts(events: DataFrame, subject: str) -> DataFrame:
    """(subject, looks, arms): how often each protected set was looked at and by how many arms."""
    return events.groupBy(subject).agg(F.count(F.lit(1)).alias("looks"), F.count_distinct("arm").alias("arms"))
