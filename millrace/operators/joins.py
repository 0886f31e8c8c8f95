"""Join shapes beyond plain equi-joins."""

from __future__ import annotations

import difflib
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X
from millrace.session import salted_join


def with_judgements(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries with at least one judgement."""
    return queries.join(qrels.select("qid").distinct(), "qid", "left_semi")


def resolve(pairs: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """``row_id`` of the pool (keys, row_id) for each pair, null where it is missing."""
    return pairs.join(pool.select(*keys, "row_id"), keys, "left")


def single_label(rows: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label): the one label of each group; two labels in a group are an error."""
    g = rows.where(F.col(label).isNotNull()).groupBy(group).agg(F.min(label).alias(label), F.max(label).alias("__m"))
    ok = F.assert_true(F.col(label) == F.col("__m"), F.lit("a group has two labels"))
    return g.withColumn("ok", ok).where("ok is null").select(group, label)


def role_collisions(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys that occur on both sides."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("collisions"))


def excluded(rows: DataFrame, rules: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """``reason``: the first rule (name, column, excluded values) that holds the row's value, else null."""
    for i, (_, column, values) in enumerate(rules):
        v = values.select(F.col(values.columns[0]).alias(column)).where(F.col(column).isNotNull()).distinct().withColumn(f"__r{i}", F.lit(True))
        rows = rows.join(v, column, "left")
    reason = F.when(F.lit(False), None)
    for i, (name, _, _) in enumerate(rules):
        reason = reason.when(F.col(f"__r{i}"), name)
    return rows.withColumn("reason", reason).drop(*[f"__r{i}" for i in range(len(rules))])


def routed(rows: DataFrame, column: str, routes: Mapping[str, str], default: str | None = None) -> DataFrame:
    """``form``: where the value of a column is sent by a fixed map; ``default`` for others and null."""
    to = F.create_map(*[F.lit(x) for pair in routes.items() for x in pair])
    return rows.withColumn("form", F.coalesce(F.try_element_at(to, F.col(column)), F.lit(default)))


@F.pandas_udf(T.DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * matches / total length of the longest matching blocks."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


def fuzzy_pairs(rows: DataFrame, ident: str, shape: Column, jaccard: float = 0.82, ratio: float = 0.92) -> DataFrame:
    """(a, b) of shapes, a before b: shapes of the same first two words whose words or characters are close.

    Works on distinct shapes, so copies make no pairs; rows of one shape are tied by
    the shape itself. Within a block filters on length and on the letters that both
    have precede the comparison of characters. Shapes are of lower-case letters,
    digits and blanks, as ``title_shape`` gives them.
    """
    letters = "abcdefghijklmnopqrstuvwxyz0123456789 "
    s = rows.select(shape.alias("shape")).where(F.col("shape") != "").distinct().withColumn("w", F.split("shape", " "))
    counts = F.array(*[F.length("shape") - F.length(F.replace("shape", F.lit(c), F.lit(""))) for c in letters])
    s = s.withColumns({"block": F.array_join(F.slice("w", 1, 2), " "), "n": F.length("shape"), "l": counts})
    a, b = (s.select(F.col("shape").alias(x), F.col("w").alias(f"w{x}"), "block", F.col("n").alias(f"n{x}"), F.col("l").alias(f"l{x}")) for x in "ab")
    j = salted_join(a, b, ["block"], ["a"]).where("a < b")  # a common opening is no one task's
    jac = F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))
    # matching blocks can't be longer than the letters that both have
    common = F.aggregate(F.zip_with("la", "lb", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    close = 2 * common / (F.col("na") + F.col("nb")) >= ratio - 1e-12
    by_words = j.where(jac >= jaccard).select("a", "b")
    by_chars = j.where((jac < jaccard) & (2 * F.least("na", "nb") / (F.col("na") + F.col("nb")) >= ratio)).where(close).where(match_ratio("a", "b") >= ratio).select("a", "b")
    return by_words.union(by_chars)


def label_resolution(pool: DataFrame, primary: DataFrame, auditor: DataFrame) -> DataFrame:
    """(item_id, label, status): both agree or only one label: known; they differ or one is null: unknown, label null."""
    p, a = primary.select("item_id", F.col("label").alias("p"), F.lit(True).alias("hp")), auditor.select("item_id", F.col("label").alias("a"), F.lit(True).alias("ha"))
    j = pool.select("item_id").distinct().join(p, "item_id", "left").join(a, "item_id", "left")
    known = F.col("p").isNotNull() & (F.col("ha").isNull() | F.col("p").eqNullSafe(F.col("a")))
    return j.select("item_id", F.when(known, F.col("p")).alias("label"), F.when(known, "known").otherwise("unknown").alias("status"))


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side only."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("missing")).union(y.exceptAll(x).withColumn("side", F.lit("extra")))


def thread_links(rows: DataFrame, ident: str, text: str, pattern: str) -> DataFrame:
    """(ident, target): what the first group of the pattern matches in each URL."""
    return rows.select(ident, F.explode(X.urls(F.col(text))).alias("u")).select(ident, F.regexp_extract("u", pattern, 1).alias("target")).where("target <> ''").distinct()
