"""Roll-ups, votes, fits and variance components as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import stage


def term_rollup(scores: DataFrame, metrics: list[str], term: str = "term") -> DataFrame:
    """(metric, macro, terms): the mean over terms of the means within a term; no rows in, an error."""
    per = scores.groupBy(term).agg(*[F.avg(m).alias(m) for m in metrics])
    one = per.agg(F.count(F.lit(1)).alias("terms"), *[F.round(F.avg(m), 9).alias(m) for m in metrics])
    ok = F.assert_true(F.col("terms") > 0, F.lit("no rows to roll up"))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("macro")) for m in metrics])
    return one.withColumn("ok", ok).where("ok is null").select(F.explode(pairs).alias("p"), "terms").select("p.metric", "p.macro", "terms")


def quantiles(df: DataFrame, value: str, qs: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """(q, value): exact quantiles with linear interpolation."""
    arr = df.agg(F.percentile(value, F.array(*[F.lit(q) for q in qs])).alias("v"))
    return arr.select(F.explode(F.arrays_zip(F.array(*[F.lit(q) for q in qs]).alias("q"), F.col("v").alias("v"))).alias("z")).select(F.col("z.q").alias("q"), F.round("z.v", 9).alias("value"))


def order_statistic(df: DataFrame, value: str, q: float) -> DataFrame:
    """(value, previous): the ceil(q * n)-th smallest value and the one before it; the inverted distribution function.

    Values are counted, cut into ranges of their order, and numbered by range with
    offsets, so no task gets all distinct values.
    """
    spark = df.sparkSession
    n = df.agg(F.count(value).alias("n"))
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = stage(counts.repartitionByRange(width, "v").withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = ranges.groupBy("part").agg(F.sum("c").alias("s")).withColumn("off", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    cum = ranges.join(F.broadcast(offsets), "part").withColumn("cum", F.col("off") + F.sum("c").over(Window.partitionBy("part").orderBy("v")))  # one row a range
    total = cum.crossJoin(F.broadcast(n))  # one row
    at = F.greatest(F.lit(1), F.ceil(F.col("n") * q))
    return total.agg(F.min(F.when(F.col("cum") >= at, F.col("v"))).alias("value"), F.min(F.when(F.col("cum") >= at - 1, F.col("v"))).alias("previous"))


def top_grams(rows: DataFrame, grams: Column, k: int) -> DataFrame:
    """(pos, gram, n): the k most frequent grams of an array column, equal ones by gram; fewer than k distinct grams are an error."""
    c = rows.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    best = c.orderBy(F.desc("n"), "gram").limit(k)
    have = best.agg(F.count(F.lit(1)).alias("have"))
    x = best.crossJoin(F.broadcast(have)).withColumn("ok", F.assert_true(F.col("have") == k, F.lit("fewer grams than asked for"))).where("ok is null")  # one row
    return x.select(F.row_number().over(Window.orderBy(F.desc("n"), "gram")).alias("pos"), "gram", "n")  # k rows


def storage_costs(stores: DataFrame, documents: int = 1_000_000) -> DataFrame:
    """(store, dim, mb, gb_per_million): size of each store (store, rows, dim, width, extra) in decimal units, width bytes an element and extra bytes a row."""
    per_row = F.col("dim") * F.col("width") + F.col("extra")
    return stores.select("store", "dim", F.round(F.col("rows") * per_row / 1e6, 4).alias("mb"), F.round(documents * per_row / 1e9, 4).alias("gb_per_million"))


def tally(df: DataFrame, key: Column, name: str) -> DataFrame:
    """(name, n, share) of each value, null being a value."""
    c = df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("t"))
    return c.crossJoin(F.broadcast(t)).select(name, "n", F.round(F.col("n") / F.col("t"), 9).alias("share"))  # one row


def win_tie_loss(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: wins, ties, losses, mean, median, least and greatest of a - b."""
    d = pairs.select((F.col(a) - F.col(b)).alias("d")).where("d is not null")
    return d.agg(F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") == 0).alias("ties"), F.count_if(F.col("d") < 0).alias("losses"), F.round(F.avg("d"), 9).alias("mean"), F.round(F.median("d"), 9).alias("median"), F.round(F.min("d"), 9).alias("least"), F.round(F.max("d"), 9).alias("greatest"))


def majority(votes: DataFrame, key: str, label: str, default: str = "general", strict: bool = True) -> DataFrame:
    """(key, label): the label with more than half of the votes, or with ``strict`` off the only most frequent one; else the default."""
    c = votes.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    top = c.groupBy(key).agg(F.max("n").alias("top"), F.sum("n").alias("total"))
    j = c.join(top, key).where("n = top").groupBy(key).agg(F.count(F.lit(1)).alias("winners"), F.min(label).alias("w"), F.max("top").alias("top"), F.max("total").alias("total"))
    ok = F.col("winners") == 1
    if strict:
        ok &= F.col("top") * 2 > F.col("total")
    all_keys = votes.select(key).distinct()
    return all_keys.join(j.select(key, F.when(ok, F.col("w")).otherwise(default).alias("l")), key, "left").select(key, F.coalesce("l", F.lit(default)).alias(label))


def opener_concentration(texts: DataFrame, words: Column, k: int = 4, top: int = 10) -> DataFrame:
    """One row: share of texts that begin with one of the ``top`` most frequent openings, and distinct bigrams over all."""
    w = texts.select(words.alias("w")).where(F.size("w") > 0)
    opening = w.groupBy(F.array_join(F.slice("w", 1, k), " ").alias("o")).agg(F.count(F.lit(1)).alias("n"))
    best = opening.orderBy(F.desc("n"), "o").limit(top).agg(F.sum("n").alias("in_top"))
    n = w.agg(F.count(F.lit(1)).alias("texts"))
    two = F.when(F.size("w") >= 2, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 2), " ")))
    b = w.select(F.explode(two).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("distinct_bigrams"), F.sum("c").alias("bigrams"))
    j = best.crossJoin(n).crossJoin(b)  # one row each
    return j.select("texts", F.round(F.col("in_top") / F.col("texts"), 9).alias("top_share"), F.round(F.col("distinct_bigrams") / F.col("bigrams"), 9).alias("distinct_2"))


def ols(df: DataFrame, y: str, x: str, by: list[str] | None = None) -> DataFrame:
    """(n, slope, intercept, se, t) of y on x, per group; null below 5 points or without spread."""
    by = by or []
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"))
    ok = (F.col("n") >= 5) & (F.col("sxx") > 0) & (F.col("syy") > 0)
    sse = F.greatest(F.lit(0.0), F.col("syy") - F.col("b") * F.col("b") * F.col("sxx"))
    se = F.sqrt(sse / (F.col("n") - 2) / F.col("sxx"))
    return g.select(*by, "n", F.round(F.when(ok, F.col("b")), 9).alias("slope"), F.round(F.when(ok, F.col("a")), 9).alias("intercept"), F.round(F.when(ok, se), 9).alias("se"), F.round(F.when(ok & (se > 0), F.col("b") / se), 6).alias("t"))


def two_way_variance(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """One row of variance components of a complete two-way table with one value in each cell, none below 0."""
    rm = df.groupBy(row).agg(F.avg(value).alias("m")).agg(F.var_samp("m").alias("vr"), F.count(F.lit(1)).alias("r"))
    cm = df.groupBy(col).agg(F.avg(value).alias("m")).agg(F.var_samp("m").alias("vc"), F.count(F.lit(1)).alias("c"))
    tot = df.agg((F.var_samp(value) * (F.count(value) - 1)).alias("sst"))
    j = rm.crossJoin(cm).crossJoin(tot)  # one row each
    ssr, ssc = F.col("vr") * (F.col("r") - 1) * F.col("c"), F.col("vc") * (F.col("c") - 1) * F.col("r")
    msr, msc = F.col("vr") * F.col("c"), F.col("vc") * F.col("r")
    mse = F.try_divide(F.col("sst") - ssr - ssc, (F.col("r") - 1) * (F.col("c") - 1))
    z = lambda c: F.round(F.greatest(F.lit(0.0), c), 6)
    return j.select(z(F.try_divide(msr - mse, F.col("c"))).alias("var_row"), z(F.try_divide(msc - mse, F.col("r"))).alias("var_col"), z(mse).alias("var_resid"))


def power_fit(df: DataFrame, x: str, y: str, exponents: tuple[float, ...] = tuple(i / 10 for i in range(1, 21))) -> DataFrame:
    """(exponent, a, b, sse): y = a + b * x^-exponent by least squares on a grid; the best exponent, the smaller of equal ones."""
    grid = df.sparkSession.createDataFrame([(e,) for e in exponents], "exponent double")
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x > 0 and y is not null")
    g = d.join(F.broadcast(grid)).withColumn("u", F.pow("x", -F.col("exponent")))  # the grid is fixed
    f = g.groupBy("exponent").agg(F.regr_intercept("y", "u").alias("a"), F.regr_slope("y", "u").alias("b"), F.regr_syy("y", "u").alias("syy"), F.regr_sxx("y", "u").alias("sxx"))
    f = f.withColumn("sse", F.round(F.col("syy") - F.col("b") * F.col("b") * F.col("sxx"), 9))
    return f.orderBy("sse", "exponent").limit(1).select("exponent", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("sse", 6).alias("sse"))


def cutoff_counts(rows: DataFrame, endpoint: str, ident: str, created: str, updated: str, cutoff: str) -> DataFrame:
    """(endpoint, raw, included, after_cutoff, updated_after, unique_ids, duplicates): rows created by the cutoff are included."""
    c = F.to_timestamp(F.lit(cutoff))
    inc = F.col(created) <= c
    g = rows.groupBy(F.col(endpoint).alias("endpoint")).agg(F.count(F.lit(1)).alias("raw"), F.count_if(inc).alias("included"), F.count_if(F.col(created) > c).alias("after_cutoff"), F.count_if(inc & (F.col(updated) > c)).alias("updated_after"), F.count_distinct(F.when(inc, F.col(ident))).alias("unique_ids"))
    return g.withColumn("duplicates", F.col("included") - F.col("unique_ids"))


def domain_rollup(docs: DataFrame, sources: DataFrame, domains: DataFrame) -> DataFrame:
    """(domain, docs, queries, gap): documents by own label, queries by their source's label; ``gap`` marks a domain with neither."""
    d = docs.groupBy("domain").agg(F.count(F.lit(1)).alias("docs"))
    q = sources.groupBy("domain").agg(F.sum("queries").alias("queries"))
    j = domains.select("domain").distinct().join(d, "domain", "left").join(q, "domain", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return j.select("domain", z("docs"), z("queries"), (F.coalesce("docs", F.lit(0)) + F.coalesce("queries", F.lit(0)) == 0).alias("gap"))


def stream_counts(rows: DataFrame, drops: DataFrame, stream: str = "stream", key: str = "key") -> DataFrame:
    """(stream, streamed, dropped, new_drops): a key counts as new in the first stream that drops it."""
    s = rows.groupBy(stream).agg(F.count(F.lit(1)).alias("streamed"))
    first = drops.groupBy(key).agg(F.min(stream).alias(stream)).groupBy(stream).agg(F.count(F.lit(1)).alias("new_drops"))
    d = drops.select(stream, key).distinct().groupBy(stream).agg(F.count(F.lit(1)).alias("dropped"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return s.join(d, stream, "left").join(first, stream, "left").select(stream, "streamed", z("dropped"), z("new_drops"))
