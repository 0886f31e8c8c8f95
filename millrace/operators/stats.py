"""Paired inference. Draws come from hashes of (seed, replicate, unit), so results do not depend on the layout.

Each replicate of a bootstrap resamples n units of a stratum with replacement:
slot j of replicate r takes the unit that a hash of (seed, r, stratum, j) names.
The hash is two rounds of a 32-bit mixer with keys from an md5, a few
nanoseconds a draw and the same in SQL. Sign flips take 32 replicates from each
hash of (seed, block of replicates, unit).
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import bounded_broadcast

from .ranking import distributed_row_number

#: Replicates of the engine being matched: bootstraps, sign flips, weighted contrast.
BOOTSTRAP, FLIPS, CONTRAST = 10_000, 100_000, 200_000
#: Unit rows up to which each worker holds all values; above it, draws are joined with the units.
HELD_ROWS = 2_000_000


def align(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value", strict: bool = True) -> DataFrame:
    """(keys, a, b). With ``strict`` a key on one side only is an error, else it is left out. Repeated keys are an error."""
    one = lambda df, c: df.groupBy(*keys).agg(F.max(value).alias(c), F.count(F.lit(1)).alias("n_" + c))
    j = one(a, "a").join(one(b, "b"), keys, "full" if strict else "inner")
    ok = F.assert_true(F.col("n_a").eqNullSafe(1) & F.col("n_b").eqNullSafe(1), F.lit("the two sides do not hold the same keys once each"))
    return j.withColumn("ok", ok).where("ok is null").select(*keys, "a", "b")


def numbered(pairs: DataFrame, stratum: str, unit: str) -> DataFrame:
    """``k`` from 0 and ``n`` within each stratum, in the order of md5(unit), unit."""
    x = pairs.withColumn("__h", F.md5(F.col(unit).cast("string")))
    x = distributed_row_number(x, [stratum], [], "__h", [unit], "k").drop("__h").withColumn("k", F.col("k") - 1)
    return x.join(x.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")), stratum)


def mixed32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers that spreads every bit; in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def keys32(*parts: object) -> tuple[np.uint32, np.uint32]:
    """Two keys from the md5 of the parts."""
    h = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    return np.uint32(int(h[:8], 16)), np.uint32(int(h[8:16], 16))


def picks(seed: str, rep: int, stratum: str, n: int, part: int = 1 << 14) -> Iterator[np.ndarray]:
    """Unit numbers of the n slots of a stratum: 32 bits of each slot scaled to n, which must be below 2^31."""
    one, two = keys32(seed, rep, stratum)
    for at in range(0, n, part):
        x = np.arange(at, min(n, at + part), dtype=np.uint32)
        x += one
        x = mixed32(x)
        x ^= two
        y = mixed32(x).astype(np.uint64)
        y *= np.uint64(n)
        y >>= np.uint64(32)
        yield y.view(np.int64)


def draw_plan(units: DataFrame, stratum: str, replicates: int, seed: str) -> DataFrame:
    """(stratum, n, replicates, seed): what names every draw of all replicates. Save it to use one plan for several contrasts.

    The draws follow from these and are made anew where they are used (``picks``): written out they would be replicates times units.
    """
    return units.groupBy(stratum).agg(F.max("n").alias("n")).select(stratum, "n", F.lit(replicates).alias("replicates"), F.lit(seed).alias("seed"))


def planned_deltas(plan: DataFrame, pairs: DataFrame, stratum: str, unit: str) -> DataFrame:
    """(rep, delta): macro difference of each replicate of a saved plan. A plan that was drawn for other units is an error."""
    x = numbered(pairs, stratum, unit).select(stratum, "k", "n", (F.col("a") - F.col("b")).alias("d"))
    drawn = plan.select("replicates", "seed").limit(1).collect()
    if not drawn:
        raise ValueError("the plan is empty")
    sizes = x.groupBy(stratum).agg(F.max("n").alias("__n")).join(plan.select(stratum, F.col("n").alias("__drawn")), stratum, "full")
    other = sizes.agg(F.count_if(~F.col("__n").eqNullSafe(F.col("__drawn"))).alias("__other"))
    m = resampled(x, stratum, stratum, ["d"], drawn[0].replicates, drawn[0].seed).select("rep", (F.col("d") / F.col("n")).alias("m")).crossJoin(F.broadcast(other))  # one row
    ok = F.assert_true(F.col("__other") == 0, F.lit("the plan was drawn for other units"))
    return m.withColumn("ok", ok).where("ok is null").groupBy("rep").agg(F.round(F.avg("m"), 12).alias("delta"))


def resampled(units: DataFrame, stratum: str, label: str, values: list[str], replicates: int, seed: str, held: int = HELD_ROWS) -> DataFrame:
    """(rep, stratum, label, n, values): sums of the values over the slots of each replicate, for each label of a stratum.

    ``units`` is (stratum, k, n, label, values), each k from 0 to n - 1 once for each label.
    """
    spark = units.sparkSession
    reps = spark.range(0, replicates, 1, max(1, min(replicates // 50, 4 * spark.sparkContext.defaultParallelism)))
    units = units.select(F.col(stratum).cast("string").alias("g"), F.col(label).cast("string").alias("l"), "k", "n", *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    names = [f"v{i}" for i in range(len(values))]
    head = units.limit(held + 1).toArrow()  # bounded
    if head.num_rows <= held:
        found = defaultdict(dict)
        table = head.sort_by([("g", "ascending"), ("l", "ascending"), ("k", "ascending")])
        g, lab = np.array(table["g"].to_pylist(), dtype=object), np.array(table["l"].to_pylist(), dtype=object)
        v = np.stack([table[c].to_numpy() for c in names], axis=1) if len(g) else np.zeros((0, len(names)))
        cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (lab[1:] != lab[:-1])) + 1), len(g)] if len(g) else [0]
        for i, j in zip(cuts, cuts[1:]):
            found[g[i]][lab[i]] = np.ascontiguousarray(v[i:j].T)
        blocks = spark.sparkContext.broadcast(dict(found))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys, sums = [], []
                for rep in b.column(0).to_pylist():
                    for s, labels in blocks.value.items():
                        n = next(iter(labels.values())).shape[1]
                        total = {x: np.zeros(len(names)) for x in labels}
                        for idx in picks(seed, rep, s, n):
                            for x, one in labels.items():
                                total[x] += [row.take(idx, mode="clip").sum() for row in one]
                        keys += [(rep, s, x, n) for x in labels]
                        sums += total.values()
                if keys:
                    columns = [pa.array(c, t) for c, t in zip(zip(*keys), (pa.int64(), pa.string(), pa.string(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c) for c in np.array(sums).T]], ["rep", "g", "l", "n", *names])

        out = reps.mapInArrow(run, ", ".join(["rep long, g string, l string, n long", *[f"{c} double" for c in names]]))
    else:
        sizes = units.groupBy("g").agg(F.max("n").alias("n"))

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for rep, s, n in zip(*[c.to_pylist() for c in b.columns]):
                    for idx in picks(seed, rep, s, n):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), rep)), pa.array([s] * len(idx), pa.string()), pa.array(idx)], ["rep", "g", "k"])

        slots = reps.crossJoin(bounded_broadcast(sizes)).select("id", "g", "n").mapInArrow(draw, "rep long, g string, k long")
        out = slots.join(bounded_broadcast(units), ["g", "k"]).groupBy("rep", "g", "l").agg(F.max("n").alias("n"), *[F.sum(c).alias(c) for c in names])
    return out.select("rep", F.col("g").alias(stratum), *([] if label == stratum else [F.col("l").alias(label)]), "n", *[F.col(c).alias(v) for c, v in zip(names, values)])


def observed(pairs: DataFrame, stratum: str) -> DataFrame:
    """One row: macro of a - b over strata."""
    return pairs.groupBy(stratum).agg(F.avg(F.col("a") - F.col("b")).alias("m")).agg(F.round(F.avg("m"), 12).alias("delta"))


def bootstrap_deltas(pairs: DataFrame, stratum: str, unit: str, replicates: int, seed: str) -> DataFrame:
    """(rep, delta): macro difference of each replicate."""
    x = numbered(pairs, stratum, unit).select(stratum, "k", "n", (F.col("a") - F.col("b")).alias("d"))
    m = resampled(x, stratum, stratum, ["d"], replicates, seed).select("rep", (F.col("d") / F.col("n")).alias("m"))
    return m.groupBy("rep").agg(F.round(F.avg("m"), 12).alias("delta"))


def inverted_cdf(deltas: DataFrame, q: float, value: str = "delta") -> Column:
    """Aggregate: the ceil(q * n)-th smallest value."""
    return F.expr(f"percentile_disc({q}) within group (order by {value})")


def statistic_replicates(units: DataFrame, stratum: str, unit: str, values: list[str], statistic: Callable[[dict[str, Column], Column], Column], replicates: int = BOOTSTRAP, seed: str = "b") -> DataFrame:
    """(rep, stratum, value): any statistic of resampled sums.

    ``statistic`` gets the sum of each value over the slots of a replicate, by name, and the number of slots, and makes one Column of them.
    """
    x = numbered(units, stratum, unit)
    m = resampled(x, stratum, stratum, values, replicates, seed)
    return m.select("rep", stratum, statistic({v: F.col(v) for v in values}, F.col("n")).alias("value"))


def one_sided_bounds(deltas: DataFrame, level: float = 0.975, margin: float = 0.005, digits: int = 6) -> DataFrame:
    """One row: the order statistics of the deltas at 1 - level and level, and whether the upper one is below ``margin``."""
    up = inverted_cdf(deltas, level)
    return deltas.agg(F.round(inverted_cdf(deltas, round(1 - level, 12)), digits).alias("lower"), F.round(up, digits).alias("upper"), (up < margin).alias("equivalent"))


def paired_bootstrap(pairs: DataFrame, stratum: str, unit: str, replicates: int = BOOTSTRAP, seed: str = "b", quantile: float = 0.025) -> DataFrame:
    """One row: delta, its 95 % interval (linear), the one-sided lower and upper bound by order statistics, share of replicates at or below 0.

    The tail share is no p-value.
    """
    if quantile * replicates < 1:
        raise ValueError(f"{replicates} replicates have no order statistic at {quantile}")
    d = bootstrap_deltas(pairs, stratum, unit, replicates, seed)
    s = d.agg(F.round(F.percentile("delta", 0.025), 9).alias("ci_low"), F.round(F.percentile("delta", 0.975), 9).alias("ci_high"), F.round(inverted_cdf(d, quantile), 9).alias("lower"), F.round(inverted_cdf(d, 1 - quantile), 9).alias("upper"), F.round(F.avg((F.col("delta") <= 0).cast("double")), 9).alias("tail"))
    return observed(pairs, stratum).select(F.round("delta", 9).alias("delta")).crossJoin(s)  # one row each


#: Blocks of 32 replicates whose sums travel in one row.
CHUNK = 128


def flipped_sums(units: DataFrame, replicates: int, seed: str) -> DataFrame:
    """(rep, t): the sum of ``x`` over all rows of (u, x), each with the sign of its ``u`` in that replicate.

    Every task takes its rows through all replicates and sends one sum for each,
    so the work is spread over rows and only sums are shuffled.
    """
    blocks = -(-replicates // 32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((blocks, 32))
        keys = [keys32(seed, b) for b in range(blocks)]
        for batch in batches:
            a, b = (batch.column(i).to_numpy().astype(np.uint32) for i in range(2))
            x = batch.column(2).to_numpy()
            total += x.sum()
            for at in range(0, len(x), 4096):
                p = slice(at, at + 4096)
                for i, (one, two) in enumerate(keys):
                    h = mixed32(a[p] ^ one)
                    h ^= b[p]
                    h ^= two
                    bits = np.unpackbits(mixed32(h).astype("<u4", copy=False).view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
                    total[i] -= 2 * (x[p] @ bits.astype(np.float64))
        for c in range(0, blocks, CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([c // CHUNK]), pa.array([total[c : c + CHUNK].tobytes()])], ["chunk", "sums"])

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = sum(np.frombuffer(x) for x in pdf["sums"])
        rep = key[0] * CHUNK * 32 + np.arange(len(t))
        return pd.DataFrame({"rep": rep, "t": np.round(t, 12)})[rep < replicates]

    h = F.md5("u")
    half = lambda i: F.conv(F.substring(h, i, 8), 16, 10).cast("long")
    x = units.repartition(units.sparkSession.sparkContext.defaultParallelism, "u").select(half(1).alias("a"), half(9).alias("b"), "x")
    return x.mapInArrow(run, "chunk long, sums binary").groupBy("chunk").applyInPandas(merge, "rep long, t double")


def sign_flip(pairs: DataFrame, stratum: str, unit: str, replicates: int = FLIPS, seed: str = "s", unit_of: str | None = None) -> DataFrame:
    """One row: (delta, p): (1 + replicates with a flipped macro at least as large in size) / (1 + replicates).

    With ``unit_of`` all rows of one underlying unit share their sign across strata.
    """
    key = F.concat_ws("|", F.col(stratum).cast("string"), F.col(unit).cast("string")) if unit_of is None else F.col(unit_of).cast("string")
    sizes = pairs.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    w = sizes.crossJoin(F.broadcast(sizes.agg(F.count(F.lit(1)).alias("strata")))).select(stratum, (F.col("n") * F.col("strata")).alias("share"))  # one row
    x = pairs.join(bounded_broadcast(w), stratum).select(key.alias("u"), ((F.col("a") - F.col("b")) / F.col("share")).alias("x"))
    t = flipped_sums(x, replicates, seed)
    j = t.crossJoin(F.broadcast(observed(pairs, stratum)))  # one row
    return j.groupBy(F.round("delta", 9).alias("delta")).agg(F.round((1 + F.count_if(F.abs("t") >= F.abs("delta"))) / (1 + F.count(F.lit(1))), 9).alias("p"))


def signature_strata(pairs: DataFrame, dataset: str, unit: str) -> DataFrame:
    """``signature``: the sorted data sets in which a unit occurs; units of one signature form a stratum."""
    s = pairs.groupBy(unit).agg(F.array_join(F.sort_array(F.collect_set(F.col(dataset).cast("string"))), "+").alias("signature"))
    return pairs.join(s, unit)


def shared_bootstrap(pairs: DataFrame, dataset: str, unit: str, replicates: int = BOOTSTRAP, seed: str = "d") -> DataFrame:
    """(rep, delta): one draw for each underlying unit, used in every data set that holds it."""
    s = signature_strata(pairs, dataset, unit)
    units = numbered(s.select("signature", unit).distinct(), "signature", unit)
    x = s.join(units.select(unit, "signature", "k", "n"), ["signature", unit]).select("signature", "k", "n", dataset, (F.col("a") - F.col("b")).alias("d"))
    m = resampled(x, "signature", dataset, ["d"], replicates, seed).groupBy("rep", dataset).agg((F.sum("d") / F.sum("n")).alias("m"))
    return m.groupBy("rep").agg(F.round(F.avg("m"), 12).alias("delta"))


def family_bootstrap(pairs: DataFrame, stratum: str, family: str, replicates: int = BOOTSTRAP, seed: str = "f") -> DataFrame:
    """(rep, delta): families are resampled inside strata, all their queries with them; strata weigh the same."""
    fam = pairs.groupBy(stratum, family).agg(F.sum(F.col("a") - F.col("b")).alias("__s"), F.count(F.lit(1)).alias("__c"))
    units = numbered(fam, stratum, family)
    m = resampled(units, stratum, stratum, ["__s", "__c"], replicates, seed).select("rep", (F.col("__s") / F.col("__c")).alias("m"))
    return m.groupBy("rep").agg(F.round(F.avg("m"), 12).alias("delta"))


def weighted_contrast(pairs: DataFrame, units: DataFrame, replicates: int = CONTRAST, seed: str = "w", quantile: float = 0.05 / 12) -> DataFrame:
    """One row: (delta, lower, previous) of (unit, qid, a, b), units being resampled within themselves, families weighing the same and units the same in a family.

    ``lower`` is the order statistic at ``quantile``, ``previous`` the one before it.
    """
    sizes = units.groupBy("family").agg(F.count(F.lit(1)).alias("in_family"))
    w = units.join(sizes, "family").crossJoin(F.broadcast(sizes.agg(F.count(F.lit(1)).alias("families"))))
    w = w.select("unit", (1.0 / (F.col("in_family") * F.col("families"))).alias("w"))
    d = numbered(pairs, "unit", "qid").select("unit", "k", (F.col("a") - F.col("b")).alias("d"), "n")
    m = resampled(d, "unit", "unit", ["d"], replicates, seed).select("rep", "unit", (F.col("d") / F.col("n")).alias("m"))
    reps = m.join(w, "unit").groupBy("rep").agg(F.round(F.sum(F.col("m") * F.col("w")), 12).alias("delta"))
    at = max(1, math.ceil(quantile * replicates - 1e-12))
    low = F.sort_array(F.collect_list("delta"))  # one value a replicate
    obs = pairs.groupBy("unit").agg(F.avg(F.col("a") - F.col("b")).alias("m")).join(w, "unit").agg(F.round(F.sum(F.col("m") * F.col("w")), 9).alias("delta"))
    return obs.crossJoin(reps.agg(F.round(F.element_at(low, at), 9).alias("lower"), F.round(F.element_at(low, max(1, at - 1)), 9).alias("previous")))


def holm(tests: DataFrame, alpha: float = 0.05, p: str = "p", name: str = "test") -> DataFrame:
    """(test, p, threshold, rejected): step-down; the first p above alpha / (m - i) stops it. For a family of tests, that is a few rows."""
    w = Window.orderBy(F.col(p), F.col(name))
    x = tests.select(name, p).withColumn("i", F.row_number().over(w) - 1).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy()))
    x = x.withColumn("threshold", alpha / (F.col("m") - F.col("i")))
    return x.select(name, p, F.round("threshold", 9).alias("threshold"), F.min((F.col(p) <= F.col("threshold")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("boolean").alias("rejected"))


def bonferroni_lower(deltas: DataFrame, alpha: float = 0.05, tests: int = 3) -> DataFrame:
    """One row: the lower bound at alpha / tests, linear."""
    return deltas.agg(F.round(F.percentile("delta", alpha / tests), 9).alias("lower"))


def macro_se(pairs: DataFrame, stratum: str) -> DataFrame:
    """One row: sqrt(sum var / n) / strata, the standard error of a macro difference, and the least effect found with 80 % power at 5 %, two-sided."""
    g = pairs.groupBy(stratum).agg((F.var_samp(F.col("a") - F.col("b")) / F.count(F.lit(1))).alias("v"))
    se = F.sqrt(F.sum("v")) / F.count(F.lit(1))
    return g.agg(F.round(se, 9).alias("se"), F.round(se * (1.959963985 + 0.841621234), 9).alias("mde"))


def studentized_calibration(deltas: DataFrame, pairs: DataFrame, stratum: str, level: float = 1.959963985) -> DataFrame:
    """One row: share of replicates whose distance from the observed macro is above ``level`` standard errors."""
    j = deltas.crossJoin(F.broadcast(observed(pairs, stratum).withColumnRenamed("delta", "o"))).crossJoin(F.broadcast(macro_se(pairs, stratum)))
    return j.agg(F.round(F.avg((F.abs(F.col("delta") - F.col("o")) > level * F.col("se")).cast("double")), 9).alias("exceed"))


def prediction_interval(df: DataFrame, y: str, x: str, at: float, t_quantile: float = 2.0) -> DataFrame:
    """One row: (predicted, low, high) of y at x by least squares, +- t * s * sqrt(1 + 1/n + (x - mean)^2 / sxx)."""
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    g = d.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.avg("x").alias("mx"))
    s = F.sqrt(F.try_divide(F.greatest(F.lit(0.0), F.col("syy") - F.col("b") ** 2 * F.col("sxx")), F.col("n") - 2))
    half = t_quantile * s * F.sqrt(1 + 1 / F.col("n") + F.try_divide((at - F.col("mx")) ** 2, F.col("sxx")))
    p = F.col("a") + F.col("b") * at
    return g.select(F.round(p, 6).alias("predicted"), F.round(p - half, 6).alias("low"), F.round(p + half, 6).alias("high"))
