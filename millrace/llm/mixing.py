"""Mixtures of several sources to target sizes, with a cap on repetition.

The documents of each source are counted by exact token length. A target is
filled from these counts alone, in two steps: every length in proportion, and
the remaining budget by a bounded knapsack over the lengths, which may also give
back some of the first step. The size reached is the target or the nearest
reachable size below it. The documents are then picked by length count in a
seeded order. Only histograms are ever brought together in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranking import distributed_row_number
from millrace.session import salted_join, stage

from . import tokens
from .related_splits import BLANKS, bare

CAP = 4
SEED = "millrace-mix-1"
BUCKETS = ("general", "coverage", "alias")


#: Sums that the exchange step looks at on each side at first, in longest lengths; widened until the best is certain.
WINDOW = 4


def exchange(gap: int, more: dict[int, int], less: dict[int, int], window: int) -> tuple[int, dict[int, int]]:
    """(sum, change by length): the largest sum of at most ``gap`` from adding up to ``more`` and giving back up to ``less`` of each length.

    Bounded knapsack by dynamic programming over sums within ``window`` of 0 and
    ``gap``; the copies of a length are split into powers of two. Stops as soon as
    ``gap`` itself is reached.
    """
    size = gap + 2 * window + 1
    reach = np.zeros(size, bool)
    reach[window] = True
    steps = sum(k.bit_length() for held in (more, less) for k in held.values())
    took = np.zeros(size, np.int16 if steps < 1 << 15 else np.int32)  # the item that first reached a sum
    items: list[tuple[int, int]] = []
    goal = window + gap
    for length in sorted({*more, *less}):
        for sign, held in ((1, more), (-1, less)):
            left, k = min(held.get(length, 0), size // length if length else 0), 1
            while left > 0 and not reach[goal]:
                n = min(k, left)
                left, k = left - n, k * 2
                items.append((length, sign * n))
                w = length * n
                new = np.zeros(size, bool)
                if w < size:
                    if sign > 0:
                        new[w:] = reach[:-w]
                    else:
                        new[:-w] = reach[w:]
                new &= ~reach
                took[new] = len(items)
                reach |= new
    at = best = int(np.flatnonzero(reach[: goal + 1])[-1])
    change: dict[int, int] = {}
    while took[at]:
        length, n = items[took[at] - 1]
        change[length] = change.get(length, 0) + n
        at -= length * n
    return best - window, change


def knapsack(budget: int, counts: dict[int, int]) -> dict[int, int]:
    """How many of each length to take so that the sum is the largest that is at most ``budget``."""
    return {n: 0 for n in counts} | exchange(budget, counts, {}, 0)[1]


def fill(budget: int, counts: dict[int, int], cap: int) -> dict[int, int]:
    """How often documents of each length are used, at most ``cap`` times their number, so that the sum is the largest of at most ``budget``.

    Starting from a filling in proportion, the best sum is reached by changing at
    most 3 m uses, m being the longest length: of more changes, some would sum to
    nothing and can be left out. So an exchange within 3 m * m of the start finds
    it; smaller windows come first and suffice when they meet the budget exactly.
    Lengths of 0 add nothing; they are used in whole passes over the source.
    """
    total = sum(n * c for n, c in counts.items())
    uses = {n: 0 for n in counts}
    if budget <= 0 or total <= 0:
        return uses
    if 0 in counts:
        uses[0] = counts[0] * min(cap, budget // total)
    have = {n: c * cap for n, c in counts.items() if n > 0}
    if budget >= cap * total:
        return uses | have
    unit = math.gcd(*have)  # sums are its multiples
    budget, have = budget // unit, {n // unit: k for n, k in have.items()}
    total = sum(n * k for n, k in have.items())
    x = {n: budget * k // total for n, k in have.items()}
    gap = budget - sum(n * k for n, k in x.items())
    for n in sorted(have, reverse=True):
        k = min(have[n] - x[n], gap // n)
        x[n] += k
        gap -= n * k
    longest = max(have)
    most = 3 * longest
    more, less = ({n: min(k, most) for n, k in d.items() if k > 0} for d in ({n: have[n] - x[n] for n in have}, x))
    certain = min(most * longest, sum(n * k for n, k in more.items()) + sum(n * k for n, k in less.items()))
    window = WINDOW * longest
    while gap:
        reached, change = exchange(gap, more, less, min(window, certain))
        if reached == gap or window >= certain:
            for n, k in change.items():
                x[n] += k
            break
        window *= 4
    return uses | {n * unit: k for n, k in x.items()}


def _fit(cap: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        mix, source = key
        counts = {int(n): int(c) for n, c in zip(rows["length"], rows["docs"], strict=True) if pd.notna(n) and c}
        budget = int(rows["budget"].iloc[0])
        uses = fill(budget, counts, cap)
        lengths = sorted(counts) or [0]
        docs = [counts.get(n, 0) for n in lengths]
        each = [divmod(uses.get(n, 0), c) if c else (0, 0) for n, c in zip(lengths, docs, strict=True)]
        asked = int(rows["asked"].iloc[0])
        return pd.DataFrame({"mix": mix, "source": source, "asked": asked, "budget": budget, "length": lengths, "docs": docs, "passes": [p for p, _ in each], "extra": [e for _, e in each]})

    return run


def mix_plan(items: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """(mix, source, asked, budget, length, docs, passes, extra): how each target is filled.

    ``items`` has (source, id, length), each id once; ``targets`` has (mix,
    source, budget) and may have ``asked``, a number of documents, each (mix,
    source) once. Every document of a length is used ``passes`` times, ``extra``
    of them once more, never more than ``cap`` times in all. A source without
    documents gives one row with length 0 and no docs. Null sources, ids,
    lengths or budgets take no part.
    """
    histogram = items.where(F.col("source").isNotNull() & F.col("id").isNotNull() & (F.col("length") >= 0)).groupBy("source", F.col("length").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("docs"))
    t = targets.where(F.col("mix").isNotNull() & F.col("source").isNotNull() & F.col("budget").isNotNull()).select("mix", "source", F.col("budget").cast("long").alias("budget"), (F.col("asked") if "asked" in targets.columns else F.lit(0)).cast("long").alias("asked"))
    return t.join(histogram, "source", "left").groupBy("mix", "source").applyInPandas(_fit(cap), "mix string, source string, asked long, budget long, length long, docs long, passes long, extra long")


def mix_shares(plan: DataFrame, cap: int = CAP) -> DataFrame:
    """(mix, source, asked, docs, budget, at_hand, drawn, most_times, target_share, reached_share, short, overdrawn) of each target.

    ``short`` marks a target that not even ``cap`` uses of every document fill,
    ``overdrawn`` one that asks for more documents than that. Shares are of the
    mix's budgets and of what it drew; null if that is 0.
    """
    one = plan.groupBy("mix", "source").agg(
        F.max("asked").alias("asked"),
        F.sum("docs").alias("docs"),
        F.max("budget").alias("budget"),
        F.sum(F.col("length") * F.col("docs")).alias("at_hand"),
        F.sum(F.col("length") * (F.col("docs") * F.col("passes") + F.col("extra"))).alias("drawn"),
        F.max(F.when(F.col("docs") > 0, F.col("passes") + F.when(F.col("extra") > 0, 1).otherwise(0)).otherwise(0)).alias("most_times"),
    )
    sums = one.groupBy("mix").agg(F.sum("budget").alias("all_b"), F.sum("drawn").alias("all_d"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return one.join(sums, "mix").select("mix", "source", "asked", "docs", "budget", "at_hand", "drawn", "most_times", share("budget", "all_b").alias("target_share"), share("drawn", "all_d").alias("reached_share"), (F.col("budget") > F.col("at_hand") * cap).alias("short"), (F.col("asked") > F.col("docs") * cap).alias("overdrawn"))


def mix_draws(items: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """(mix, source, id, times): how often each mix uses each document; unused ones are absent.

    The documents of a length stand in one seeded order; a mix takes its extra
    ones from a start of its own in that order, round its end.
    """
    ok = items.where(F.col("source").isNotNull() & F.col("id").isNotNull() & (F.col("length") >= 0)).select("source", "id", F.col("length").cast("long").alias("length"), F.md5(F.concat_ws("|", F.lit(seed), "id")).alias("h"))
    placed = distributed_row_number(ok, ["source", "length"], [], "h", ["id"]).drop("h")
    p = plan.where("docs > 0 and (passes > 0 or extra > 0)").withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "mix"), F.col("docs")))
    again = F.pmod(F.col("rn") - 1 + F.col("start"), F.col("docs")) < F.col("extra")
    # a plan row for each mix and length; all the documents of a length may be in one key, so they are salted
    x = salted_join(placed, p.select("mix", "source", "length", "docs", "passes", "extra", "start"), ["source", "length"], ["id"])
    return x.select("mix", "source", "id", (F.col("passes") + F.when(again, 1).otherwise(0)).alias("times")).where("times > 0")


def run_targets(runs: DataFrame, mean_tokens: DataFrame) -> DataFrame:
    """(mix, source, asked, budget) for every coherent run of a run configuration.

    A run asks for steps * general_views general records, steps * coverage_views
    coverage records and steps * alias_pairs alias pairs; its budget in tokens is
    as many views, two for a pair, of the mean length in ``mean_tokens`` (one
    row). Runs with a null or negative number among the three, or where general +
    coverage + 2 * pairs is not the batch, take no part; repeated rows count once.
    """
    n = ["general_views", "coverage_views", "alias_pairs"]
    good = F.col("run_id").isNotNull() & F.col("steps").isNotNull() & (F.col(n[0]) + F.col(n[1]) + 2 * F.col(n[2]) == F.col("batch"))
    for c in n:
        good &= F.col(c) >= 0
    x = runs.where(good).select("run_id", F.col("steps").cast("long").alias("steps"), *n).distinct().crossJoin(F.broadcast(mean_tokens))  # one row
    asked = [F.col("steps") * F.col(c) for c in n]
    t = F.array(*[F.struct(F.lit(b).alias("source"), a.alias("asked"), (a * F.col("mean_tokens") * (2 if b == "alias" else 1)).alias("budget")) for b, a in zip(BUCKETS, asked, strict=True)])
    x = x.select(F.col("run_id").alias("mix"), F.explode(t).alias("t")).select("mix", "t.*")
    return x.groupBy("mix", "source").agg(F.max("asked").alias("asked"), F.max("budget").alias("budget"))


def token_lengths(texts: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """``length``: the exact number of tokens of ``text`` by a public tokenizer; 0 for null and empty texts. Each distinct text is encoded once."""
    with open(vocabulary, "rb") as f:
        ranks = texts.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.Encoder(tokens.read_ranks(ranks.value))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encoder.encode(t)) for t in b.column(0).to_pylist()], pa.int64())], ["text", "length"])

    one = texts.select("text").where("text is not null and text <> ''").distinct().mapInArrow(run, "text string, length long")
    return texts.join(one, "text", "left").withColumn("length", F.coalesce("length", F.lit(0).cast("long")))


def _latest(records: DataFrame, *keys: str) -> DataFrame:
    """One text for each key: of the last delivery, then the greatest."""
    return records.groupBy(*keys).agg(F.max(F.struct("delivery", "text")).alias("m")).select(*keys, "m.text")


def bucket_items(records: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """(source, id, length): the distinct qids of general and coverage, and the alias pairs with both views.

    ``length`` is the number of tokens of the text delivered last; a pair has
    those of both views. Buckets and views are compared without letter case and
    outer blanks.
    """
    b, v = bare(F.col("bucket")), bare(F.col("alias_view"))
    q = records.where(b.isin("general", "coverage") & F.col("qid").isNotNull()).select(b.alias("source"), F.col("qid").alias("id"), F.lit("").alias("view"), "delivery", "text")
    pairs = records.where(v.isin("a", "b") & (F.trim("alias_pair_id", F.lit(BLANKS)) != "")).select(F.lit("alias").alias("source"), F.col("alias_pair_id").alias("id"), v.alias("view"), "delivery", "text")
    x = token_lengths(_latest(q.union(pairs), "source", "id", "view"), vocabulary)
    x = x.groupBy("source", "id").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"))
    return x.where("source <> 'alias' or n = 2").select("source", "id", "length")


def mean_tokens(items: DataFrame) -> DataFrame:
    """One row: the mean length of general and coverage records, rounded down, at least 1."""
    x = items.where(F.col("source").isin("general", "coverage"))
    return x.agg(F.greatest(F.lit(1), F.coalesce(F.floor(F.sum("length") / F.count(F.lit(1))), F.lit(1))).cast("long").alias("mean_tokens"))


def mixed_runs(records: DataFrame, runs: DataFrame, cap: int = CAP, vocabulary: str = tokens.VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(items, plan) of the runs of a run configuration over the buckets of the records."""
    items = stage(bucket_items(records, vocabulary), "items")
    return items, mix_plan(items, run_targets(runs, mean_tokens(items)), cap)


def overdrawn(records: DataFrame, runs: DataFrame, cap: int = CAP, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """(run_id, bucket): buckets of which a run draws more than ``cap`` times what is at hand."""
    return mix_shares(mixed_runs(records, runs, cap, vocabulary)[1], cap).where("overdrawn").select(F.col("mix").alias("run_id"), F.col("source").alias("bucket"))
