"""Reproducible samples, splits, quotas and batches.

Random draws are orders of hashes of (seed, key): uniform, the same on every
layout, and repeatable in SQL. They are not the draws of any other generator.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import hashing as H
from millrace.session import bounded_broadcast, stage

from .ranking import distributed_row_number, range_numbers


def held_out(rows: DataFrame, source: str, qid: str, one_in: int = 50) -> DataFrame:
    """``held``: sha256(source:qid) mod ``one_in`` is 0."""
    return rows.withColumn("held", H.held_out(F.col(source), F.col(qid), one_in))


def lowest_hash(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The n distinct keys of the smallest sha256 of (seed, key)."""
    return rows.where(F.col(key).isNotNull()).select(key).distinct().withColumn("h", F.sha2(F.concat_ws(H.SEPARATOR, F.lit(seed), F.col(key).cast("string")), 256)).orderBy("h", key).limit(n).select(key)


def threshold_sample(rows: DataFrame, parts: list[Column], rate: float) -> DataFrame:
    """Rows whose hash unit of ``parts`` is below ``rate``."""
    return rows.where(H.unit(*parts) < rate)


def seeded_numbers(rows: DataFrame, group: list[str], key: str, seed: str) -> DataFrame:
    """``rn`` from 1 in the seeded order within each group."""
    x = rows.withColumn("__h", H.order_key(seed, F.col(key)))
    return distributed_row_number(x, group, [], "__h", [key]).drop("__h")


def quota_cut(rows: DataFrame, group: list[str], key: str, quota: int, seed: str) -> DataFrame:
    """A uniform sample of ``quota`` rows of each group; smaller groups stay whole."""
    return seeded_numbers(rows, group, key, seed).where(F.col("rn") <= quota).drop("rn")


def partition_ids(ids: DataFrame, key: str, gate: DataFrame, n: int, seed: str) -> DataFrame:
    """(key, part): 'gate' for given ids, then n uniformly held out, else 'train'. Fewer than n left is an error."""
    rest = ids.select(key).distinct().join(gate.select(key), key, "left_anti")
    r = seeded_numbers(rest, [], key, seed)
    total = r.agg(F.max("rn").alias("m"))
    r = r.crossJoin(F.broadcast(total)).withColumn("ok", F.assert_true(F.col("m") >= n, F.lit("too few ids to hold out"))).where("ok is null")
    g = ids.select(key).distinct().join(gate.select(key), key, "left_semi").select(key, F.lit("gate").alias("part"))
    return g.union(r.select(key, F.when(F.col("rn") <= n, "held").otherwise("train").alias("part")))


def document_holdout(rows: DataFrame, form: str, doc: str, per_form: int, seed: str) -> DataFrame:
    """``held``: documents drawn for any form are withheld from every form."""
    drawn = quota_cut(rows.select(form, doc).distinct(), [form], doc, per_form, seed).select(doc).distinct().withColumn("held", F.lit(True))
    return rows.join(drawn, doc, "left").withColumn("held", F.coalesce("held", F.lit(False)))


def proportional(rows: DataFrame, stratum: str, key: str, target: int, seed: str) -> DataFrame:
    """A stratified sample of ``target`` rows: floor quotas by share, the remainder one each to the largest strata in order."""
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    t = sizes.agg(F.sum("n").alias("t"))
    x = sizes.crossJoin(F.broadcast(t)).withColumn("q", F.floor(F.col("n") * F.least(F.lit(target), F.col("t")) / F.col("t")))
    w = Window.orderBy(F.desc("n"), stratum)
    left = x.agg((F.least(F.lit(target), F.max("t")) - F.sum("q")).alias("left"))
    x = x.withColumn("i", F.row_number().over(w)).crossJoin(F.broadcast(left)).select(stratum, (F.col("q") + F.when(F.col("i") <= F.col("left"), 1).otherwise(0)).alias("quota"))
    numbered = seeded_numbers(rows, [stratum], key, seed)
    cond = numbered[stratum].eqNullSafe(x[stratum]) & (numbered["rn"] <= x["quota"])
    return numbered.join(x, cond).select(*[numbered[c] for c in rows.columns])


def equal_budget(rows: DataFrame, stratum: str, key: str, budget: int, seed: str) -> DataFrame:
    """``budget`` rows: the same number of each stratum, what is left by the seeded order of all others."""
    n = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    k = n.agg(F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.count(F.lit(1)), F.lit(1)))).alias("per"))
    x = seeded_numbers(rows, [stratum], key, seed).crossJoin(F.broadcast(k)).withColumn("first", (F.col("rn") <= F.col("per")).cast("int"))
    y = x.withColumn("__h", H.order_key(seed, F.col(key)))
    y = distributed_row_number(y.withColumn("lead", 1 - F.col("first")), [], ["lead"], "__h", [key], "all_rn")
    return y.where(F.col("all_rn") <= budget).select(*rows.columns)


def k_folds(rows: DataFrame, group: str, folds: int, seed: str) -> DataFrame:
    """``fold``: groups in seeded order, modulo the folds; rows of a group share a fold."""
    g = seeded_numbers(rows.select(group).distinct(), [], group, seed).select(group, ((F.col("rn") - 1) % folds).alias("fold"))
    return rows.join(g, group)


def chronological_split(rows: DataFrame, stratum: str, time: str, ident: str, confirm: int = 3, block: int = 10, seed: str = "c") -> DataFrame:
    """``part``: newest first in blocks of ``block``, ``confirm`` hashed positions of each block go to 'confirmation', the rest to 'development'.

    A stratum may be of any size: its rows are numbered by ranges of time with
    offsets. Rows without a time come last.
    """
    order = [F.col(stratum), F.desc_nulls_last(time), F.desc(ident)]
    x = range_numbers(rows, [stratum], order, "__rn").withColumn("__b", F.floor((F.col("__rn") - 1) / block))
    inside = Window.partitionBy(stratum, "__b").orderBy(H.order_key(seed, F.col(ident)), ident)
    return x.withColumn("part", F.when(F.row_number().over(inside) <= confirm, "confirmation").otherwise("development")).drop("__b", "__rn")


def alternate_families(rows: DataFrame, family: str, ident: str, cap: int = 3, seed: str = "a") -> DataFrame:
    """(family, ident, part): whole families alternate between two parts in seeded order, at most ``cap`` members of each."""
    fam = seeded_numbers(rows.select(family).distinct(), [], family, seed).select(family, F.when(F.col("rn") % 2 == 1, "a").otherwise("b").alias("part"))
    return quota_cut(rows.select(family, ident).distinct(), [family], ident, cap, seed).join(fam, family)


def length_batches(rows: DataFrame, length: str, ident: str, batch: int, seed: str, groups: int = 64) -> DataFrame:
    """(ident, batch): rows of similar length in batches of at most ``batch``, batches in seeded order.

    Lengths are numbered by a range of hashed order within each length, so the
    numbering is distributed; ``batch`` is the batch's place in seeded order.
    """
    x = rows.select(ident, F.col(length).alias("l")).withColumn("__h", H.order_key(seed, F.col(ident)))
    r = distributed_row_number(x, [], ["l"], "__h", [ident]).withColumn("b", F.floor((F.col("rn") - 1) / batch))
    order = seeded_numbers(r.select("b").distinct(), [], "b", seed).select("b", (F.col("rn") - 1).alias("batch"))
    return r.join(order, "b").select(ident, F.col("l").alias(length), "batch")


def epoch_order(rows: DataFrame, ident: str, epoch: int, seed: str) -> DataFrame:
    """(ident, pos): a new order for each epoch, a function of (seed, epoch)."""
    return seeded_numbers(rows.select(ident), [], ident, f"{seed}:{epoch}").select(ident, (F.col("rn") - 1).alias("pos"))


def mixed_pattern(steps: DataFrame, pattern: list[str]) -> DataFrame:
    """(step, kind, index): the stream of each step by a repeated pattern, and which batch of that stream it is."""
    n = len(pattern)
    kind = F.element_at(F.array(*[F.lit(p) for p in pattern]), (F.col("step") % n + 1).cast("int"))
    out = F.when(F.lit(False), 0)
    for i, p in enumerate(pattern):
        out = out.when(F.col("step") % n == i, F.floor(F.col("step") / n) * pattern.count(p) + pattern[:i].count(p))
    return steps.select("step", kind.alias("kind"), out.cast("long").alias("index"))


def form_balanced(rows: DataFrame, form: str, ident: str, cycles: int, batch: int, seed: str) -> DataFrame:
    """(cycle, form_pos, form, slot, ident): in each cycle every form once, in a new order, with a batch drawn with replacement."""
    r = seeded_numbers(rows.select(form, ident), [form], ident, seed)
    sizes = r.groupBy(form).agg(F.max("rn").alias("n"))
    c = rows.sparkSession.range(cycles).withColumnRenamed("id", "cycle")
    s = sizes.crossJoin(c)
    w = Window.partitionBy("cycle").orderBy(H.order_key(seed, F.col("cycle"), F.col(form)), form)
    s = s.withColumn("form_pos", F.row_number().over(w)).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(batch - 1))))
    pick = F.pmod(H.key60(F.concat_ws("|", F.lit(seed), F.col("cycle").cast("string"), F.col(form), F.col("slot").cast("string"))), F.col("n")) + 1
    return s.withColumn("rn", pick).join(r, [form, "rn"]).select("cycle", "form_pos", form, "slot", ident)


def realized_shares(batches: DataFrame, form: str) -> DataFrame:
    """(form, presented, share)."""
    c = batches.groupBy(form).agg(F.count(F.lit(1)).alias("presented"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("presented").alias("t")))).select(form, "presented", F.round(F.col("presented") / F.col("t"), 9).alias("share"))


def token_batches(rows: DataFrame, role: str, ident: str, tokens: str, steps: int, total: int, shares: dict[str, float], seed: str) -> DataFrame:
    """(role, ident, step): rows in seeded order fill each role's budget, due = total * share * step / steps, step by step; rows beyond the last are absent.

    A role's running sum is taken per hash bucket with offsets, not in one task.
    """
    x = rows.select(role, ident, F.col(tokens).cast("long").alias("t")).withColumn("h", H.order_key(seed, F.col(ident)))
    x = x.withColumn("b", F.substring("h", 1, 2))
    sums = x.groupBy(role, "b").agg(F.sum("t").alias("s"))
    off = sums.withColumn("off", F.coalesce(F.sum("s").over(Window.partitionBy(role).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    inside = Window.partitionBy(role, "b").orderBy("h", ident).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("before", F.coalesce(F.sum("t").over(inside), F.lit(0))).join(off, [role, "b"]).withColumn("before", F.col("before") + F.col("off"))
    share = F.when(F.lit(False), 0.0)
    for r, v in shares.items():
        share = share.when(F.col(role) == r, float(v))
    due = F.lit(float(total)) * share / steps
    return x.withColumn("step", F.floor(F.col("before") / due) + 1).where(F.col("step") <= steps).select(role, ident, F.col("step").cast("long").alias("step"))


def length_chunks(lengths: list[int], cap: int) -> list[list[int]]:
    """Positions of one batch in chunks of similar length with rows * longest <= cap; a longer row is a chunk of its own."""
    out: list[list[int]] = []
    now: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if now and (len(now) + 1) * lengths[i] > cap:
            out.append(now)
            now = []
        now.append(i)
    return [*out, now] if now else out


def micro_chunks(rows: DataFrame, batch: str, ident: str, length: str, cap: int) -> DataFrame:
    """(batch, chunk, ident): ``length_chunks`` of every batch; a batch is of bounded size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ident).reset_index(drop=True)
        got = [(pdf[batch].iloc[0], c, pdf[ident].iloc[i]) for c, chunk in enumerate(length_chunks(pdf[length].tolist(), cap)) for i in chunk]
        return pd.DataFrame(got, columns=[batch, "chunk", ident])

    kinds = dict(rows.dtypes)
    return rows.select(batch, ident, length).groupBy(batch).applyInPandas(run, f"{batch} {kinds[batch]}, chunk int, {ident} {kinds[ident]}")


def budgeted_subset(rows: DataFrame, ident: str, positives: str, budget: int, seed: str) -> DataFrame:
    """Rows admitted in seeded order while the distinct positives fit a budget; a row that does not fit is passed over.

    A row that needs more new positives than the budget has left can never fit
    later, and one that needs none always does, so only rows in between depend on
    each other. They are taken in seeded order, a bounded number at a time; all
    rows up to the last of them are then decided at once, and so on until nothing
    in between is left. Rows without positives are left out, null positives are
    none; at most ``budget`` positives and as many candidates come to the driver.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[ident]
    x = rows.where(F.col(ident).isNotNull() & (F.size(positives) > 0)).select(F.col(ident).alias("id"), F.array_distinct(F.filter(positives, lambda p: p.isNotNull())).alias("p"), H.order_key(seed, F.col(ident)).alias("h"))
    x = stage(x, "candidates")
    item = dict(x.dtypes)["p"]
    have: set = set()
    done, out = None, None  # (h, id) of the last row that is decided
    while True:
        known = F.lit(sorted(have)).cast(item) if have else F.array().cast(item)
        new = F.size(F.array_except("p", known))
        left = budget - len(have)
        after = F.lit(True) if done is None else (F.col("h") > done[0]) | ((F.col("h") == done[0]) & (F.col("id") > done[1]))
        some = x.where(after & new.between(1, left)).orderBy("h", "id").limit(max(1000, budget)).collect() if left else []  # bounded
        taken = []
        for r in some:
            more = set(r.p) - have
            if len(have) + len(more) <= budget:
                have |= more
                taken.append((r.id,))
        upto = F.lit(True) if not some else (F.col("h") < some[-1].h) | ((F.col("h") == some[-1].h) & (F.col("id") <= some[-1].id))
        one = x.where(after & upto & (new == 0)).select("id")
        if taken:
            one = one.union(spark.createDataFrame(taken, f"id {kind}"))
        out = one if out is None else out.union(one)
        if not some:
            return out.select(F.col("id").alias(ident))
        done = (some[-1].h, some[-1].id)


def topped_up(docs: DataFrame, positives: DataFrame, size: int, seed: str) -> DataFrame:
    """All positives and a uniform sample of other documents, ``size`` in all if there are so many."""
    ids = docs.select("doc_id").distinct()
    pos = ids.join(positives.select("doc_id"), "doc_id", "left_semi").withColumn("lead", F.lit(0))
    rest = ids.join(positives.select("doc_id"), "doc_id", "left_anti").withColumn("lead", F.lit(1))
    x = pos.union(rest).withColumn("h", H.order_key(seed, F.col("doc_id")))
    r = distributed_row_number(x, [], ["lead"], "h", ["doc_id"])
    return r.where((F.col("rn") <= size) | (F.col("lead") == 0)).select("doc_id", (F.col("lead") == 0).alias("positive"))


def two_pass_draw(docs: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """Full rows of n ids: ids are drawn first, so only they read the wide columns."""
    return docs.join(bounded_broadcast(lowest_hash(docs, key, n, seed)), key, "left_semi")


def best_first(rows: DataFrame, form: str, score: str, order: list[str], quota: int) -> DataFrame:
    """The ``quota`` best of each form by score, then the given order."""
    w = Window.partitionBy(form).orderBy(F.desc(score), *order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= quota)


def bucket_plan(available: dict[str, int], shares: dict[str, float], size: int) -> dict[str, int]:
    """Integer allocation of ``size`` by shares, capped by what is available, the rest filled in the order of ``shares``."""
    plan = {b: min(available.get(b, 0), int(size * s)) for b, s in shares.items()}
    for b in shares:
        plan[b] += min(available.get(b, 0) - plan[b], size - sum(plan.values()))
    return plan


def drafted_queries(docs: DataFrame, quotas: Mapping[str, int], total: int, seed: str) -> DataFrame:
    """(doc_id, kind, query) of candidates (doc_id, kind, phrase), one for a document: the quota of each kind in seeded order, topped up to ``total`` from all others in seeded order.

    Of a document with several phrases the smallest (kind, phrase) counts; white
    space in a phrase is collapsed. Kinds without a quota only top up.
    """
    one = docs.where(F.col("doc_id").isNotNull() & (F.trim("phrase") != "")).groupBy("doc_id").agg(F.min(F.struct("kind", "phrase")).alias("m")).select("doc_id", "m.kind", "m.phrase")
    quota = F.when(F.lit(False), 0)
    for k, n in quotas.items():
        quota = quota.when(F.col("kind") == k, n)
    x = seeded_numbers(one, ["kind"], "doc_id", seed).withColumn("lead", F.when(F.col("rn") <= quota.otherwise(0), 0).otherwise(1)).withColumn("h", H.order_key(seed, F.col("doc_id")))
    r = distributed_row_number(x.drop("rn"), [], ["lead"], "h", ["doc_id"])
    return r.where(F.col("rn") <= total).select("doc_id", "kind", F.trim(F.regexp_replace("phrase", r"\s+", " ")).alias("query"))


def stream_state(rows: DataFrame, ident: str, drawn: int) -> dict[str, object]:
    """What must be kept to go on with a shuffled stream after ``drawn`` rows: how many passes, the place in the pass, and the population it is of."""
    p = rows.select(ident).distinct().agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(F.col(ident).cast("string")).cast("decimal(38,0)")).cast("string").alias("digest")).first()
    if not p.n:
        raise ValueError("the stream is empty")
    return {"passes": drawn // p.n, "pos": drawn % p.n, "n": p.n, "digest": p.digest}


def stream_batch(rows: DataFrame, ident: str, size: int, seed: str, state: Mapping[str, object]) -> tuple[DataFrame, dict[str, object]]:
    """((step, ident), state after it): the next ``size`` rows of a stream that shows every row once in each pass, each pass in a new order.

    Steps count from 0. A saved state of another population is refused, as its
    place would name other rows. A batch may run over the end of a pass.
    """
    now = stream_state(rows, ident, 0)
    if (now["n"], now["digest"]) != (state["n"], state["digest"]):
        raise ValueError("the population changed since the state was saved")
    n, first = int(state["n"]), int(state["passes"]) * int(state["n"]) + int(state["pos"])
    ids, out = rows.select(ident).distinct(), None
    for p in range(first // n, (first + size - 1) // n + 1 if size else first // n):
        e = epoch_order(ids, ident, p, seed).withColumn("step", F.col("pos") + (p * n - first))
        out = e if out is None else out.union(e)
    batch = (ids.withColumn("step", F.lit(0).cast("long")).limit(0) if out is None else out.where(F.col("step").between(0, size - 1))).select("step", ident)
    return batch, {"passes": (first + size) // n, "pos": (first + size) % n, "n": n, "digest": state["digest"]}


def plan_table(available: DataFrame, shares: Mapping[str, float], size: int) -> DataFrame:
    """(bucket, available, planned): ``bucket_plan`` of (bucket, available); a bucket without a row has nothing."""
    have = {r.bucket: int(r.available) for r in available.where(F.col("bucket").isin(*shares)).collect()}  # one row a bucket
    plan = bucket_plan(have, dict(shares), size)
    return available.sparkSession.createDataFrame([(b, have.get(b, 0), n) for b, n in plan.items()], "bucket string, available long, planned long")
