"""Exact and near duplicates.

Near duplicates are found exactly, by prefix filtering: grams are ordered from
rare to frequent, and two sets that share enough must share one of the first few
of each. Frequent grams stay out of the prefixes, so a gram that a third of all
texts hold makes no pairs. Equal gram sets are one class before any pair is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import hashing as H
from millrace.functions import text as X
from millrace.session import salted_join, stage

from .graph import labelled

#: Words of a shingle and least similarity of near duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Thresholds of the fingerprint sketches: size, shared for decontamination, shared for the diversity gate, shared for the exposure screen.
SKETCH, SHARED_DECONTAM, SHARED_GATE, SHARED_SCREEN = 32, 8, 16, 4
#: Below so many words the gate also compares 4-grams: at least half of the smaller set.
SHORT_WORDS, SHORT_K, SHORT_SHARE = 39, 4, 0.5
#: Greatest share of near duplicates that the gate lets pass, and the least rows a form keeps.
MAX_RATE, MIN_KEPT = 0.25, 50_000


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; null keys are keys too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def exact_dedup(rows: DataFrame, text: str, order: list[str], scope: list[str] | None = None) -> DataFrame:
    """The first row of each text by its words, within ``scope`` if given. Texts without words are one text."""
    x = rows.withColumn("__k", H.text_key(X.fingerprint_words(F.col(text))))
    return first_per_key(x, [*(scope or []), "__k"], order).drop("__k")


def union_in_order(parts: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """Rows of all parts, each key from the first part that holds it."""
    out = None
    for i, p in enumerate(parts):
        x = p.withColumn("segment", F.lit(i))
        out = x if out is None else out.unionByName(x)
    return first_per_key(out, [key], ["segment", *order])


def two_key_first(rows: DataFrame, a: str, b: str, order: list[str]) -> DataFrame:
    """Rows whose both keys are first: one row of each ``a``, then one of each ``b`` among them."""
    return first_per_key(first_per_key(rows, [a], order), [b], order)


def gram_classes(rows: DataFrame, ident: str, grams: Column) -> tuple[DataFrame, DataFrame]:
    """(members (id, set_id), sets (set_id, grams, n)): equal gram sets are one; rows without grams are absent."""
    g = rows.select(F.col(ident).alias("id"), F.array_sort(F.array_distinct(grams)).alias("grams"))
    # filtered after it is written, else the grams would be computed for the filter too
    g = stage(g.withColumn("set_id", F.md5(F.array_join(F.transform("grams", lambda x: x.cast("string")), ","))), "grams").where(F.size("grams") > 0)
    sets = g.groupBy("set_id").agg(F.first("grams").alias("grams"), F.min("id").alias("first_id")).withColumn("n", F.size("grams"))
    return g.select("id", "set_id"), stage(sets, "sets")


def _placed(sets: DataFrame) -> DataFrame:
    """(set_id, gram, i, n): the grams of each set with their place, rare first, then by gram, and the set's size. Grams of one set alone count for the places but are left out, as they can't be shared."""
    posted = sets.select("set_id", "n", F.explode("grams").alias("gram"))
    df = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    every = Window.partitionBy("set_id")
    # grams that no other set has come first in the order: how many there are is known without sorting them
    shared = salted_join(posted, df.where("df > 1"), ["gram"], ["set_id"])
    place = F.col("n") - F.count(F.lit(1)).over(every) + F.row_number().over(every.orderBy("df", "gram"))
    return shared.select("set_id", "gram", place.alias("i"), "n")


def similar_sets(sets: DataFrame, prefix: Column, enough: Column, compatible: Column | None = None, least: Column | None = None, smaller_first: bool = False) -> DataFrame:
    """(a, b, shared), a before b: pairs of sets that meet in a prefix and satisfy ``enough`` over (shared, n, m).

    ``prefix`` is how many of the rarest grams of a set of n must hold a shared one.
    ``least``, over (n, m), is the fewest grams that ``enough`` asks for: what
    comes after the first shared gram of a pair must make up for the rest. With
    ``smaller_first`` the prefix is that of the smaller set only, and meets all
    grams of the larger one.
    """
    p = stage(_placed(sets), "grams")
    head = p.where(F.col("i") <= prefix)
    cond = F.col("a") < F.col("b")
    if smaller_first:
        cond = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & cond)
    if compatible is not None:
        cond = cond & compatible
    left = head.select(F.col("set_id").alias("a"), "gram", "n", "i")
    right = (p if smaller_first else head).select(F.col("set_id").alias("b"), "gram", F.col("n").alias("m"), F.col("i").alias("j"))
    met = salted_join(left, right, ["gram"], ["a"]).where(cond).groupBy("a", "b").agg(F.min("i").alias("i"), F.min("j").alias("j"), F.first("n").alias("n"), F.first("m").alias("m"))
    if least is not None:
        met = met.where(1 + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= least)
    cand = met.select("a", "b")
    ga, gb = sets.select(F.col("set_id").alias("a"), F.col("grams").alias("x"), "n"), sets.select(F.col("set_id").alias("b"), F.col("grams").alias("y"), F.col("n").alias("m"))
    full = salted_join(salted_join(cand, ga, ["a"], ["b"]), gb, ["b"], ["a"]).withColumn("shared", F.size(F.array_intersect("x", "y")))
    ordered = F.col("a") < F.col("b")
    return full.where(enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", F.when(ordered, F.col("n")).otherwise(F.col("m")).alias("n"), F.when(ordered, F.col("m")).otherwise(F.col("n")).alias("m"))


def near_duplicate_classes(docs: DataFrame, ident: str = "doc_id", text: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id, links): the class of near duplicates of each document.

    Documents are tied if the Jaccard similarity of their k-word shingles is at
    least ``similarity``; ties carry over. ``class_id`` is the smallest id of the
    class, ``links`` the number of other gram sets the document's own is tied to.
    A text of fewer words is one shingle. Texts without words are classes of
    their own, as are null texts.
    """
    grams = A.gram_keys(X.fingerprint_words(F.col(text)), k)
    members, sets = gram_classes(docs, ident, grams)
    need = F.ceil(F.col("n") * similarity - 1e-9)
    lengths = (F.col("n") >= F.col("m") * similarity - 1e-9) & (F.col("m") >= F.col("n") * similarity - 1e-9)
    jaccard = F.col("shared") >= (F.col("n") + F.col("m") - F.col("shared")) * similarity - 1e-9
    fewest = F.ceil((F.col("n") + F.col("m")) * (similarity / (1 + similarity)) - 1e-9)
    pairs = stage(similar_sets(sets, F.col("n") - need + 1, jaccard, lengths, fewest), "pairs")
    roots = labelled(sets.select(F.col("set_id").alias("node")), pairs)
    links = pairs.select("a").union(pairs.select("b")).groupBy(F.col("a").alias("set_id")).agg(F.count(F.lit(1)).alias("links"))
    of_set = roots.withColumnRenamed("node", "set_id").join(sets.select("set_id", "first_id"), "set_id")
    class_of = of_set.groupBy("root").agg(F.min("first_id").alias("class_id"))
    table = salted_join(of_set.select("set_id", "root"), class_of, ["root"], ["set_id"]).join(links, "set_id", "left").select("set_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    found = salted_join(members, table, ["set_id"], ["id"]).select("id", "class_id", "links")
    rest = docs.select(F.col(ident).alias("id")).join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return found.union(rest).distinct()


def diversity_gate(rows: DataFrame, ident: str, text: str, shared: int = SHARED_GATE, share: float = SHORT_SHARE) -> DataFrame:
    """The gate at one ``share``, see ``diversity_gates``."""
    return diversity_gates(rows, ident, text, [share], shared)[0]


def diversity_gates(rows: DataFrame, ident: str, text: str, shares: list[float], shared: int = SHARED_GATE) -> list[DataFrame]:
    """(id, status): 'exact' for repeats of an earlier text, 'near' for near duplicates of any earlier one, else 'kept'; earlier is a smaller id.

    Near: at least ``shared`` of 32 sketch keys of the 8-grams, or for texts under
    39 words a share of the smaller set of 4-grams, one result for each of ``shares``.
    Earlier texts count even if they are near duplicates themselves.
    """
    w = X.fingerprint_words(F.col(text))
    x = stage(rows.select(F.col(ident).alias("id"), w.alias("w")).withColumn("key", H.text_key(F.col("w"))), "words")
    first = x.groupBy("key").agg(F.min("id").alias("first"))
    x = salted_join(x, first, ["key"], ["id"])
    order = stage(x.where("id = first").drop("first", "key"), "order")

    def hits(classes: tuple[DataFrame, DataFrame], prefix: Column, enough: Column, least: Column, smaller_first: bool = False) -> tuple[DataFrame, Column, Column]:
        members, sets = classes
        pairs = similar_sets(sets, prefix, enough, None, least, smaller_first)
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.join(sets.select(F.col("set_id").alias("b"), "first_id"), "b").groupBy(F.col("a").alias("set_id")).agg(F.min("first_id").alias("other"))
        known = sets.select("set_id", "first_id", "n").join(low, "set_id", "left")
        j = salted_join(members, known, ["set_id"], ["id"])
        return j, (F.col("other") < F.col("id")), (F.col("first_id") < F.col("id"))

    long = gram_classes(order, "id", A.bottom(A.gram_keys(F.col("w")), SKETCH))
    j, near, same = hits(long, F.greatest(F.lit(1), F.col("n") - shared + 1), F.col("shared") >= shared, F.lit(shared))
    long_hits = j.where(near | (same & (F.col("n") >= shared))).select("id")
    if len(shares) > 1:
        long_hits = stage(long_hits, "long")
    short = gram_classes(order.where(F.size("w") < SHORT_WORDS), "id", A.gram_keys(F.col("w"), SHORT_K))
    out = []
    for share in shares:
        fewest = F.ceil(F.least("n", "m") * share - 1e-9)
        j, near, same = hits(short, F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1, F.col("shared") >= F.least("n", "m") * share, fewest, True)
        dup = long_hits.union(j.where(near | same).select("id")).distinct().withColumn("near", F.lit(True))
        known = order.select("id").join(dup, "id", "left").select("id", F.when(F.col("near"), "near").otherwise("kept").alias("status"))
        out.append(known.union(x.where("id <> first").select("id", F.lit("exact"))))
    return out


def gate_report(status: DataFrame, max_rate: float = MAX_RATE, min_kept: int = MIN_KEPT) -> DataFrame:
    """One row: counts, the rate of near duplicates among distinct texts, what is kept and whether the form is dropped.

    Above ``max_rate`` only the first of near duplicates are kept; the decision
    uses the unrounded rate.
    """
    c = status.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "exact").alias("exact"), F.count_if(F.col("status") == "near").alias("near"))
    order = F.col("n") - F.col("exact")
    rate = F.col("near") / F.greatest(order, F.lit(1))
    kept = F.when(rate > max_rate, order - F.col("near")).otherwise(order)
    return c.select("n", "exact", "near", F.round(rate, 5).alias("rate"), F.when(rate > max_rate, "representatives").otherwise("distinct").alias("action"), kept.alias("kept"), (kept < min_kept).alias("dropped"))


def diversity_curve(status: DataFrame, prefixes: list[int]) -> DataFrame:
    """(n, rate): share of near duplicates among the first n distinct texts in order of id, for each n of a short list."""
    x = status.where("status <> 'exact'").select("id", (F.col("status") == "near").cast("int").alias("near"))
    out = None
    for n in prefixes:
        one = x.orderBy("id").limit(n).agg(F.lit(n).alias("n"), F.round(F.avg("near"), 9).alias("rate"))
        out = one if out is None else out.union(one)
    return out
