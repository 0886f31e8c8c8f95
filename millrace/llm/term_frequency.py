"""How often every term occurs, in how many records, and which terms are too rare or too common.

Every row emits its (term, document) and (term, context) pairs; hash aggregation
combines them within each map task before the shuffle, keyed by the pair, so a
term that holds a third of all rows spreads over all tasks. Counts per pair are
then summed per term, again combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .related_splits import bare

MIN_DOCS = 3
MAX_SHARE_PERCENT = 8


def _pairs(stats: DataFrame, column: str) -> DataFrame:
    """(term, element, times, reports) for the non-null elements; the element is null where a row has none.

    ``times`` counts every occurrence, ``reports`` each shard once: a shard may
    have reported a term twice, in full or in part.
    """
    shard = F.col("shard") if "shard" in stats.columns else F.lit(None).cast("int")
    x = stats.where(F.col("term").isNotNull()).select(bare(F.col("term")).alias("term"), shard.alias("shard"), F.explode_outer(column).alias("e"))
    once = x.groupBy("term", "e", "shard").agg(F.count("e").alias("times"))
    return once.groupBy("term", "e").agg(F.sum("times").alias("times"), F.count("e").alias("reports"))


def term_frequency(stats: DataFrame, min_docs: int = MIN_DOCS, max_share_percent: int = MAX_SHARE_PERCENT) -> DataFrame:
    """(term, docs, contexts, doc_occurrences, context_occurrences, doc_reports, context_reports, mark) for every term over all shards.

    Terms are compared in lower case without outer blanks; null terms are left
    out, a blank term is the term ''. ``docs`` and ``contexts`` count distinct
    non-null elements. The occurrences count every repeat; the reports count an
    element once for each shard, however often the shard reported it; rows
    without a shard are one shard. ``mark`` is 'rare' below ``min_docs``
    documents, 'common' above ``max_share_percent`` percent of all distinct
    documents of the table, else null; a term that is both is rare.
    """
    docs = _pairs(stats, "docs")
    total = docs.where(F.col("e").isNotNull()).select("e").distinct().agg(F.count(F.lit(1)).alias("all_docs"))
    count = lambda df, one, name: df.groupBy("term").agg(F.count("e").alias(name), F.sum("times").alias(f"{one}_occurrences"), F.sum("reports").alias(f"{one}_reports"))
    x = count(docs, "doc", "docs").join(count(_pairs(stats, "contexts"), "context", "contexts"), "term").crossJoin(F.broadcast(total))  # one row
    mark = F.when(F.col("docs") < min_docs, "rare").when(F.col("docs") * 100 > F.col("all_docs") * max_share_percent, "common")
    return x.select("term", "docs", "contexts", "doc_occurrences", "context_occurrences", "doc_reports", "context_reports", mark.alias("mark"))


def marked_terms(stats: DataFrame) -> DataFrame:
    """(term, mark) of the terms that are rare or common."""
    return term_frequency(stats).where("mark is not null").select("term", "mark")
