"""Functions of arrays: k-grams, vectors, quantisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import key60


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often and wherever ``body`` uses it.

    Inside lambdas an expression is evaluated again for every element; a bound
    value is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def kgrams(words: Column, k: int, short_whole: bool = False) -> Column:
    """Windows of k words joined by blanks, in order. Shorter lists give [], or themselves with ``short_whole``."""

    def windows(w: Column) -> Column:
        n = F.size(w)
        every = F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(w, i, k), " ")))
        short = F.when(n > 0, F.array(F.array_join(w, " "))) if short_whole else F.lit(None)
        return F.coalesce(every, short, F.array().cast("array<string>"))

    return let(words, windows)


def gram_keys(words: Column, k: int = 8, short_whole: bool = True) -> Column:
    """Distinct keys of the k-grams; a text of fewer words is one gram, an empty one has none."""
    return F.array_distinct(F.transform(kgrams(words, k, short_whole), key60))


def query_gram_keys(words: Column) -> Column:
    """Query side: 8-grams, and 4-grams too for texts of 4 to 7 words."""
    return let(words, lambda w: F.when(F.size(w).between(4, 7), F.array_union(gram_keys(w), gram_keys(w, 4, False))).otherwise(gram_keys(w)))


def bottom(keys: Column, n: int = 32) -> Column:
    """The n smallest distinct keys."""
    return F.slice(F.array_sort(F.array_distinct(keys)), 1, n)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if a length differs."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalized(a: Column, floor: float = 1e-12) -> Column:
    """Unit length, the norm being at least ``floor``."""
    return let(F.greatest(norm(a), F.lit(floor)), lambda n: F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null if a vector is zero or a length differs."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def int8_scale(a: Column) -> Column:
    """Greatest absolute value / 127, 1 for a zero vector."""
    m = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    return F.when(m > 0, m / 127.0).otherwise(1.0)


def quantize_int8(a: Column, scale: Column) -> Column:
    """Codes in [-127, 127], rounded half to even."""
    return F.transform(a, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x.cast("double") / scale))).cast("tinyint"))


def dequantize_int8(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda x: x.cast("double") * scale)


def pool_weight(count: Column, mode: str) -> Column:
    """Weight of a token that occurs ``count`` times: mean, presence, capped at 2, or square root."""
    c = count.cast("double")
    return {"mean": c, "presence": F.lit(1.0), "cap2": F.least(F.lit(2.0), c), "sqrt": F.sqrt(c)}[mode]
