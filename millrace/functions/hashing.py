"""Keys, samples and orders from hashes that other SQL engines can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\u001f"


def key60(value: Column) -> Column:
    """A key of 60 bits: the first 15 hex digits of the md5 as a number."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def text_key(words: Column) -> Column:
    """Key of a text by its words; equal for texts of the same words."""
    return key60(F.array_join(words, " "))


def sha_mod(value: Column, modulus: int) -> Column:
    """The sha256 of ``value`` as a number of 256 bits modulo ``modulus``, exactly: Horner over eight groups of hex digits."""
    digest = F.sha2(value, 256)
    base = 16**8 % modulus
    acc = F.lit(0).cast("long")
    for i in range(8):
        acc = (acc * base + F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")) % modulus
    return acc


def held_out(source: Column, qid: Column, one_in: int = 50) -> Column:
    """Whether sha256(source:qid) modulo ``one_in`` is 0."""
    return sha_mod(F.concat_ws(":", source, qid), one_in) == 0


def half(qid: Column) -> Column:
    """0 or 1: parity of the sha256 of the id."""
    return F.conv(F.substring(F.sha2(qid, 256), 64, 1), 16, 10).cast("int") % 2


def unit(*parts: Column) -> Column:
    """A value in [0, 1) from the first 52 bits of the sha256 of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws(SEPARATOR, *parts), 256), 1, 13), 16, 10).cast("double") / float(2**52)


def order_key(seed: str, *parts: Column) -> Column:
    """Hex digits that put rows in a seeded order."""
    return F.md5(F.concat_ws(SEPARATOR, F.lit(seed), *[p.cast("string") for p in parts]))
