"""Evaluation texts that occur in a corpus, fully or in part, by winnowing.

Words are hashed, every k words give a fingerprint, and of every w consecutive
fingerprints the smallest is kept. Two texts that share w + k - 1 words in a row
then share a kept fingerprint, for certain. Kept fingerprints of the corpus are
joined to those of the items, and each hit is extended word by word to see
whether the shared span is long enough. Items that are shorter than a full span
have fingerprints of fewer words, kept more densely, so that they too are found
for certain.

Both sides carry the words around each fingerprint, as many as an extension can
need, so hits are settled where they meet and no text is read twice. A bitmap of
the items' fingerprints, of bounded size, lets most fingerprints of the corpus
go before the join; it never drops one that an item has. Words are cut and
hashed for a whole block of texts at a time.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import BROADCAST_BYTES, plan_bytes, salted_join, stage

from .look_alikes import as_latin, comparable, folded_texts, remembered, repair_table, repaired, with_repairs

SPAN = 12
#: Words of a fingerprint at most.
K = 5
#: Bits of the bitmap at most: 8 MB for each task.
BITS = 26
#: Characters that are cut into words at once; a longer text is cut in pieces between words.
BLOCK = 1 << 20
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, without letter case."""
    return [w.casefold() for w in _WORD.findall(text)] if text else []


def classes(span: int) -> list[tuple[int, int, int]]:
    """(words of the shortest item, k, w) with k + w - 1 being that many words: for items of a full span, then of half as many, down to one word."""
    out = []
    least = span
    while least:
        k = min(K, (least + 1) // 2)
        out.append((least, k, least - k + 1))
        least //= 2
    return out


@functools.lru_cache(1)
def letters() -> bytes:
    """A bit for each code point that is a letter or digit."""
    return np.packbits(np.fromiter((unicodedata.category(chr(i))[0] in "LN" for i in range(0x110000)), bool, 0x110000)).tobytes()


class Words:
    """The words of many texts at once: for each its text, hash and place."""

    def __init__(self, is_letter: bytes):
        self.is_letter = np.unpackbits(np.frombuffer(is_letter, np.uint8)).astype(bool)
        self._powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """P^i and P^-i modulo 2^64 for i below n."""
        if len(self._powers[0]) < n:
            n = max(n, 2 * len(self._powers[0]))
            self._powers = tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, p, np.uint64)]) for p in (_P, pow(_P, -1, 2**64)))
        return self._powers

    def _block(self, shown: str, folded: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of each word of a string; ``shown`` says where words are, ``folded`` what they are."""
        code = np.frombuffer(shown.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.zeros(len(code) + 2, np.int8)
        inside[1:-1] = self.is_letter[code]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if folded is not shown:
            code = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32)
        up, down = self.powers(len(code) + 1)
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(code * up[: len(code)], out=total[1:])
        h = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return start, end, h

    def of(self, texts: list[str]) -> Iterator[tuple[int, str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks (first text, characters, text of each word, start, end, hash); a text is never in two blocks."""
        at = 0
        while at < len(texts):
            size, to = len(texts[at]), at + 1
            while to < len(texts) and size + len(texts[to]) < BLOCK:
                size += len(texts[to]) + 1
                to += 1
            yield at, *self._texts(texts[at:to])
            at = to

    def _texts(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        low = [t.casefold() for t in texts]
        shown = [t if len(t) == len(f) else "" for t, f in zip(texts, low, strict=True)]
        for i, t in enumerate(texts):
            if len(t) != len(low[i]):  # folding makes some letter longer: words first
                found = words_of(t)
                low[i], shown[i] = " ".join(found), " ".join("a" * len(w) for w in found)
        chars, mask = "\n".join(low), "\n".join(shown)
        parts, cut = [], 0
        while cut < len(chars) or not parts:  # pieces of a very long text end between words
            to = min(len(chars), cut + 2 * BLOCK)
            while to < len(chars) and self.is_letter[ord(mask[to])]:
                to += 1
            s, e, h = self._block(mask[cut:to], chars[cut:to])
            parts.append((s + cut, e + cut, h))
            cut = to
        start, end, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        first = np.cumsum([0, *[len(t) + 1 for t in low]])
        return chars, np.searchsorted(first, start, "right") - 1, start, end, h


def winnow(h: np.ndarray, k: int, w: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, word positions) kept of word hashes; nothing of a text below k + w - 1 words.

    ``of`` numbers the text of each word where there are several, one after the other.
    """
    n = len(h) - k + 1
    if n < w:
        return h[:0], np.zeros(0, np.int64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g = g * np.uint64(_P) + h[j : j + n]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    inside = slice(None) if of is None else of[: len(h) - k - w + 2] == of[k + w - 2 :]
    if w == 1:
        at = np.arange(n)[inside]
        return g[at], at
    # the last of equal ones: a running minimum over the window from its right end
    best, place = g[w - 1 :].copy(), np.arange(w - 1, n)
    for j in range(w - 2, -1, -1):
        other = g[j : j + len(best)]
        less = other < best
        best[less] = other[less]
        place[less] = np.arange(j, j + len(best))[less]
    place = place[inside]
    mark = np.zeros(n, bool)
    mark[place] = True
    at = np.flatnonzero(mark)
    return g[at], at


def _fingerprints(used: list[tuple[int, int, int]], span: int, is_letter: bytes, repairs, bitmap, by_class: bool):
    """mapInArrow function over (id, text[, own]): (id, class, fingerprint, words around it, place in them), each once for a text.

    With ``by_class`` a text has the fingerprints of the one class that its number of words belongs to, as items do; else of all ``used`` classes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, latin = Words(is_letter), remembered(as_latin)
        common = None if repairs is None else repairs.value
        bits = None if bitmap is None else np.unpackbits(np.frombuffer(bitmap.value, np.uint8)).astype(bool)
        for b in batches:
            own = [dict(x or []) for x in b.column(2).to_pylist()] if common is None else None
            ids = b.column(0)
            texts = [comparable(repaired(t, common if own is None else own[i]), latin) if t else "" for i, t in enumerate(b.column(1).to_pylist())]
            for first, chars, of, start, end, h in words.of(texts):
                count = np.bincount(of) if len(of) else np.zeros(0, np.int64)
                low = np.searchsorted(of, of, "left")
                for c, (least, k, w) in enumerate(used):
                    g, at = winnow(h, k, w, of)
                    if by_class:
                        n = count[of[at]]
                        ok = (n >= least) & ((n < used[c - 1][0]) if c else True)
                        g, at = g[ok], at[ok]
                    elif bits is not None:
                        ok = bits[(g >> np.uint64(64 - (len(bits).bit_length() - 1))).astype(np.int64)]
                        g, at = g[ok], at[ok]
                    if not len(at):
                        continue
                    lo = np.maximum(at - (span - 1), low[at])
                    hi = np.minimum(at + span, low[at] + count[of[at]])
                    seen: set[tuple[int, int, str, int]] = set()
                    for i, x, p, q, a in zip(of[at].tolist(), g.view(np.int64).tolist(), lo.tolist(), hi.tolist(), at.tolist(), strict=True):
                        around = " ".join([chars[s:e] for s, e in zip(start[p:q].tolist(), end[p:q].tolist(), strict=True)])
                        seen.add((first + i, x, around, a - p))
                    n_words = count if by_class else None
                    yield _rows(ids, c, sorted(seen), None if n_words is None else {first + i: int(n) for i, n in enumerate(n_words)})

    return run


def _rows(ids: pa.Array, c: int, rows: list[tuple[int, int, str, int]], words: dict[int, int] | None) -> pa.RecordBatch:
    columns = [ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([c] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int32())]
    names = ["id", "class", "fp", "around", "place"]
    if words is not None:
        columns.append(pa.array([words[r[0]] for r in rows], pa.int64()))
        names.append("n")
    return pa.RecordBatch.from_arrays(columns, names)


def _bitmap(prints: DataFrame) -> bytes:
    """Which of 2^b leading bit patterns the fingerprints have, b growing with their number up to BITS; built in pieces of 1 KB."""
    bits = min(BITS, max(16, (64 * prints.count()).bit_length()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy(zero_copy_only=False)
            for piece in np.unique(at >> 13).tolist():
                pieces.setdefault(piece, np.zeros(1 << 13, bool))[at[at >> 13 == piece] & 8191] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int64()), pa.array([np.packbits(p).tobytes() for p in pieces.values()], pa.binary())], ["piece", "packed"])

    at = prints.select(F.shiftrightunsigned("fp", 64 - bits).alias("at")).distinct()
    out = bytearray(1 << (bits - 3))
    for r in at.repartition(F.shiftright("at", 13)).mapInArrow(pack, "piece long, packed binary").collect():  # at most 2^BITS bits
        for i, x in enumerate(r.packed, r.piece << 10):
            out[i] |= x
    return bytes(out)


@F.pandas_udf(T.BooleanType())
def extends(a: pd.Series, p: pd.Series, b: pd.Series, q: pd.Series, need: pd.Series) -> pd.Series:
    """Whether two runs of words that meet at places p and q share ``need`` words in a row across them."""

    def one(a: list[str], p: int, b: list[str], q: int, need: int) -> bool:
        i = 0
        while i < min(p, q) and a[p - i - 1] == b[q - i - 1]:
            i += 1
        a, b = a[p - i :], b[q - i :]
        n = 0
        while n < min(len(a), len(b), need) and a[n] == b[n]:
            n += 1
        return n >= need

    return pd.Series([one(x.split(" "), i, y.split(" "), j, n) for x, i, y, j, n in zip(a, p, b, q, need, strict=True)], dtype=bool)


def leaks(documents: DataFrame, items: DataFrame, span: int = SPAN, broadcast_bytes: int = BROADCAST_BYTES // 4) -> DataFrame:
    """(doc_id, item_id): documents that hold ``span`` consecutive words of an item in order, or a shorter item whole.

    Words are compared without letter case, in the consistent form for
    look-alike characters. Null and blank texts and items, and null ids, are in
    no case; items of equal text are each reported; repeated rows count once.
    Every case is found for any ``span`` of 1 or more. The items' fingerprints
    are broadcast up to ``broadcast_bytes``, beyond that both sides are shuffled.
    """
    if span < 1:
        raise ValueError("a span has at least one word")
    spark = documents.sparkSession
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    tests = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    doc_texts = stage(folded_texts(docs, "doc_id"), "folded")
    item_texts = stage(folded_texts(tests, "item_id"), "items")
    table = stage(repair_table([doc_texts, item_texts]), "repairs")
    schema = "id {}, class int, fp long, around string, place int"
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    rows, common = with_repairs(item_texts, table, "item_id")
    every = classes(span)
    of_items = rows.mapInArrow(_fingerprints(every, span, letters(), common, None, True), schema.format(kind(items, "item_id")) + ", n long").distinct()
    of_items = stage(of_items.select(F.col("id").alias("item_id"), "class", "fp", F.col("around").alias("b"), F.col("place").alias("q"), F.least(F.lit(span).cast("long"), "n").alias("need")), "prints")
    # only classes that some item is of are looked for
    there = sorted(r[0] for r in of_items.select("class").distinct().collect())  # at most log2(span) + 1
    if not there:
        return spark.createDataFrame([], f"doc_id {kind(documents, 'doc_id')}, item_id {kind(items, 'item_id')}")
    of_items = of_items.withColumn("class", F.array_position(F.lit(there), F.col("class")).cast("int") - 1)
    bitmap = spark.sparkContext.broadcast(_bitmap(of_items))
    rows, common = with_repairs(doc_texts, table, "doc_id")
    used = [every[c] for c in there]
    of_docs = rows.mapInArrow(_fingerprints(used, span, letters(), common, bitmap, False), schema.format(kind(documents, "doc_id"))).select(F.col("id").alias("doc_id"), "class", "fp", "around", "place")
    if plan_bytes(of_items) <= broadcast_bytes:
        hits = of_docs.join(F.broadcast(of_items), ["class", "fp"])
    else:
        hits = salted_join(of_docs, of_items, ["class", "fp"], ["doc_id"])
    return hits.where(extends("around", "place", "b", "q", "need")).select("doc_id", "item_id").distinct()
