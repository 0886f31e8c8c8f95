"""Token ids of whole corpora by a byte-level BPE vocabulary.

A text is cut by the vocabulary's pattern; each piece starts as single bytes.
Adjacent pairs wait in buckets, one for each merge rank, that hold positions in
a linked list; a bitmap of three levels over the ranks finds the lowest filled
bucket by find-first-set. A popped position whose pair has changed meanwhile is
stale and skipped. The cost of a piece of n bytes is O(n log n) at worst for
sorting buckets, so a very long piece does no harm. Frequent pieces are
remembered within a task, up to a bound.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that cuts text for this vocabulary. White space is Unicode's White_Space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Pieces remembered by a task, and the longest that is.
REMEMBERED, SHORT = 200_000, 64


def read_ranks(data: bytes) -> dict[bytes, int]:
    """bytes of a token -> id, from lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class RankQueue:
    """Positions by merge rank, lowest rank first."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.bucket: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        held = self.bucket.get(rank)
        if held is not None:
            held.append(position)
            return
        self.bucket[rank] = [position]
        i = rank >> 6
        self.low[i] |= 1 << (rank & 63)
        self.mid[i >> 6] |= 1 << (i & 63)
        self.top |= 1 << (i >> 6)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions in order; they leave the queue."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        m = self.mid[a]
        i = a << 6 | ((m & -m).bit_length() - 1)
        w = self.low[i]
        rank = i << 6 | ((w & -w).bit_length() - 1)
        if w := w & (w - 1):
            self.low[i] = w
        else:
            self.low[i] = 0
            self.mid[a] = m = m & (m - 1)
            if not m:
                self.top &= self.top - 1
        positions = self.bucket.pop(rank)
        if len(positions) > 1:
            positions.sort()
        return rank, positions


class Encoder:
    """Text -> ids by the ranks of a byte-level vocabulary, special tokens being ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.cut = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.known: dict[str, list[int]] = {}

    def piece(self, raw: bytes) -> list[int]:
        ranks, queue = self.ranks, self.queue
        if (whole := ranks.get(raw)) is not None:
            return [whole]
        n = len(raw)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        wait = [-1] * n  # the rank with which the pair at a position waits, -1: none
        for i in range(n - 1):
            if (r := ranks.get(raw[i : i + 2])) is not None:
                wait[i] = r
                queue.push(r, i)
        while (got := queue.pop()) is not None:
            rank, positions = got
            for i in positions:
                if wait[i] != rank:
                    continue  # stale
                j = after[i]
                end = after[j]
                after[i], wait[j], wait[i] = end, -1, -1
                if end < n:
                    before[end] = i
                    if (r := ranks.get(raw[i : after[end]])) is not None:
                        wait[i] = r
                        queue.push(r, i)
                if (p := before[i]) >= 0:
                    r = ranks.get(raw[p:end])
                    wait[p] = -1 if r is None else r
                    if r is not None:
                        queue.push(r, p)
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for s in self.cut(text):
            ids = known.get(s)
            if ids is None:
                ids = self.piece(s.encode())
                if len(s) <= SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[s] = ids
            out += ids
        return out


def _encode(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(read_ranks(vocabulary.value))
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                lists = [encoder.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])

    return run


def token_ids(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) for every row: the ids of ``text`` without special tokens.

    An empty or null text has an empty list; strings of special tokens are
    ordinary text; repeated rows stay. The vocabulary file, of fixed size, is
    read by the driver and sent to the executors.
    """
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    key = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_encode(ranks), f"doc_id {key}, ids array<int>")
