"""Encoding of texts with a public byte-level BPE vocabulary (problem 8)."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where vocabulary files lie unless a caller names another folder.
FOLDER = "/opt/tokenizers"
#: Fixed value: the vocabulary's published pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens whose ids a Python worker remembers, up to so many; longer pre-tokens are merged each time.
REMEMBERED, REMEMBERED_LENGTH = 400_000, 64


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Bytes of each token to its rank, of a file with a base64 token and a rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class RankQueue:
    """Priority queue of positions by merge rank: a bucket per rank and a bitmap of the non-empty buckets, with two
    bitmaps over it whose bits say which word below is not zero. The next rank is three find-first-sets away."""

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (len(self.low) // 64 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, int] | None:
        """The lowest rank and its leftmost position."""
        if not self.top:
            return None
        first = (self.top & -self.top).bit_length() - 1
        bits = self.mid[first]
        word = (first << 6) + (bits & -bits).bit_length() - 1
        bits = self.low[word]
        rank = (word << 6) + (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            self.low[word] &= ~(1 << (rank & 63))
            if not self.low[word]:
                self.mid[first] &= ~(1 << (word & 63))
                if not self.mid[first]:
                    self.top &= ~(1 << first)
        return rank, position


class Encoder:
    """Ids of a text. Each pre-token is a doubly linked list of pieces; the queue gives the next pair to merge and
    pairs that changed since they were queued are skipped, so a pre-token of n bytes takes O(n log n)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        ranks, n = self.ranks, len(piece)
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        pair: list[int | None] = [None] * n

        def queue(at: int) -> None:
            nxt = after[at]
            pair[at] = rank = ranks.get(piece[at : end[nxt]]) if nxt < n else None
            if rank is not None:
                self.queue.push(rank, at)

        for at in range(n - 1):
            queue(at)
        while (found := self.queue.pop()) is not None:
            rank, at = found
            if pair[at] != rank:
                continue
            gone = after[at]
            end[at], after[at], pair[gone] = end[gone], after[gone], None
            if after[at] < n:
                before[after[at]] = at
            queue(at)
            if before[at] >= 0:
                queue(before[at])
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : end[at]]])
            at = after[at]
        return tuple(out)

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = self.merge(token.encode("utf-8", "surrogatepass"))
        if len(token) <= REMEMBERED_LENGTH:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[token] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        known = self.known
        return list(chain.from_iterable([known.get(t) or self.__missing__(t) for t in self.split(text or "")]))


_encoders: dict[str, Encoder] = {}


def worker_encoder(data: bytes, pattern: str = PATTERN) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    key = hashlib.md5(data + pattern.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(read_ranks(data), pattern)
    return _encoders[key]


def encode_texts(
    documents: DataFrame, vocabulary: str = f"{FOLDER}/byte_bpe_50k.tiktoken", pattern: str = PATTERN, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, ids)`` for every row: the token ids of its text, without special tokens; an empty array for an
    empty and for a null text. Strings of special tokens are ordinary text. Repeated rows give repeated results,
    a null doc_id stays null, other columns are ignored.

    No shuffle: rows stay in the partition they are read into. The vocabulary file (under 1 MB) is read on the
    driver and broadcast, so executors need no copy.
    """
    data = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(data.value, pattern).encode
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for start, part in _portions(texts):
                ids = [encode(t) for t in part]
                offsets = [0]
                for x in ids:
                    offsets.append(offsets[-1] + len(x))
                values = pa.array(chain.from_iterable(ids), pa.int32(), size=offsets[-1])
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([keys.slice(start, len(part)), column], ["doc_id", "ids"])

    rows = documents.select(documents[doc_id].cast("long").alias("doc_id"), documents[text].alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def _portions(texts: pa.Array, most: int = 4_000_000) -> Iterable[tuple[int, list[str | None]]]:
    """Runs of a batch with so many characters each, one text at least."""
    start, part, size = 0, [], 0
    for at, text in enumerate(texts):
        value = text.as_py()
        part.append(value)
        size += len(value or "")
        if size >= most:
            yield start, part
            start, part, size = at + 1, [], 0
    if part:
        yield start, part
