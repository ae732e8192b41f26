"""Best-fit decreasing packing of token pieces into sequences of fixed room.

Pieces of one length are interchangeable, so the packing is decided on the counts per
length: longest first, each run of equal pieces goes to the open sequences with the
tightest sufficient remaining capacity. A segment tree over the capacities finds those
in logarithmic time, and sequences in the same state are kept as ranges of numbers. The
decision therefore has a size bounded by the room, whatever the corpus holds, and equals
best-fit decreasing over all pieces. Every piece then finds its sequence by its number
among the pieces of its length, which adds a count per partition to a running number
within the partition.

Defined results: a null or empty text is the end mark alone; a document longer than the
room is cut into full pieces, of which the first may be shorter; repeated rows are packed
each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import stored, texts, vocabulary

ROOM = 2048
END = 0
#: Parts of texts one task remembers in each of two generations, and their greatest length.
PARTS, LONG_PART = 100_000, 48
_SHIFT = 44


class TokenBytes:
    """Ids of texts as little-endian 32-bit numbers.

    The pre-tokenizer begins a new word at every blank before a visible character, so parts
    cut there are encoded on their own and remembered, and a run of letters is a word apart
    from the mark behind it. New parts in Latin letters go to the rank file of the same
    vocabulary, whose library is the faster one for single words; all others, and whole texts
    that hold an added token, go to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_rank = rank_encoding(ranks) if ranks else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def forget(self) -> None:
        """Drop the remembered parts: a worker lives on, and the stages after this one need its memory."""
        self.known, self.older = {}, {}

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def part(self, part: str) -> bytes:
        """Ids of a part with the blank before it."""
        ids = self.known.get(part) or self.older.get(part)
        if ids is None:
            if part[-1] in _MARKS and part[:-1].isalpha():
                ids = self.part(part[:-1]) + self.mark(part[-1])
            elif self.by_rank is not None and max(part) < _BEYOND_LATIN:
                ids = packed(self.by_rank.encode_ordinary(" " + part))
            else:
                ids = self.whole(" " + part)
        if len(part) <= LONG_PART:
            if len(self.known) >= PARTS:
                self.older, self.known = self.known, {}
            self.known[part] = ids
        return ids

    @functools.cache
    def mark(self, mark: str) -> bytes:
        return self.whole(mark)

    def one(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return self.whole(text)
        head, *rest = _PART.split(text)
        known = self.known
        out = [known.get(part) for part in rest]
        if None in out:
            for k, ids in enumerate(out):
                if ids is None:
                    out[k] = self.part(rest[k])
        return (self.whole(head) if head else b"") + b"".join(out)


_PART = re.compile(r" (?=\S)")
_MARKS = ".,;:!?"
_BEYOND_LATIN = "\u0250"


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def rank_encoding(path: str):
    """The encoding of a rank file, cut into words by the public pattern of its vocabulary."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def token_bytes(path: str, ranks: str | None) -> TokenBytes:
    return TokenBytes(path, ranks)


def pieces(docs: DataFrame, path: str, room: int = ROOM, ranks: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, shard, place): every document's pieces;
    ``place`` numbers the pieces of one length within a shard."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, shard int, place long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = token_bytes(path, ranks)
        end = packed([END])
        seen = [0] * (room + 1)
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            places, owners = [], []
            for k, ids in enumerate(map(model.one, texts(batch))):
                ids += end
                total = len(ids) // 4
                start, piece = 0, 0
                while start < total:
                    length = (total - 1) % room + 1 if start == 0 else room
                    check = zlib.crc32(ids[4 * start:4 * (start + length)])
                    for column, value in zip(rows[1:], (piece, start, length, check)):
                        column.append(value)
                    owners.append(k)
                    places.append(seen[length])
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            take = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), pa.array(rows[1], pa.int32()),
                 *(pa.array(c, pa.int64()) for c in rows[2:]), batch.column("shard").take(take), pa.array(places, pa.int64())],
                names)
        model.forget()

    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.spark_partition_id().alias("shard"))
    return source.mapInArrow(run, schema)


class Capacities:
    """Segment tree over remaining capacities: how many ranges of open sequences have each."""

    def __init__(self, room: int):
        self.size = 1 << room.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        k = self.size + capacity
        while k:
            self.count[k] += n
            k >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that is open."""
        k = self.size + least
        if self.count[k]:
            return least
        while k > 1:
            if k & 1 == 0 and self.count[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def best_fit(counts: dict[int, int], room: int = ROOM) -> np.ndarray:
    """Runs (length, first place, first sequence, pieces per sequence, offset) for counts per length."""
    tree = Capacities(room)
    open_ranges: dict[int, list[tuple[int, int]]] = {}
    runs, fresh = [], 0

    def put(capacity: int, low: int, high: int) -> None:
        if capacity and low < high:
            open_ranges.setdefault(capacity, []).append((low, high))
            tree.add(capacity, 1)

    for length in sorted(counts, reverse=True):
        place, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, low = room, fresh
                high = fresh = fresh + -(-left // (room // length))
            else:
                low, high = open_ranges[capacity].pop()
                tree.add(capacity, -1)
            each = capacity // length
            taken = min(left, (high - low) * each)
            full, rest = divmod(taken, each)
            runs.append((length, place, low, each, room - capacity))
            put(capacity - each * length, low, low + full)
            if rest:
                put(capacity - rest * length, low + full, low + full + 1)
            put(capacity, low + full + (rest > 0), high)
            place, left = place + taken, left - taken
    return np.array(runs, dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str | None = None, room: int = ROOM, ranks: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece. ``path`` is the
    tokenizer's file and ``ranks`` optionally the rank file of the same vocabulary."""
    if path is None:
        path, ranks = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
    cut = stored(pieces(docs, path, room, ranks), "pieces")
    per = cut.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # At most ``room`` rows.
    totals = {row["length"]: row["n"] for row in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = best_fit(totals, room)
    starts = (runs[:, 0] << _SHIFT) | runs[:, 1]
    order = np.argsort(starts)
    starts, runs = starts[order], runs[order]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, place = batch.column("length").to_numpy(), batch.column("place").to_numpy()
            mine = runs[np.searchsorted(starts, (length << _SHIFT) | place, side="right") - 1]
            bins, slot = np.divmod(place - mine[:, 1], mine[:, 3])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names[:5]] + [pa.array(mine[:, 2] + bins), pa.array(mine[:, 4] + slot * length)], names)

    placed = cut.join(offsets, ["length", "shard"]).select(
        *names[:5], (F.col("place") + F.col("before")).alias("place"))
    return placed.mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
