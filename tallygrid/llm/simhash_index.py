"""SimHash near-duplicates found through a Gray-order hierarchical index.

A fingerprint has bit k set if more than half of the text's word shingles have it set in
their XXH64. Equal fingerprints are one code from the start. The codes are sorted by their
Gray rank, the place at which the reflected Gray sequence visits them, so that neighbours in
the order share long masked bit patterns. An upper node stands for a run of neighbours and
holds the bits all of them share; a child keeps only the shared bits that its parent does
not hold already. A search goes down from the root, adds up the differing bits met so far,
and leaves a node with its whole group as soon as the sum is above the distance.

On Spark the order is cut into ranges by quantiles of the rank in a sample. The ranges' shared patterns
form the upper part of the index, which every task has: it sends a code to the later ranges
whose accumulated difference is small enough. A task builds the lower part over the codes of
one range and searches it with the codes that were sent there, in batches. Both the number
of ranges and their size grow with the square root of the number of codes, so the upper part
stays small (8 MB for 10^14 codes) and so does a task's own part. No code can have more than
2081 others within two bits, so no group of near copies makes a task's work quadratic.
Tasks give spanning forests of links, whose connected components are the groups.

Defined results: a null text, or one without a word, has fingerprint zero and is linked like
any other; a text of fewer words than a shingle has one shingle; repeated rows are copies; a
null id counts for no component's smallest id, and a component without ids has a null one;
texts of any length are hashed whole; an empty table gives an empty result; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import map_batches, stored
from tallygrid.llm.ngram_join import components

WORDS, SEED, DISTANCE = 3, 42, 2
#: Children of a node of the index.
FAN = 8
#: Ranges per square root of the number of codes, and sampled codes per range.
RANGES, SAMPLED = 1 / 8, 64
#: Queries searched at once.
BATCH = 8192
_LANES = np.uint64(0x0101010101010101)


def fingerprint(raw: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The 64 majority bits of a text's shingle hashes."""
    from xxhash import xxh64_intdigest

    found = raw.lower().split()  # of bytes: A-Z, and exactly the six blanks of ASCII
    if not found:
        return 0
    width = min(words, len(found))
    shingles = map(b" ".join, zip(*(found[k:] for k in range(width))))
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(found) - width + 1)
    # Eight bits are counted at once in the bytes of one number; 255 numbers fill a byte at most.
    padded = np.zeros(-(-len(hashes) // 255) * 255, np.uint64)
    padded[:len(hashes)] = hashes
    bits = np.zeros((8, 8), np.int64)
    for k in range(8):
        lanes = ((padded >> np.uint64(k)) & _LANES).reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        bits[:, k] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits.reshape(-1) > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, code): every document's fingerprint as a signed 64-bit number."""
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            codes = np.array([fingerprint(t or b"", words, seed) for t in batch.column("raw").to_pylist()], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes.view(np.int64))], ["doc_id", "code"])
        return work
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    return map_batches(source, "doc_id long, code long", make)


def gray_rank(code: Column) -> Column:
    """Place of a code in the reflected Gray sequence, as a signed number in the same order."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Codes or masked patterns in Gray order below nodes that hold what their children share.

    A leaf is given by the bits all its codes have (``low``) and the bits any has (``high``).
    """

    def __init__(self, low: np.ndarray, high: np.ndarray):
        bounds = [(low, high)]
        while len(bounds[-1][0]) > 1:
            starts = np.arange(0, len(bounds[-1][0]), FAN)
            bounds.append((np.bitwise_and.reduceat(bounds[-1][0], starts), np.bitwise_or.reduceat(bounds[-1][1], starts)))
        self.levels = []  # from the root: (pattern, the shared bits that no node above holds)
        above = None
        for a, b in reversed(bounds):
            shared = ~(a ^ b)
            own = shared if above is None else shared & ~above[np.arange(len(a)) // FAN]
            self.levels.append((a, own))
            above = shared

    def search(self, codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of all leaves whose accumulated difference from the query is small enough."""
        query, node, spent = np.arange(len(codes)), np.zeros(len(codes), np.int64), np.zeros(len(codes), np.uint8)
        if not len(self.levels[-1][0]):
            return query[:0], node[:0]
        for depth, (pattern, own) in enumerate(self.levels):
            if depth:
                query, spent = np.repeat(query, FAN), np.repeat(spent, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).reshape(-1)
                inside = node < len(pattern)
                query, node, spent = query[inside], node[inside], spent[inside]
            spent = spent + np.bitwise_count((codes[query] ^ pattern[node]) & own[node])
            near = spent <= distance
            query, node, spent = query[near], node[near], spent[near]
        return query, node


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of ``n`` numbers reaches over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while not np.array_equal(above := label[label], label):
            label = above
    return label


def ranged(codes: DataFrame) -> DataFrame:
    """(code, place, range): every code with its Gray rank and the number of its range."""
    n = codes.count()
    count = max(1, math.ceil(math.sqrt(n) * RANGES))
    placed = codes.select("code", gray_rank(F.col("code")).alias("place"))
    # The sample is taken by hash, so it is the same in every run; the driver sees 8 numbers per square root of the codes.
    sampled = placed.where(F.pmod(F.xxhash64("code"), F.lit(max(1, n // (count * SAMPLED)))) == 0).select("place").toArrow()
    places = np.sort(sampled["place"].to_numpy())
    bounds = np.unique(places[[k * len(places) // count for k in range(1, count)]]) if len(places) else places

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = np.searchsorted(bounds, batch.column("place").to_numpy(), side="right")
            return pa.RecordBatch.from_arrays(
                [batch.column("code"), batch.column("place"), pa.array(at.astype(np.int32))], ["code", "place", "range"])
        return work
    return map_batches(placed, "code long, place long, range int", make)


def routed(codes: DataFrame, distance: int) -> DataFrame:
    """(range, own, code, place): every code in its own range and in each later one that may hold a code near it."""
    nodes = codes.groupBy("range").agg(
        F.expr("bit_and(code)").alias("low"), F.expr("bit_or(code)").alias("high")).orderBy("range").toPandas()
    number = nodes["range"].to_numpy(np.int32)
    low, high = (nodes[c].to_numpy(np.int64).view(np.uint64) for c in ("low", "high"))

    def make():
        upper = GrayIndex(low, high)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = batch.column("range").to_numpy()
            query, node = upper.search(batch.column("code").to_numpy().view(np.uint64), distance)
            later = number[node] >= own[query]
            query, at = query[later], number[node[later]]
            return pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(at == own[query]), batch.column("code").take(pa.array(query)),
                 batch.column("place").take(pa.array(query))], ["range", "own", "code", "place"])
        return work
    return map_batches(codes, "range int, own boolean, code long, place long", make)


class Range:
    """The codes of one range, searched by the codes sent to it; keeps a spanning forest of the links."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.index: GrayIndex | None = None

    def add(self, codes: np.ndarray) -> None:
        self.parts.append(codes)

    def build(self) -> None:
        self.codes = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint64)
        self.index = GrayIndex(self.codes, self.codes)
        self.label = np.arange(len(self.codes))

    def links(self, codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(code, one code of the range near it); that other codes of the range are near it too is kept."""
        firsts = []
        for start in range(0, len(codes), BATCH):
            query, leaf = self.index.search(codes[start:start + BATCH], distance)
            _, where, back = np.unique(query, return_index=True, return_inverse=True)
            self.join(leaf, leaf[where][back])
            firsts.append((codes[start + query[where]], self.codes[leaf[where]]))
        a, b = zip(*firsts)
        return np.concatenate(a), np.concatenate(b)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        self.label = roots(len(self.codes), self.label[a], self.label[b])[self.label]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.label != np.arange(len(self.codes)))
        return self.codes[child], self.codes[self.label[child]]


def links(codes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between different codes whose components are those of all pairs within the distance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            other = a != b
            return pa.RecordBatch.from_arrays(
                [pa.array(x[other].view(np.int64)) for x in (a, b)], ["a", "b"])

        def close():
            if now is not None:
                if now.index is None:
                    now.build()
                yield rows(*now.links(now.codes, distance)) if len(now.codes) else rows(now.codes, now.codes)
                yield rows(*now.forest())

        at, now = None, None
        for batch in batches:
            number = batch.column("range").to_numpy()
            own = batch.column("own").to_numpy(zero_copy_only=False)
            code = batch.column("code").to_numpy().view(np.uint64)
            edges = np.flatnonzero((np.diff(number) != 0) | (np.diff(own.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(number)]):
                if a == b:
                    continue
                if number[a] != at:
                    yield from close()
                    at, now = number[a], Range()
                if own[a]:
                    now.add(code[a:b])
                else:
                    if now.index is None:
                        now.build()
                    yield rows(*now.links(code[a:b], distance))
        yield from close()

    dealt = routed(codes, distance).repartition("range").sortWithinPartitions("range", F.col("own").desc(), "place")
    return dealt.select("range", "own", "code").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; the fingerprint as 16 hex digits."""
    prints = stored(fingerprints(docs, words, seed), "simhash")
    codes = stored(prints.groupBy("code").agg(F.min("doc_id").alias("rep")), "simhash_codes")
    found = stored(links(stored(ranged(codes), "simhash_ranges"), distance), "simhash_links")
    named = codes.join(components(found).withColumnRenamed("node", "code"), "code", "left").select(
        "code", "rep", F.coalesce("label", "code").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "label").select("code", "component_id")
    return prints.join(named, "code").select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
